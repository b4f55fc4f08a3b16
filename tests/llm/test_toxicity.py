import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import toxicity as tox


def brute_segments(scores, start=0):
    """The segment of greatest sum, the shortest and leftmost, and the same on both sides."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 1e-12 and (best is None or s > best[2] + 1e-12):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return brute_segments(scores[:i], start) + [(start + i, start + j, s)] + brute_segments(scores[j:], start + j)


def test_segments_are_maximal():
    rnd = random.Random(3)
    for _ in range(300):
        n = rnd.randint(0, 25)
        rest = -rnd.choice([0.1, 0.37, 1.03])
        listed = sorted(rnd.sample(range(n), rnd.randint(0, n)))
        marks = [(i, rnd.choice([0.51, 1.17, 2.73, -0.61])) for i in listed]
        full = [rest] * n
        for i, s in marks:
            full[i] = s
        got = tox.segments(marks, n, rest)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(full)]
        assert all(abs(s - sum(full[a:b])) < 1e-9 for a, b, s in got)


def test_held_out_accuracy(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(1500):
        toxic = i % 6 == 0
        t = [rnd.choice(words) for _ in range(rnd.randint(20, 150))]
        if toxic:
            for _ in range(5):
                t[rnd.randrange(len(t))] = rnd.choice(["vile", "nasty", "awfulness", "awfully"])
        rows.append((i, " ".join(t), int(toxic), "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    model = tox.fit(df, df.select("doc_id", "toxic").where(~tox.held_out()))
    out = tox.toxicity(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(tox.held_out())
    assert out.where("predicted <> toxic").count() <= 0.02 * out.count()
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "vile " * 50_000), (2, "w1")], "doc_id long, text string")
    got = tox.toxicity(odd, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got] == [0, 0, 1, 0]
    assert tox.detoxify(df, df.select("doc_id", "toxic")).columns == df.columns
    assert tox.toxicity(odd.limit(0), model).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = tox.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in tox.toxicity(df, model).collect()] == [0, 0]
    assert tox.detoxify(df, spark.createDataFrame([(1, None)], "doc_id long, toxic int")).count() == 2


def plain_fit(rows):
    """Lexicon, calibration and weights from (text, toxic) as the module's head describes them, on plain lists."""
    both = [Counter(), Counter()]
    for t, y in rows:
        both[y].update({f for w in set(tox.tokens(t)) for f in tox.features(w)})
    n = [sum(c.values()) for c in both]
    prior = tox.PRIOR * sum(n)
    lexicon = {}
    for w in both[0] | both[1]:
        y = [c[w] + tox.PRIOR * (both[0][w] + both[1][w]) for c in both]
        odds = math.log(y[1] / (n[1] + prior - y[1])) - math.log(y[0] / (n[0] + prior - y[0]))
        if odds >= tox.ODDS_MIN and odds / math.sqrt(1 / y[1] + 1 / y[0]) >= tox.Z_MIN:
            lexicon[w] = odds
    mass = [sum(c[w] for w in lexicon) / (k + prior) for c, k in zip(both, n)]
    rest = min(math.log((1 - mass[1]) / (1 - mass[0])), -1e-4)

    def found(t):
        w = tox.tokens(t)
        full = [rest] * len(w)
        for i, x in enumerate(w):
            known = [lexicon[f] for f in tox.features(x) if f in lexicon]
            full[i] = known[0] if known else rest
        return [s for *_, s in brute_segments(full)], max(1, len(w))

    best = [max(s, default=0.0) - math.log(k) for s, k in (found(t) for t, y in rows if not y)]
    mean = sum(best) / len(best)
    scale = max(1.0, math.sqrt(sum((x - mean) ** 2 for x in best) / len(best)) * math.sqrt(6) / math.pi)
    location = mean - 0.5772156649015329 * scale
    chance = lambda s, k: 1 - math.exp(-math.exp(-(s - math.log(k) - location) / scale))
    x = [min(50.0, sum(-math.log10(chance(s, k)) for s in ss)) for ss, k in (found(t) for t, _ in rows)]
    a, b = 1.0, -1.0
    for _ in range(5000):  # plain gradient descent on the same ridge
        p = [1 / (1 + math.exp(-(a * v + b))) for v in x]
        ga = sum((q - y) * v for q, v, (_, y) in zip(p, x, rows)) + 0.01 * a
        gb = sum(q - y for q, (_, y) in zip(p, rows)) + 0.01 * b
        a, b = a - 0.0005 * ga, b - 0.005 * gb
    return [1 / (1 + math.exp(-(a * v + b))) for v in x]


def test_scores_against_plain_version(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        t = [rnd.choice([f"w{k}" for k in range(12)]) for _ in range(rnd.randint(3, 12))]
        if toxic or i % 60 == 1:
            t.insert(rnd.randrange(len(t)), "vile" if rnd.random() < 0.8 else "vilest")
        rows.append((i, " ".join(t), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(df, df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in tox.toxicity(df, model).collect()}
    want = plain_fit([(t, y) for _, t, y in rows])
    assert all(abs(got[i] - w) < 0.02 for i, w in enumerate(want)) and len(model.lexicon) > 0


def test_many_hits_take_linear_time():
    marks = [(i, 3.0 if i % 2 else 0.5) for i in range(0, 400_000, 2)] + [(i, 0.2) for i in range(400_001, 800_000, 7)]
    t = time.time()
    assert tox.segments(marks, 800_000, -0.4)
    assert time.time() - t < 10


def test_repeated_and_extra_columns(spark):
    rows = [(1, "vile thing", 1, 0), (1, "vile thing", 1, 0), (2, "good thing", 0, 0), (None, "vile", 1, 0), (3, None, 0, 0)]
    df = spark.createDataFrame(rows, "key long, body string, text int, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = tox.detoxify(df, labels, id_col="key", text_col="body")
    assert out.columns == df.columns and out.count() == 5
    assert tox.detoxify(df.limit(0), labels, id_col="key", text_col="body").count() == 0
