import random
import re

from ledgerloom.llm import near_dedup
from ledgerloom.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets, up = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(up)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_against_brute_force(spark):
    rnd = random.Random(11)
    say = lambda n: [rnd.choice(["The", "a", "É", "of"]) if rnd.random() < 0.3 else f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = [None, "", " \n", "one", "ONE", "one two three four", "One two\tthree  four", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = say(rnd.choice([20, 60, 200, 400]))
        texts.append(" ".join(base))
        for _ in range(rnd.randint(1, 14)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 45))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            texts.append(rnd.choice([" ", "\n"]).join(w))
    texts += [" ".join(say(30000))] * 2
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(None, texts[5], 1)], "doc_id long, text string, n int")
    rows = near_dedup.near_groups(df).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got.pop(None)[1:] == (None, True)
    assert got == brute(docs) and len(rows) == len(docs) + 1
    assert sum(not g[2] for g in got.values()) > 30
    assert near_dedup.near_dedup(df).columns == df.columns and near_dedup.near_dedup(df).count() == 1 + sum(g[2] for g in got.values())
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_large_group_in_parts(spark, monkeypatch):
    """Near copies of one text that differ in few or many places, so that many buckets hold several components."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 7)
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(40)}"
        docs.append((i, " ".join(w)))
    rnd.shuffle(docs)
    want = brute(docs)
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, gone int")
    rows = near_dedup.near_groups(df).collect()
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, g in want.items() if g[2]}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want
    assert 5 < len({g[1] for g in want.values()}) < 80


def test_wide_buckets_keep_pairs_of_one_band(spark, monkeypatch):
    """Similar pairs that share a single band, in buckets with many parts of others."""
    monkeypatch.setattr(near_dedup, "PART_ROWS", 3)
    monkeypatch.setattr(near_dedup, "AGAIN", 1)
    monkeypatch.setattr(near_dedup, "banding", lambda percent: (2, 1, 0))
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(0, 120, 2):
        w = list(base)
        for _ in range(9):
            w[rnd.randrange(200)] = f"x{rnd.randrange(5000)}"
        docs.append((i, " ".join(w)))
        w[rnd.randrange(200)] = f"y{rnd.randrange(5000)}"
        w[rnd.randrange(200)] = f"y{rnd.randrange(5000)}"
        docs.append((i + 1, " ".join(w)))
    sets = {d: shingles(t) for d, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bands = {r.id: set(r.bands) for r in near_dedup._sketched(df, 5, 2, 1).collect()}
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(df).collect()}
    similar = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    single = [(a, b) for a, b in similar if len(bands[a] & bands[b]) == 1]
    assert len(single) > 5
    assert [p for p in similar if bands[p[0]] & bands[p[1]] and got[p[0]] != got[p[1]]] == []
    want = brute(docs)
    assert all(want[d][1] == want[c][1] for d, c in got.items())


def test_prefixes_meet(spark):
    """Sets at the threshold share a shingle of their prefixes, whatever the levels."""
    import numpy as np

    rnd = random.Random(2)
    rows, pairs = [], []
    for i in range(0, 200, 2):
        n = rnd.randrange(1, 120)
        same = rnd.randrange(n + 1)
        x, extra = rnd.sample(range(1 << 40), n), rnd.sample(range(1 << 41, 1 << 42), rnd.randrange(10))
        y = x[:same] + extra
        if y and 100 * same >= 85 * len({*x, *y}):
            pairs.append((i, i + 1))
        rows += [(i, x), (i + 1, y)]
    rows = [(i, bytearray(np.sort(np.array(x, np.uint64)).tobytes())) for i, x in rows if x]
    df = spark.createDataFrame(rows, "id long, items binary")
    levels = near_dedup._levels(df)
    assert levels.sum() >= 0 and len(levels) == near_dedup.SLOTS
    for lv in (levels, np.random.default_rng(1).integers(0, 9, near_dedup.SLOTS).astype(np.uint8)):
        keys = {}
        for r in near_dedup._prefixes(df, lv, 85).collect():
            keys.setdefault(r.id, set()).add(r.key)
        assert pairs and all(keys[a] & keys[b] for a, b in pairs)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 3), (200, 200)]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def test_banding():
    for percent in (60, 70, 80, 85, 90, 100):
        bands, rows, least = near_dedup.banding(percent)
        p = percent / 100
        assert bands * rows <= near_dedup.COORDINATES and (1 - p**rows) ** bands <= near_dedup.MISSED and 0 < least <= bands * rows
    assert near_dedup.banding(85)[1] == 5
