import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import hmm


def plain_forward(x, pi, a, b):
    alpha, total = pi, 0.0
    for c in x:
        joint = alpha * b[c]
        total += math.log(joint.sum())
        alpha = joint / joint.sum() @ a
    return total


def plain_counts(x, pi, a, b):
    n, k = len(x), len(a)
    al, be = np.zeros((n, k)), np.ones((n, k))
    al[0] = pi * b[x[0]]
    for t in range(1, n):
        al[t] = al[t - 1] @ a * b[x[t]]
        al[t] /= al[t].sum()
    for t in range(n - 2, -1, -1):
        be[t] = a @ (b[x[t + 1]] * be[t + 1])
        be[t] /= be[t].sum()
    g = al * be
    g /= g.sum(1, keepdims=True)
    moves = np.zeros((k, k))
    for t in range(n - 1):
        m = al[t][:, None] * a * (b[x[t + 1]] * be[t + 1])[None]
        moves += m / m.sum()
    em = np.zeros_like(b)
    for t in range(n):
        em[x[t]] += g[t]
    return g[0], moves, em


def test_recursions_are_exact():
    rnd = np.random.default_rng(0)
    k, c = 3, 11
    pi, a, b = rnd.dirichlet(np.ones(k)), rnd.dirichlet(np.ones(k), k), rnd.dirichlet(np.ones(c), k).T
    seqs = [rnd.integers(0, c, n) for n in (1, 2, 63, 64, 65, 128, 129, 700, 5)]
    x, lengths = np.concatenate(seqs).astype(np.int32), np.array([len(s) for s in seqs])
    assert np.allclose(hmm.log_likelihood(x, lengths, pi, a, b), [plain_forward(s, pi, a, b) for s in seqs])
    got, want = hmm.expected_counts(x, lengths, pi, a, b), [sum(p) for p in zip(*(plain_counts(s, pi, a, b) for s in seqs))]
    for g, w in zip(got, want):
        assert np.allclose(g, w)


def test_scores(spark):
    texts = ["The cat sat on the mat", "le chat est sur la table", None, "", "the dog sat", "la table est la"] * 20 + ["unseen words here", "é " * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the cat", "x")], "doc_id long, text string, w string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out = hmm.lm_scores(df, held, top=8, tail=16, states=2)
    rows = {r.doc_id: r for r in out.collect()}
    flags = {r.doc_id: r.h for r in df.select("doc_id", held.alias("h")).collect()}
    text = dict(enumerate(texts)) | {None: "the cat"}
    c = Counter(w for i, t in text.items() if not flags[i] for w in hmm.tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts) + 1
    for i, t in text.items():
        w = hmm.tokens(t)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (flags[i], len(w), sum(x in c for x in w), n)
        assert math.isclose(rows[i].base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert hmm.lm_scores(df.limit(0), F.lit(False)).count() == 0


def plain_model(docs, top, tail, states, iterations):
    """Scores of all texts by the model of the module's head: plain counts, plain_counts and plain_forward."""
    train = [hmm.tokens(t) for t, h in docs if not h]
    c = Counter(w for x in train for w in x)
    frequent = [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].decode()))][:top]
    classes = hmm.Classes(frequent, tail)
    unknown = classes.top + hmm.hash64(b"unknown") % tail
    kind = lambda w: classes(w) if w in c else unknown
    weight = np.zeros(classes.n)
    for w, k in c.items():
        weight[classes(w)] += k + 0.5
    weight[unknown] += 0.5
    pi, a, b = hmm.initial(states, classes.n, weight / weight.sum())
    for _ in range(iterations):
        sums = [sum(p) for p in zip(*(plain_counts([kind(w) for w in x], pi, a, b) for x in train))]
        pi, a = (sums[0] + 1) / (sums[0] + 1).sum(), (sums[1] + 1) / (sums[1] + 1).sum(1, keepdims=True)
        of = sums[2] + hmm.PULL * sums[2].sum(0) / sums[2].sum()
        b = weight[:, None] * of / of.sum(1, keepdims=True)
        b = b / b.sum(0)
    inside = lambda w: math.log10((c[w] + 0.5) / weight[kind(w)])
    scores = [plain_forward([kind(w) for w in x], pi, a, b) / math.log(10) + sum(map(inside, x)) for x in (hmm.tokens(t) for t, _ in docs)]
    # the words' probabilities as first tokens: all known ones and the unknown one
    first = [10 ** inside(w) * (pi * b[kind(w)]).sum() for w in [*c, b"never seen"]]
    return scores, sum(first)


def test_scores_against_plain_model(spark):
    rnd = random.Random(3)
    docs = [(" ".join(rnd.choice(["Ana", "ana", "bob", "cé", "dd", "eee", "fgh", "fgi", "é😀"]) for _ in range(rnd.randint(0, 90))), rnd.random() < 0.3) for _ in range(40)] + [(None, False), ("zzz ana", True)]
    scores, mass = plain_model(docs, 4, 8, 3, 4)
    assert abs(mass - 1) < 1e-9
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(docs)], "doc_id long, text string, h boolean")
    got = {r.doc_id: r.score for r in hmm.lm_scores(df, F.col("h"), top=4, tail=8, states=3).collect()}
    assert np.allclose([got[i] for i in range(len(docs))], scores)


def test_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (None, "a b", "x", 2), (None, "a b", "x", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string, block int")
    got = hmm.lm_scores(df, F.lit(False), top=2, tail=2, states=2).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and got[0].train_tokens == 12
