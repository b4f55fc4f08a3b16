import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.storage import shared_folder
from ledgerloom.operators import retrieval
from ledgerloom.operators import vector_index as vi
from ledgerloom.operators.topk import Asks, Best, restriction, scope_codes


def test_best_keeps_the_best():
    rnd = random.Random(1)
    best, all_hits = Best(5, 3), []
    for _ in range(40):
        n = rnd.randint(0, 30)
        hits = [(rnd.randrange(5), rnd.randrange(10_000), rnd.choice([0.5, 1.0, rnd.random(), -np.inf])) for _ in range(n)]
        all_hits += hits
        q, i, s = (np.array([h[c] for h in hits]) for c in range(3)) if hits else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        best.add(q.astype(int), i.astype(int), s.astype(float))
    query, ids, score = best.hits()
    got = sorted(zip(query.tolist(), ids.tolist(), score.tolist()))
    want = [(q, i, s) for q in range(5) for s, i in [(-a, b) for a, b in sorted((-s, i) for p, i, s in all_hits if p == q and s > -np.inf)[:3]]]
    assert got == sorted(want)


def test_sparse_scores_and_restrictions(monkeypatch):
    rnd = np.random.default_rng(2)
    pairs = np.unique(rnd.integers(0, [6, 4], (20, 2)), axis=0)
    tags = [["a"], [], ["b", "c"], None]
    asks = Asks(pairs, 6, 4, {"tags": restriction(tags)}, scope_codes(["x", "y", None, "x"]))
    doc = np.sort(rnd.integers(0, 50, 300))
    term, w = rnd.integers(0, 7, 300) % 6, rnd.random(300)
    want = {}
    for d, t, x in zip(doc, term, w):
        for tt, q in pairs:
            if tt == t:
                want[d, q] = want.get((d, q), 0) + x
    for cells in (1, 40, 4_000_000):
        monkeypatch.setattr("ledgerloom.operators.topk.CELLS", cells)
        got = {(int(d), int(q)): s for a, b, c in asks.scores(doc, term, w) for d, q, s in zip(a, b, c)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    own = [["a", "z"], ["c"], [], None, ["b"]]
    scopes = ["x", "y", None, "x", "x"]
    d, q = np.divmod(np.arange(20), 4)
    ok = asks.seen(d, q, {"tags": own}, scopes)
    of = ["x", "y", None, "x"]
    assert ok.tolist() == [scopes[a] is not None and scopes[a] == of[b] and (not tags[b] or bool(set(own[a] or []) & set(tags[b]))) for a, b in zip(d, q)]


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(3)
    centers = rnd.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rnd.normal(size=16) * 0.4).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(700)]  # one very common vector
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def test_search_against_all_vectors(spark, vectors):
    index = vi.VectorIndex.build(vectors, shared_folder(spark, "v"), cells=30)
    q = vectors.where("vec_id % 97 = 0")
    want = sorted(map(tuple, retrieval.inner_product(vectors, q, 5).collect()))
    assert sorted(map(tuple, index.search(q, 5, 2, exact=True).collect())) == want
    some = index.search(q, 5, 6)
    assert vi.recall(some, spark.createDataFrame(want, "query_id long, doc_id long, score double, rank int")).agg({"recall": "avg"}).first()[0] >= 0.9
    assert sorted(map(tuple, index.search(q, 5, 30).collect())) == want
    assert index.cells().agg({"n": "sum"}).first()[0] == 2200


def test_only_probed_cells_are_read(spark, vectors):
    index = vi.VectorIndex.build(vectors, shared_folder(spark, "v"), cells=30)
    row = vectors.where("vec_id = 5").first()
    out = index._scan(np.array([5]), np.array([row.embedding]), [[3, 4]], 3, True)
    assert "cell#" in out._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    inside = index.vectors().where("cell in (3, 4)")
    read = inside.select(F.input_file_name()).distinct().collect()
    assert {f[0].split("cell=")[1].split("/")[0] for f in read} == {"3", "4"}
    scores = [(round(float(np.dot(row.embedding, r.embedding)), 6), r.vec_id) for r in inside.where("vec_id <> 5").collect()]
    want = [(i, s) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:3]]
    assert [(r.doc_id, r.score) for r in vi.ranked(out, 3).orderBy("rank").collect()] == want


def test_rows_are_added(spark, vectors):
    index = vi.VectorIndex.build(vectors.where("vec_id < 800"), shared_folder(spark, "v"), cells=20)
    index.add(vectors.where("vec_id >= 800"))
    q = vectors.where("vec_id in (3, 900)")
    again = vi.VectorIndex(spark, index.path)
    assert sorted(map(tuple, again.search(q, 4, 3, exact=True).collect())) == sorted(map(tuple, retrieval.inner_product(vectors, q, 4).collect()))


def test_queries_in_blocks(spark, vectors, monkeypatch):
    index = vi.VectorIndex.build(vectors, shared_folder(spark, "v"), cells=10)
    q = vectors.where("vec_id % 40 = 1")
    want = sorted(map(tuple, index.search(q, 3, 4).collect()))
    monkeypatch.setattr(vi, "MAX_QUERIES", 20)
    assert sorted(map(tuple, index.search(q, 3, 4).collect())) == want and len(want) > 60


def test_empty_sides(spark, vectors):
    none = vectors.limit(0)
    index = vi.VectorIndex.build(none, shared_folder(spark, "v"))
    assert index.search(vectors.limit(3), 3, 2).count() == 0 and index.search(vectors.limit(3), 3, 2, exact=True).count() == 0
    assert vi.VectorIndex.build(vectors, shared_folder(spark, "v"), cells=5).search(none, 3, 2).count() == 0


def test_recall_on_the_given_vectors(spark):
    for sf in ("sf0.01", "sf0.1"):
        got = vi.rt1_ann(spark, f"/root/testdata/{sf}")
        r = vi.recall(got, retrieval.rt1_dense_ip(spark, f"/root/testdata/{sf}")).agg({"recall": "avg"}).first()[0]
        print(sf, "recall@10", r)
        assert r >= 0.9


def test_scopes_before_scores(spark, vectors):
    v = vectors.selectExpr("vec_id", "embedding", "cast(vec_id % 3 as string) as scope")
    q = v.where("vec_id in (1, 2, 300)")
    got = retrieval.inner_product(v, q, 4).collect()
    assert len(got) == 12 and all(r.query_id % 3 == r.doc_id % 3 for r in got)
    for i in (1, 2, 300):
        own = retrieval.inner_product(vectors.where(f"vec_id % 3 = {i % 3}"), vectors.where(f"vec_id = {i}"), 4).collect()
        assert sorted(map(tuple, own)) == sorted(tuple(r) for r in got if r.query_id == i)
