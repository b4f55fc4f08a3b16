import hashlib
import math
import random

import duckdb
import numpy as np

from ledgerloom.llm import centroids as own


def plain(rows, k, rounds, seed, dims):
    """[(id, cluster, distance)] and the centroids, in Python integers and over all pairs."""
    kept = [(i, [max(-own.MOST, min(own.MOST, math.floor(256 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else w for n, w in enumerate(c)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], c


def compare(spark, rows, k=5, rounds=3, dims=4):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, c = own.cluster(df, k, rounds, 2, dims)
    want, centers = plain(rows, k, rounds, 2, dims)
    order = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert c.tolist() == centers
    out = own.cluster_report(df, k, rounds, 2, dims).collect()
    for r in out:
        assert r.inertia == sum(x[2] for x in want) and r.cluster_inertia == sum(x[2] for x in want if x[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()
    assert len(out) == len(want)


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [rnd.randint(-2, 2) / 256 for _ in range(4)]) for i in range(120)]  # ties
    rows += [(1, rows[1][1])] * 200 + [(1, rows[2][1]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [1.0, math.nan, 1.0, 1.0]), (906, [1.0, math.inf, 1.0, 1.0])]
    compare(spark, rows)


def test_few_and_extreme_vectors(spark):
    compare(spark, [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, -1e300, 1e300, 5.0]), (3, [1e300, 1e300, -1e300, 0.0])])
    compare(spark, [(7, [0.0, 0.0, 0.0, 0.0])] * 9)
    compare(spark, [(7, [1.0, 0.0, 0.0])])


def test_annulus_keeps_all_that_can_be_nearest():
    rnd = np.random.default_rng(4)
    for spread in (3, 50, 10_000, own.MOST):
        c = rnd.integers(-spread, spread + 1, (40, 8))
        c[7], c[9] = c[30], -c[30]
        x = np.concatenate([rnd.integers(-spread, spread + 1, (500, 8)), c, np.zeros((1, 8), np.int64), c[:5] // 2])
        d = np.stack([own.squared(x, w) for w in c], 1)
        search = own.Annulus(c)
        number, distance = search.nearest(x)
        assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()
    c = np.outer(np.arange(1, 41) * 1000, [1, 0, 0])
    first, end = own.Annulus(c).bounds(c + 3)
    assert (end - first <= 3).all()  # the others are never compared
    one = own.Annulus(np.array([[3, 4]]))
    assert one.nearest(np.array([[0, 0], [9, 9]]))[1].tolist() == [25, 61]


def test_shape_of_input(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0], "x", "y")], "vec_id long, embedding array<float>, cluster string, vec string")
    assert own.cluster_report(df, dims=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert own.cluster_report(df, dims=2).count() == 1 and own.cluster_report(df.limit(0), dims=2).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cols = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"SELECT {cols} FROM ({own.SQL['op12_centroids']})").fetchall()
    got = [tuple(r) for r in own.op12_centroids(spark, sf).select(*cols.split(", ")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 400
