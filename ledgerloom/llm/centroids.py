"""Centroid clustering of integer vectors by annulus search.

A centroid within distance u of a vector x has a norm within u of the norm of x. So
centroids are sorted by norm; the distance to the one whose norm is nearest is an upper
bound u for the distance to the nearest centroid, and both ends of the annulus of norms
[|x| - u, |x| + u] are found by binary search. Only the centroids in it are compared,
exactly, in integers; those on the boundary are among them, so ties go to the smaller
number. Bounds are widened by more than their rounding errors.

Everything that leaves a task is sums: each task adds up its vectors of each cluster,
and the driver gets at most k rows of them in a round. Nothing is shuffled by vector,
so equal or very common vectors don't matter. Sums are of integers, so their order
doesn't matter either.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import table, written

#: Components are integers floor(SCALE * x), and end at -MOST and MOST: squared distances of 64 of them fit a long.
SCALE, MOST = 256, 1 << 27
#: Vectors that are compared together.
ROWS = 4096


def is_kept(vec: Column, dims: int) -> Column:
    """Whether a vector has exactly `dims` components, none null or non-finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vec) == dims) & finite, F.lit(False))


def integers(vec: Column) -> Column:
    """floor(SCALE * x) of each component; components beyond MOST end there."""
    return F.transform(vec, lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x.cast("double") * SCALE))))).cast("bigint"))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    """Integer vectors of an Arrow column of kept vectors, as `integers` makes them."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64)


class Annulus:
    """Centroids (k, dims) sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = np.asarray(centroids, np.int64)
        norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) in norm order of the centroids that can be nearest to each vector."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        at, last = np.searchsorted(self.norms, norm), len(self.norms) - 1
        left, right = np.maximum(at - 1, 0), np.minimum(at, last)
        near = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        u = np.sqrt(squared(x, self.centroids[self.order[near]]).astype(np.float64))
        slack = 1e-6 + 1e-9 * (norm + u)
        return np.searchsorted(self.norms, norm - u - slack, "left"), np.searchsorted(self.norms, norm + u + slack, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid; of equally near ones the smaller number."""
        first, end = self.bounds(x)
        cluster, best = np.full(len(x), len(self.centroids), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        for at in range(int(first.min(initial=0)), int(end.max(initial=0))):
            rows = np.nonzero((first <= at) & (at < end))[0]
            if not len(rows):
                continue
            number = self.order[at]
            d = squared(x[rows], self.centroids[number])
            better = (d < best[rows]) | ((d == best[rows]) & (number < cluster[rows]))
            cluster[rows[better]], best[rows[better]] = number, d[better]
        return cluster, best


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to y, or to the rows of y."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def _blocks(batch: pa.RecordBatch, dims: int):
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, _rows(part.column(part.num_columns - 1), dims)


def _step(kept: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each cluster; empty ones stay."""
    sent = kept.sparkSession.sparkContext.broadcast(centroids)

    def add(batches):
        search, n = Annulus(sent.value), len(sent.value)
        count, total = np.zeros(n, np.int64), np.zeros((n, dims), np.int64)
        for b in batches:
            for _, x in _blocks(b, dims):
                cluster, _ = search.nearest(x)
                count += np.bincount(cluster, minlength=n)
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(0)
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(dims))], names=["cluster", "n", *(f"s{i}" for i in range(dims))])

    sums = ["n", *(f"s{i}" for i in range(dims))]
    parts = kept.select("vec").mapInArrow(add, "cluster long, " + ", ".join(f"{c} long" for c in sums))
    out = centroids.copy()
    # decimals hold the sums of any number of rows; at most one row for each centroid comes to the driver
    for row in parts.groupBy("cluster").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in sums]).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(dims)]
    sent.destroy()
    return out


def starting(kept: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k kept vectors with the least sha256 of `seed:id`; of one id, the least vectors first. Null ids come last, and fewer than k vectors give fewer centroids."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(digest.alias("h"), integers(F.col("vec")).alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, dims)


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(frame (id, cluster, distance), centroids): `rounds` rounds of k-means from seeded starting vectors, then one more assignment.

    A row is kept if its vector has exactly `dims` components, none null or non-finite; others have no row in the result.
    Components become integers floor(256 * x); those beyond 2**27 end there, so that each squared distance is a long.
    Repeated rows and rows that share an id count each for itself, null ids included. Equally near centroids: the smaller
    number. With fewer than k kept vectors there are as many centroids; an empty table gives an empty frame and no
    centroids. Other columns are ignored, whatever their names. Each round reads the vectors once and runs when called.
    """
    vec = F.col(f"`{vec_col}`")
    kept = df.where(is_kept(vec, dims)).select(df[id_col].alias("id"), vec.alias("vec"))
    centroids = starting(kept, k, seed, dims)
    if len(centroids):
        for _ in range(rounds):
            centroids = _step(kept, centroids, dims)
    sent = df.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        search = Annulus(sent.value)
        for b in batches:
            for part, x in _blocks(b, dims):
                number, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    kind = dict(kept.dtypes)["id"]
    return kept.mapInArrow(assign, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), centroids


def cluster_report(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each kept vector; sums that are no long are null. Otherwise as `cluster`."""
    found, centroids = cluster(df, k, rounds, seed, dims, id_col, vec_col)
    found = written(found)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    fits = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = [(i, fits(sums.get(i, 0)), d) for i, d in enumerate(digests)]
    side = df.sparkSession.createDataFrame(own, "cluster int, cluster_inertia long, centroid_sha256 string")
    total = F.lit(fits(sum(sums.values()))).cast("bigint")
    return found.join(F.broadcast(side), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")  # k rows are broadcast


def op12_centroids(spark, sf_dir):
    return cluster_report(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    """The rounds spelled out: distances of all vectors to all centroids, exact in doubles as long as they are below 2**53."""
    nearest = (
        "SELECT vec_id, u, v, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY distance, cluster) AS r FROM "
        "(SELECT x.vec_id, x.u, x.v, c.cluster, (list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, c.v::DOUBLE[]) + list_inner_product(c.v::DOUBLE[], c.v::DOUBLE[]))::BIGINT AS distance FROM kept x, c{n} c)) WHERE r = 1"
    )
    mean = f"list_transform(range(1, {dims + 1}), lambda i: CASE WHEN s[i] % n < 0 THEN s[i] // n - 1 ELSE s[i] // n END)"
    sums = "[" + ", ".join(f"sum(v[{i}])::BIGINT" for i in range(1, dims + 1)) + "]"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS u, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1)::INTEGER AS cluster, v FROM kept ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v LIMIT {k})",
    ]
    for n in range(rounds):
        parts.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n)})")
        parts.append(f"m{n} AS MATERIALIZED (SELECT cluster, count(*) AS n, {sums} AS s FROM a{n} GROUP BY cluster)")
        parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c.cluster, CASE WHEN m.n IS NULL THEN c.v ELSE {mean} END AS v FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster)")
    last = f"a{rounds}"
    parts.append(f"{last} AS MATERIALIZED ({nearest.format(n=rounds)})")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON c.cluster = a.cluster"
    )


SQL = {"op12_centroids": _sql()}
QUERIES = {"op12_centroids": op12_centroids}
