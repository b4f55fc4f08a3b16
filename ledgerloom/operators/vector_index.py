"""Inner-product search by an inverted file: vectors written once by cell, and searches that read only the cells they probe.

A cell is what is nearest to one of the centroids. Centroids are fitted on a bounded sample; every vector is in the
index. A query probes the cells whose centroids have the greatest inner products with it: the scan is pruned to the cells
that any query probes, and in each cell only the queries that probe it are multiplied. The best FIRST cells of all queries are
scanned before the others. The index keeps each cell's radius and
greatest norm. They bound the inner products in it, so `exact` can go on with just the cells that may still hold a better hit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.storage import saved, shared_folder
from ledgerloom.functions.tables import read
from ledgerloom.operators import retrieval
from ledgerloom.operators.lexical import ranked
from ledgerloom.operators.retrieval import COLUMNS, MAX_QUERIES, MAX_VECTOR_BYTES
from ledgerloom.operators.topk import Best

#: Rows and bytes of the sample that centroids are fitted on: those with the least hash of their id.
SAMPLE, SAMPLE_BYTES = 20_000, 64_000_000
#: Cells at most, and rounds of fitting.
MAX_CELLS, ROUNDS = 4096, 10
#: Cells that are probed first: the scores found there are what hits of the others have to reach, so that tasks give few rows.
FIRST = 2
#: Rows of a cell in one file, about: larger cells are written by several tasks.
FILE_ROWS = 500_000


def nearest_cells(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance) of each vector's nearest centroid, of equally near ones the first."""
    cell, dist = np.zeros(len(v), np.int64), np.zeros(len(v))
    half = (centroids**2).sum(1) / 2
    for at in range(0, len(v), 2048):
        part = v[at : at + 2048]
        cell[at : at + 2048] = np.argmin(half - part @ centroids.T, 1)
    dist = np.sqrt(((v - centroids[cell]) ** 2).sum(1))
    return cell, dist


def fitted(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample: evenly spaced rows to begin with, then means; empty cells take the rows that are farthest from their own."""
    c = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        cell, dist = nearest_cells(sample, c)
        n = np.bincount(cell, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, cell, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        empty = np.nonzero(n == 0)[0]
        c[empty] = sample[np.argsort(-dist, kind="stable")[: len(empty)]]
    return c


class VectorIndex:
    """An inverted file at `path`: `cells` (cell, centroid, radius, norm, n), one row for each cell, and `vectors` in a folder for each cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MAX_CELLS at most
        self.centroids = np.array([r["centroid"] for r in rows], np.float64)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Index of vectors (vec_id, embedding) at a new path. About the square root of their number of cells, unless `cells` says otherwise; null vectors are left out."""
        spark, rows = vectors.sparkSession, vectors.where("embedding is not null").select("vec_id", "embedding")
        n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        most = max(1, min(sample, SAMPLE_BYTES // (8 * max(1, dims))))
        some = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").collect()], np.float64).reshape(-1, dims)
        cells = min(cells or max(1, round(n**0.5)), MAX_CELLS)
        centroids = fitted(some, cells) if len(some) else np.zeros((0, dims))
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/cells")
        index = cls(spark, path)
        index.add(rows)
        return index

    def add(self, vectors: DataFrame) -> None:
        """Appends vectors (vec_id, embedding) to their cells."""
        sent = self.spark.sparkContext.broadcast(self.centroids)

        def place(batches):
            for b in batches:
                if b.num_rows and len(sent.value):
                    v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                    cell, dist = nearest_cells(v, sent.value)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(dist), pa.array(np.sqrt((v**2).sum(1))), pa.array(cell.astype(np.int32))], names=["vec_id", "embedding", "distance", "norm", "cell"])

        kind = dict(vectors.dtypes)["vec_id"]
        placed = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(place, f"vec_id {kind}, embedding array<double>, distance double, norm double, cell int")
        # small cells share a task, a cell with very many rows is dealt to several, and files end at FILE_ROWS
        dealt = placed.hint("rebalance", "cell")
        dealt.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema("vec_id long, embedding array<double>, distance double, norm double, cell int").parquet(f"{self.path}/vectors") if len(self.centroids) else self.spark.createDataFrame([], "vec_id long, embedding array<double>, distance double, norm double, cell int")

    def cells(self) -> DataFrame:
        """(cell, n, radius, norm): what each cell holds now."""
        return self.vectors().groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("norm").alias("norm"))

    def search(self, queries: DataFrame, k: int, probes: int, exclude_self: bool = True, exact: bool = False) -> DataFrame:
        """Hits (query_id, doc_id, score, rank) of queries (vec_id, embedding) among the vectors of their `probes` best cells; with `exact`, of all vectors.

        Queries beyond MAX_QUERIES or MAX_VECTOR_BYTES run in hash blocks, each with a scan of its own cells.
        """
        n, size = queries.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()
        blocks = max(-(-n // (MAX_QUERIES // 2)), -(-size // (MAX_VECTOR_BYTES // 2))) if n > MAX_QUERIES or size > MAX_VECTOR_BYTES else 1
        out = None
        for i in range(blocks):
            some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i) if blocks > 1 else queries
            hits = self._search(some.select("vec_id", "embedding").collect(), k, probes, exclude_self, exact)
            out = hits if out is None else out.unionByName(hits)
        return out

    def _search(self, rows: list, k: int, probes: int, exclude_self: bool, exact: bool) -> DataFrame:
        if not len(rows) or not len(self.centroids):
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        ids = np.array([r[0] for r in rows], np.int64)
        q = np.array([r[1] for r in rows], np.float64)
        near = np.argsort(-(q @ self.centroids.T), 1, kind="stable")[:, :probes]
        hits, floor = self._floors(self._scan(ids, q, near[:, :FIRST], k, exclude_self), ids, k)
        if near.shape[1] > FIRST:
            more = self._scan(ids, q, near[:, FIRST:], k, exclude_self, floor)
            if not exact:
                return ranked(hits.unionByName(more), k)
            hits, floor = self._floors(hits.unionByName(more), ids, k)
        if not exact:
            return ranked(hits, k)
        known = {r["cell"]: (r["radius"], r["norm"]) for r in self.cells().collect()}
        radius, norm = (np.array([known.get(c, (0, 0))[i] for c in range(len(self.centroids))]) for i in (0, 1))
        length = np.sqrt((q**2).sum(1))[:, None]
        bound = np.minimum(q @ self.centroids.T + length * radius, length * norm) * (1 + 1e-12) + 1e-6
        may = (bound >= floor[:, None]) & np.array([c in known for c in range(len(self.centroids))])
        np.put_along_axis(may, near, False, 1)
        return ranked(hits.unionByName(self._scan(ids, q, [np.nonzero(m)[0] for m in may], k, exclude_self, floor)), k)

    def _floors(self, found: DataFrame, ids: np.ndarray, k: int) -> tuple[DataFrame, np.ndarray]:
        """The best k so far, written once, and for each query the score that a further hit has to reach."""
        hits = saved(ranked(found, k).drop("rank"), "hits")
        got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("last")).collect()  # a row for each query of the block
        last = {r[0]: r[2] for r in got if r[1] >= k}
        return hits, np.array([last.get(i, -np.inf) for i in ids.tolist()])

    def _scan(self, ids: np.ndarray, q: np.ndarray, near, k: int, exclude_self: bool, floor: np.ndarray | None = None) -> DataFrame:
        """Each task's best k of each query among the vectors of the cells that it probes, as far as they reach the query's `floor`."""
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(near):
            for c in cells:
                by_cell.setdefault(int(c), []).append(i)
        sent = self.spark.sparkContext.broadcast((ids, q, {c: np.array(x) for c, x in by_cell.items()}, floor))

        def best(batches):
            qid, matrix, asking, least = sent.value
            top = Best(len(qid), k)
            for b in batches:
                cells = b.column(0).to_numpy()
                for cell in np.unique(cells):
                    own = b.filter(pa.array(cells == cell))
                    vid, v = own.column(1).to_numpy(), np.stack(own.column(2).to_numpy(zero_copy_only=False))
                    who = asking.get(int(cell), ())
                    for at in range(0, len(who), COLUMNS):
                        some = who[at : at + COLUMNS]
                        score = np.round(v @ matrix[some].T, 6)
                        if exclude_self:
                            score[vid[:, None] == qid[some][None, :]] = -np.inf
                        if least is not None:
                            score[score < least[some][None, :]] = -np.inf
                        top.add_block(some, vid, score)
            query, doc, score = top.hits()
            yield pa.RecordBatch.from_arrays([pa.array(qid[query]), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])

        rows = self.vectors().where(F.col("cell").isin(sorted(by_cell))).select("cell", "vec_id", "embedding")
        return rows.mapInArrow(best, "query_id long, doc_id long, score double")


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact hits that a search found."""
    found = exact.select("query_id", "doc_id").join(hits.select("query_id", "doc_id", F.lit(1).alias("f")), ["query_id", "doc_id"], "left")
    return found.groupBy("query_id").agg((F.sum(F.coalesce("f", F.lit(0))) / F.count("*")).alias("recall"))


# queries

#: Share of the cells that the registered queries probe: the given vectors have no clusters to speak of, so their neighbours are in very many cells.
PROBES = 0.7


def _index(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return v, VectorIndex.build(v, shared_folder(spark, "vectors"))


def rt1_ann(spark, d):
    """The best ten of every fiftieth vector by the inverted file; approximate."""
    v, index = _index(spark, d)
    return index.search(v.where("vec_id % 50 = 0"), 10, max(1, round(PROBES * len(index.centroids)))).select("query_id", "doc_id", "score", "rank")


def rt1_ann_exact(spark, d):
    """The same, gone on until no cell can hold a better hit; equal to the exact search."""
    v, index = _index(spark, d)
    return index.search(v.where("vec_id % 50 = 0"), 10, max(1, round(PROBES * len(index.centroids) / 4)), exact=True).select("query_id", "doc_id", "score", "rank")


QUERIES = {f.__name__: f for f in (rt1_ann, rt1_ann_exact)}
#: rt1_ann is approximate: its recall is measured in the tests.
SQL = {"rt1_ann_exact": retrieval.SQL["rt1_dense_ip"]}
