"""BM25 over whole texts in one pass over the corpus, for any number of query sets at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import small, small_batches
from ledgerloom.functions.text import words
from ledgerloom.operators.topk import Asks, Best, restriction, scope_codes

K1, B = 1.2, 0.75
#: Distinct (query, term) pairs, and bytes of terms, up to which the queries are sent to all tasks.
MAX_PAIRS, MAX_BYTES = 2_000_000, 32_000_000
#: Scopes of a query set up to which it is sent to all tasks; beyond, documents meet only the queries of their own scope, by a join.
MAX_SCOPES = 200
#: Rows of documents that are worked on together.
ROWS = 512
#: Arrays of documents and queries that restrict what a query sees: terms of a lexicon, and document ids.
LISTS = ("tags", "documents")
#: Types of a query's key.
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def ranked(hits: DataFrame, k: int | None, *order, by=("query_id",)) -> DataFrame:
    """Best k hits of each query; Spark limits each partition's groups before the shuffle."""
    order = order or (F.desc("score"), F.asc("doc_id"))
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """docs (doc_id, text or words), queries (*by, text): the best k documents (*by, doc_id, score, rank) of each query by BM25.

    A term counts once for a query. If `docs` and `queries` both have an array of LISTS, a query with values in it sees only documents
    that share one; if both have a column `scope`, a query sees only documents of its scope; statistics are of all documents.
    Queries whose terms are small in bytes go to all tasks: document frequencies are counted in one pass; in the other each
    task sums the weights of the (document, query) pairs that share a term and keeps its own best k, so only those are shuffled,
    however common a term is. Larger query sets are joined with the postings by term, and those of many scopes by term and scope.
    """
    by = tuple(by)
    small_batches(docs.sparkSession)
    lists = [c for c in LISTS if c in queries.columns and c in docs.columns]
    scoped = "scope" in queries.columns and "scope" in docs.columns
    asked = asked_terms(queries, by, lists, scoped)
    found = F.col("words") if "words" in docs.columns else words(F.coalesce(F.col("text"), F.lit("")))
    sized = docs.select("doc_id", found.alias("w"), *lists, *(["scope"] if scoped else []))
    if too_many(asked) or scoped and asked.select("scope").distinct().limit(MAX_SCOPES + 1).count() > MAX_SCOPES:
        return _joined(sized, asked, k, k1, b, by)
    sent, terms, keys, out = sent_queries(asked, by, lists, scoped)
    vocabulary = docs.sparkSession.sparkContext.broadcast(terms)

    def placed(column, value_set):
        """(document, term) of the words that are asked for, and the documents' lengths."""
        offset = column.offsets.to_numpy()
        flat = column.values.slice(offset[0], offset[-1] - offset[0])
        code = pc.fill_null(pc.index_in(flat, value_set=value_set), -1).to_numpy()
        length = np.diff(offset)
        doc = np.repeat(np.arange(len(length)), length)
        return doc[code >= 0], code[code >= 0].astype(np.int64), length

    def count(batches):
        value_set, df, n, total = pa.array(vocabulary.value, pa.string()), np.zeros(len(vocabulary.value), np.int64), 0, 0
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            doc, code, length = placed(batch.column(0), value_set)
            df += np.bincount(np.unique(doc * max(1, len(df)) + code) % max(1, len(df)), minlength=len(df))
            n, total = n + len(length), total + int(length.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, np.arange(len(df))]), pa.array(np.r_[n, total, df])], names=["i", "x"])

    got = dict(map(tuple, sized.select("w").mapInArrow(count, "i long, x long").groupBy("i").agg(F.sum("x")).collect()))  # a number for each term
    n, total = got.get(-2, 0), got.get(-1, 0)
    df = np.array([got.get(i, 0) for i in range(len(terms))], np.float64)
    weights = docs.sparkSession.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))
    average = total / n if n else 1.0

    def score(batches):
        asks, value_set, idf = sent.value, pa.array(vocabulary.value, pa.string()), weights.value
        best, width = Best(asks.n, k), max(1, len(idf))
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS):
                batch = whole.slice(begin, ROWS)
                doc, code, length = placed(batch.column(1), value_set)
                key, tf = np.unique(doc * width + code, return_counts=True)
                d, t = key // width, key % width
                w = idf[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[d] / max(average, 1e-300)))
                ids = batch.column(0).cast(pa.int64()).to_numpy()
                values = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in lists}
                scopes = batch.column(batch.schema.get_field_index("scope")).to_pylist() if scoped else None
                for docs_, queries_, sums in asks.scores(d, t, w):
                    ok = asks.seen(docs_, queries_, values, scopes)
                    best.add(queries_[ok], ids[docs_[ok]], np.round(sums[ok], 6))
        yield from best_rows(best, keys, by)

    return ranked(sized.mapInArrow(score, out), k, by=by)


def asked_terms(queries: DataFrame, by, lists=(), scoped: bool = False) -> DataFrame:
    """(*by, terms, ...): the distinct terms of each query."""
    return queries.groupBy(*by).agg(F.array_distinct(F.flatten(F.collect_list(words(F.coalesce("text", F.lit("")))))).alias("terms"), *[F.first(c).alias(c) for c in [*lists, *(["scope"] if scoped else [])]])


def too_many(asked: DataFrame) -> bool:
    """Whether a query set is too large to be sent to all tasks, by pairs or by bytes."""
    lists = [c for c in LISTS if c in asked.columns]
    pairs = F.size("terms") + sum((F.greatest(F.size(c), F.lit(0)) for c in lists), F.lit(0))
    text = lambda c: F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0))
    size = asked.agg(F.coalesce(F.sum(pairs), F.lit(0)), F.coalesce(F.sum(text("terms") + sum((text(c) for c in lists), F.lit(0))), F.lit(0))).first()
    return size[0] > MAX_PAIRS or size[1] > MAX_BYTES


def sent_queries(asked: DataFrame, by, lists=(), scoped: bool = False):
    """(broadcast Asks, sorted terms, key columns, schema of the hits) of a query set that isn't `too_many`."""
    kinds = dict(asked.dtypes)
    rows = asked.orderBy(*by).collect()  # MAX_PAIRS terms at most
    terms = sorted({t for r in rows for t in r["terms"]})
    at = {t: i for i, t in enumerate(terms)}
    pairs = np.array([(at[t], q) for q, r in enumerate(rows) for t in r["terms"]], np.int64).reshape(-1, 2)
    keys = [pa.array([r[c] for r in rows], ARROW[kinds[c]]) for c in by]
    asks = Asks(pairs, len(terms), len(rows), {c: restriction([r[c] for r in rows]) for c in lists}, scope_codes([r["scope"] for r in rows]) if scoped else None)
    return asked.sparkSession.sparkContext.broadcast(asks), terms, keys, ", ".join([f"{c} {kinds[c]}" for c in by] + ["doc_id long", "score double"])


def best_rows(best: Best, keys: list[pa.Array], by):
    query, ids, score = best.hits()
    for at in range(0, len(query), 10_000):
        q = pa.array(query[at : at + 10_000])
        yield pa.RecordBatch.from_arrays([*(x.take(q) for x in keys), pa.array(ids[at : at + 10_000]), pa.array(score[at : at + 10_000])], names=[*by, "doc_id", "score"])


def _joined(sized: DataFrame, asked: DataFrame, k: int, k1: float, b: float, by: tuple[str, ...]) -> DataFrame:
    own = ["scope"] if "scope" in asked.columns else []
    terms = asked.select(*by, *own, F.explode("terms").alias("term"))
    sized = sized.withColumn("dl", F.size("w"))
    corpus = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = sized.select("doc_id", "dl", *own, F.explode("w").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi").groupBy("term", "doc_id", "dl", *own).agg(F.count("*").alias("tf"))
    weights = postings.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(corpus)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row beside each term
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = terms.join(postings, ["term", *own]).join(weights, "term").groupBy(*by, "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    for c in LISTS:
        if c in asked.columns:
            scores = scores.join(asked.select(*by, F.col(c).alias("_q")), list(by)).join(sized.select("doc_id", F.col(c).alias("_d")), "doc_id").where((F.coalesce(F.size("_q"), F.lit(0)) <= 0) | F.arrays_overlap("_q", "_d")).drop("_q", "_d")
    return ranked(scores, k, by=by)
