"""Ranked retrieval: BM25, inner-product search, fusion, dedup, parent merge, thresholds, fallback.

Rankings are frames with (query_id, doc_id, score, rank), never an order of rows.
All queries run in one plan. Scores are rounded to six places before they are
ranked, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small
from ledgerloom.functions.text import words
from ledgerloom.operators.lexical import K1, B, bm25, ranked
from ledgerloom.operators.topk import Best, scope_codes

RRF_K = 60


#: Rows and bytes of query vectors up to which they are sent to all tasks, and queries that are multiplied together.
MAX_QUERIES, MAX_VECTOR_BYTES, COLUMNS = 20_000, 64_000_000, 256


def inner_product(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, max_queries: int = MAX_QUERIES) -> DataFrame:
    """vectors and queries (vec_id, embedding): best k by exact inner product. If both have a column `scope`, a query meets only vectors of its scope.

    Queries must be at most `max_queries` and MAX_VECTOR_BYTES; they are sent to all tasks as one matrix, and each task keeps its own
    best k of each query, so only those are shuffled.
    """
    scoped = "scope" in vectors.columns and "scope" in queries.columns
    cols = ["vec_id", "embedding", *(["scope"] if scoped else [])]
    size = queries.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()
    if size[0] > max_queries or size[1] > MAX_VECTOR_BYTES:
        raise ValueError(f"more than {max_queries} queries or {MAX_VECTOR_BYTES} bytes; run them in blocks")
    rows = queries.select(*cols).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    matrix = np.array([r[1] for r in rows], np.float64)
    sent = queries.sparkSession.sparkContext.broadcast((ids, matrix, scope_codes([r[2] for r in rows]) if scoped else None))

    def best(frames):
        qid, q, scopes = sent.value
        top = Best(len(qid), k)
        for f in frames:
            if not len(f) or not len(qid):
                continue
            vid, v = f["vec_id"].to_numpy(), np.stack(f["embedding"].to_numpy()).astype(np.float64)
            if scopes is None:
                top_of_block(top, qid, q, np.arange(len(qid)), vid, v, exclude_self)
                continue
            of = f["scope"].map(scopes[0]).fillna(-1).to_numpy(np.int64)
            for code in np.unique(of[of >= 0]):  # rows of a scope meet its queries only
                own = of == code
                top_of_block(top, qid, q, np.nonzero(scopes[1] == code)[0], vid[own], v[own], exclude_self)
        yield from _hit_frames(top, qid)

    return ranked(vectors.select(*cols).mapInPandas(best, "query_id long, doc_id long, score double"), k)


def top_of_block(top: Best, qid, q, asking, vid, v, exclude_self: bool) -> None:
    """Adds the products of vectors with the queries at the places `asking`, COLUMNS of them at a time."""
    for at in range(0, len(asking), COLUMNS):
        some = asking[at : at + COLUMNS]
        score = np.round(v @ q[some].T, 6)
        if exclude_self:
            score[vid[:, None] == qid[some][None, :]] = -np.inf
        top.add_block(some, vid, score)


def _hit_frames(top: Best, qid):
    import pandas as pd

    query, ids, score = top.hits()
    yield pd.DataFrame({"query_id": qid[query] if len(qid) else query, "doc_id": ids, "score": score})


def inner_product_blocks(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, max_queries: int = MAX_QUERIES) -> DataFrame:
    """As inner_product, for any number of queries: beyond its bounds, hash blocks of queries meet hash blocks of vectors in tasks of their own.

    Each pair of blocks gives its best k of each query. A block has about half of `max_queries` rows; each vector is shuffled once for each block of queries, and each query once for each block of vectors.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("embedding")), F.lit(0))).first()
    if n <= max_queries and size <= MAX_VECTOR_BYTES:
        return inner_product(vectors, queries, k, exclude_self, max_queries)
    if "scope" in vectors.columns and "scope" in queries.columns:
        raise ValueError("scoped queries beyond the bounds: run them in blocks")
    most = max(1, min(max_queries // 2, MAX_VECTOR_BYTES * n // (2 * max(1, size))))
    q_blocks, v_blocks = -(-n // most), -(-max(1, vectors.count()) // most)
    block = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = vectors.select("vec_id", "embedding", block(v_blocks).alias("v"), every(q_blocks).alias("q"))
    right = queries.select("vec_id", "embedding", block(q_blocks).alias("q"), every(v_blocks).alias("v"))

    def best(vs, qs):
        import pandas as pd

        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        stack = lambda f: np.stack(f["embedding"].to_numpy()).astype(np.float64)
        qid, top = qs["vec_id"].to_numpy(), Best(len(qs), k)
        top_of_block(top, qid, stack(qs), np.arange(len(qs)), vs["vec_id"].to_numpy(), stack(vs), exclude_self)
        return next(_hit_frames(top, qid))

    pairs = left.groupBy("q", "v").cogroup(right.groupBy("q", "v"))
    return ranked(pairs.applyInPandas(best, "query_id long, doc_id long, score double"), k)


def reciprocal_rank_fusion(legs: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Sum over the legs of 1 / (rrf_k + rank); a leg without the document adds nothing."""
    out = legs[0].select("query_id", "doc_id", "rank")
    for leg in legs[1:]:
        out = out.unionByName(leg.select("query_id", "doc_id", "rank"))
    return fused(out, k, rrf_k)


def fused(hits: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of hits (query_id, doc_id, rank) of any number of legs."""
    return ranked(hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("score")), k)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """hits (query_id, key, pos, score, rerank_score): one row for each key at its first position with the greatest effective score.

    If any of the rows has a rerank score, the greatest goes to rerank_score, even if it came from score.
    """
    effective = F.coalesce("rerank_score", "score", F.lit(0.0))
    out = hits.groupBy("query_id", "key").agg(F.min("pos").alias("pos"), F.max(effective).alias("best"), F.max(F.col("rerank_score").isNotNull()).alias("reranked"), F.min_by("score", "pos").alias("first_score"), F.count("*").alias("copies"))
    return out.select("query_id", "key", "pos", "copies", F.when(F.col("reranked"), F.col("first_score")).otherwise(F.col("best")).alias("score"), F.when(F.col("reranked"), F.col("best")).alias("rerank_score"))


def dedupe_versions(hits: DataFrame, k: int) -> DataFrame:
    """hits (query_id, doc_key, version, pos, ...): the newest version of each key, ties to the first, at the key's first position; then the first k."""
    rest = F.struct(*[c for c in hits.columns if c not in ("query_id", "doc_key")])
    newest = hits.groupBy("query_id", "doc_key").agg(F.min("pos").alias("slot"), F.max_by(rest, F.struct(F.col("version"), -F.col("pos"))).alias("r"))
    out = newest.select("query_id", "doc_key", "slot", F.col("r.version").alias("version"), F.col("r.pos").alias("pos"))
    return ranked(out, k, F.asc("slot"))


def merge_to_parents(hits: DataFrame, threshold: int = 2) -> DataFrame:
    """hits (query_id, chunk_id, parent_id, pos, score): `threshold` or more hits of one parent become the parent, at their first position with their greatest score."""
    group = hits.groupBy("query_id", F.when(F.col("parent_id").isNotNull(), F.col("parent_id")).alias("parent")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("score").alias("best"))
    group = group.where(F.col("parent").isNotNull() & (F.col("n") >= threshold))
    merged = group.select("query_id", F.col("parent").alias("chunk_id"), F.col("first").alias("pos"), F.col("best").alias("score"), F.col("n").alias("merged"))
    alone = hits.join(group.select("query_id", F.col("parent").alias("parent_id")), ["query_id", "parent_id"], "left_anti")
    return merged.unionByName(alone.select("query_id", "chunk_id", "pos", "score", F.lit(0).cast("bigint").alias("merged")))


def meets_min_score(score, least: float):
    """A null score passes only if there is no positive threshold."""
    return F.coalesce(score >= least, F.lit(least <= 0))


def fallback(legs: list[tuple[str, DataFrame]], queries: DataFrame) -> DataFrame:
    """For each query, the hits of the first leg that has any; queries without hits get a row with mode `none`."""
    out = None
    for i, (name, leg) in enumerate(legs):
        rows = leg.select("query_id", "doc_id", "score", "rank", F.lit(i).alias("leg"), F.lit(name).alias("mode"))
        out = rows if out is None else out.unionByName(rows)
    chosen = out.groupBy("query_id").agg(F.min("leg").alias("leg"))
    return queries.select("query_id").join(out.join(chosen, ["query_id", "leg"]), "query_id", "left").select("query_id", "doc_id", "score", "rank", F.coalesce("mode", F.lit("none")).alias("mode"))


def unique_ranking(hits: DataFrame) -> DataFrame:
    """First occurrence of each document, ranked anew."""
    first = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("at"))
    return ranked(first, None, F.asc("at"))


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query of `gold` (query_id, doc_id): recall, precision (by k), F1, reciprocal rank over the whole ranking, binary nDCG."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    met = unique_ranking(hits).join(gold, ["query_id", "doc_id"], "left_semi")
    got = met.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("n_hit"), F.min("rank").alias("first"), F.coalesce(F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    out = size.join(got, "query_id", "left").select("query_id", "n_gold", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), "first", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))
    recall, precision = F.col("n_hit") / F.col("n_gold"), F.col("n_hit") / F.lit(float(k))
    return out.select("query_id", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"), F.round(F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)), 6).alias("f1"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


# queries

K = 5


def _passages(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _corpus(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def _bm25(spark, d, k=K):
    return bm25(_corpus(spark, d), _passages(spark, d), k)


def _legs(spark, d, k):
    """Leg 0 of whole passages and leg 1 of their first eight words, in one pass over the corpus."""
    q = _passages(spark, d).select("query_id", "text", F.lit(0).alias("leg"))
    short = q.withColumn("text", F.array_join(F.slice(words(F.col("text")), 1, 8), " ")).withColumn("leg", F.lit(1))
    return bm25(_corpus(spark, d), q.unionByName(short), k, by=("leg", "query_id"))


def rt2_bm25(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", "score", "rank")


#: Longest block of characters by which containment is looked up.
BLOCK = 64


def gold_by_containment(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id) where a document contains a passage, without a limit on either.

    Wherever a passage of 2g - 1 characters stands, it covers a block of g characters that starts at a
    multiple of g. So the documents' aligned blocks are looked up among the first g windows of each passage, with g
    the greatest power of two up to BLOCK that the passage has room for; text comparison decides. All documents contain an empty passage.
    """
    sizes = [2**i for i in range(BLOCK.bit_length())]
    g = F.array_max(F.filter(F.array(*[F.lit(x) for x in sizes]), lambda x: 2 * x - 1 <= F.length("text")))
    asked = queries.where("text <> ''").select("query_id", g.alias("g"), "text")
    windows = asked.select("query_id", "g", F.explode(F.transform(F.sequence(F.lit(1), F.col("g")), lambda i: F.substring("text", i, F.col("g")))).alias("b"))
    windows = small(windows.select("query_id", F.xxhash64("g", "b").alias("h")).distinct())
    used = sorted(r[0] for r in asked.select("g").distinct().collect())  # of at most seven sizes
    aligned = lambda x: F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{{x}}}"), F.lit(0)), lambda b: F.xxhash64(F.lit(x), b))
    blocks = F.concat(F.array().cast("array<bigint>"), *[aligned(x) for x in used])
    cand = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(blocks)).alias("h")).join(windows, "h").select("query_id", "doc_id").distinct()
    cand = cand.unionByName(queries.where("text = ''").select("query_id").crossJoin(docs.where(F.col("text").isNotNull()).select("doc_id").distinct()))
    both = cand.join(docs.withColumnRenamed("text", "body"), "doc_id").join(small(queries), "query_id")
    return both.where(F.contains("body", "text")).select("query_id", "doc_id")


def ev1_retrieval_metrics(spark, d):
    gold = gold_by_containment(_corpus(spark, d), _passages(spark, d))
    return retrieval_metrics(_bm25(spark, d), gold, K)


def rt1_dense_ip(spark, d):
    v = read(spark, d, "embeddings")
    return inner_product_blocks(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "doc_id", "score", "rank")


def rt3_rrf(spark, d):
    return fused(_legs(spark, d, 30), 15).select("query_id", "doc_id", "score", "rank")


def wn1_dedupe(spark, d):
    second = F.col("leg") == 1
    hits = _legs(spark, d, 30).select("query_id", F.col("doc_id").alias("key"), (F.col("rank") + F.when(second, 30).otherwise(0)).alias("pos"), "score", F.when(second & (F.col("doc_id") % 2 == 0), F.col("score") / 10).alias("rerank_score"))
    return dedupe_hits(hits)


def wn2_version_dedupe(spark, d):
    o = read(spark, d, "orders")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderpriority").alias("doc_key"), F.year("o_orderdate").alias("version"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("pos"))
    return dedupe_versions(hits, 3)


def wn3_auto_merge(spark, d):
    """Chunks of 100 words are children of the documents; a query's best 20 chunks are merged where two or more share a document."""
    chunks = read(spark, d, "documents").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 100).cast("int")), lambda i: F.array_join(F.slice("w", i * 100 + 1, 100), " "))).alias("n", "text"))
    chunks = chunks.select((F.col("doc_id") * 1_000_000 + F.col("n")).alias("doc_id"), "text").where("text <> ''")
    hits = bm25(chunks, _passages(spark, d), 20).select("query_id", F.col("doc_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 1_000_000)).alias("parent_id"), F.col("rank").alias("pos"), "score")
    return merge_to_parents(hits).select("query_id", "chunk_id", "pos", "score", "merged")


def fl5_threshold(spark, d):
    s = F.when(F.col("rank") % 4 != 0, F.col("score"))
    return _bm25(spark, d, 8).select("query_id", "doc_id", s.alias("score")).select("query_id", "doc_id", meets_min_score(F.col("score"), 25.0).alias("passes"), meets_min_score(F.col("score"), 0.0).alias("passes_without"))


def rt8_fallback_ladder(spark, d):
    both = _legs(spark, d, 10)
    return fallback([("hybrid", fused(both.where("score > 60"), 5)), ("sparse", both.where("leg = 0 and score > 30 and rank <= 5"))], _passages(spark, d))


def rt7_production(spark, d):
    """Recall, merge of legs, truncation and threshold in one plan."""
    top = ranked(fused(_legs(spark, d, 30), 15).drop("rank"), 5)
    return top.where(meets_min_score(F.col("score"), 0.02)).select("query_id", "doc_id", "score", "rank")


QUERIES = {f.__name__: f for f in (rt1_dense_ip, rt2_bm25, rt3_rrf, ev1_retrieval_metrics, wn1_dedupe, wn2_version_dedupe, wn3_auto_merge, fl5_threshold, rt8_fallback_ladder, rt7_production)}

_W = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def bm25_sql(name: str, docs: str, queries: str, k: int) -> str:
    """CTEs that end in `name` (query_id, doc_id, score, rank)."""
    p = name
    return f"""{p}_t AS (SELECT DISTINCT query_id, unnest({_W.format("text")}) AS term FROM ({queries})),
        {p}_s AS (SELECT doc_id, {_W.format("coalesce(text, '')")} AS w FROM ({docs})),
        {p}_c AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM {p}_s),
        {p}_p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM {p}_s) WHERE term IN (SELECT term FROM {p}_t) GROUP BY ALL),
        {p}_d AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf, avgdl FROM {p}_p, {p}_c GROUP BY term, n, avgdl),
        {p}_r AS (SELECT query_id, doc_id, round(sum(idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * dl / avgdl))), 6) AS score FROM {p}_t JOIN {p}_p USING (term) JOIN {p}_d USING (term) GROUP BY ALL),
        {p} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}_r QUALIFY rank <= {k})"""


_D, _Q = "SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, text FROM benchmark"
_SHORT = f"SELECT item_id AS query_id, array_to_string({_W.format('text')}[1:8], ' ') AS text FROM benchmark"


def _legs_sql(k: int) -> str:
    return bm25_sql("a", _D, _Q, k) + ",\n" + bm25_sql("b", _D, _SHORT, k)


def _rrf_sql(name: str, legs: str, k: int) -> str:
    return f"{name}_u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / ({RRF_K} + rank)), 9) AS score FROM ({legs}) GROUP BY ALL), {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_u QUALIFY rank <= {k})"


_BOTH = "SELECT query_id, doc_id, rank FROM a UNION ALL SELECT query_id, doc_id, rank FROM b"
SQL = {
    "rt2_bm25": f"WITH {bm25_sql('a', _D, _Q, K)} SELECT query_id, doc_id, score, rank FROM a",
    "ev1_retrieval_metrics": f"""
        WITH {bm25_sql("a", _D, _Q, K)},
        gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
        m AS (SELECT query_id, count(*) AS n_hit, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM a JOIN gold USING (query_id, doc_id) GROUP BY 1),
        x AS (SELECT query_id, n_gold, coalesce(n_hit, 0) AS n_hit, first, coalesce(dcg, 0) AS dcg, list_sum(list_transform(range(1, least(n_gold, {K}) + 1), lambda r: 1 / log2(r + 1.0))) AS ideal FROM g LEFT JOIN m USING (query_id))
        SELECT query_id, round(n_hit / n_gold, 6) AS recall, round(n_hit / {K}.0::DOUBLE, 6) AS precision, round(coalesce(2 * (n_hit / n_gold) * (n_hit / {K}.0::DOUBLE) / nullif(n_hit / n_gold + n_hit / {K}.0::DOUBLE, 0), 0), 6) AS f1,
               round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(dcg / ideal, 6) AS ndcg FROM x""",
    "rt1_dense_ip": """
        WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
                   FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""",
    "rt3_rrf": f"WITH {_legs_sql(30)}, {_rrf_sql('r', _BOTH, 15)} SELECT query_id, doc_id, score, rank FROM r",
    "wn1_dedupe": f"""
        WITH {_legs_sql(30)},
        h AS (SELECT query_id, doc_id AS key, rank AS pos, score, NULL::DOUBLE AS rerank_score FROM a UNION ALL SELECT query_id, doc_id, rank + 30, score, CASE WHEN doc_id % 2 = 0 THEN score / 10 END FROM b),
        g AS (SELECT query_id, key, min(pos) AS pos, count(*) AS copies, max(coalesce(rerank_score, score, 0)) AS best, bool_or(rerank_score IS NOT NULL) AS re, arg_min(score, pos) AS first_score FROM h GROUP BY ALL)
        SELECT query_id, key, pos, copies, CASE WHEN re THEN first_score ELSE best END AS score, CASE WHEN re THEN best END AS rerank_score FROM g""",
    "wn2_version_dedupe": """
        WITH h AS (SELECT o_custkey AS query_id, o_orderpriority AS doc_key, year(o_orderdate) AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders),
        n AS (SELECT *, min(pos) OVER (PARTITION BY query_id, doc_key) AS slot FROM h QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY version DESC, pos) = 1)
        SELECT query_id, doc_key, slot, version, pos, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS rank FROM n QUALIFY rank <= 3""",
    "wn3_auto_merge": f"""
        WITH ch AS (SELECT doc_id * 1000000 + n AS doc_id, array_to_string(w[n * 100 + 1 : n * 100 + 100], ' ') AS text FROM (SELECT doc_id, {_W.format("text")} AS w FROM documents), unnest(range(0, len(w) // 100 + 1)) AS t(n)),
        {bm25_sql("a", "SELECT * FROM ch WHERE text <> ''", _Q, 20)},
        h AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, 'd' || (doc_id // 1000000) AS parent_id, rank AS pos, score FROM a),
        g AS (SELECT query_id, parent_id, count(*) AS n, min(pos) AS pos, max(score) AS score FROM h GROUP BY ALL HAVING count(*) >= 2)
        SELECT query_id, parent_id AS chunk_id, pos, score, n AS merged FROM g UNION ALL SELECT query_id, chunk_id, pos, score, 0 FROM h ANTI JOIN g USING (query_id, parent_id)""",
    "fl5_threshold": f"WITH {bm25_sql('a', _D, _Q, 8)}, s AS (SELECT query_id, doc_id, CASE WHEN rank % 4 <> 0 THEN score END AS score FROM a) SELECT query_id, doc_id, coalesce(score >= 25, false) AS passes, coalesce(score >= 0, true) AS passes_without FROM s",
    "rt8_fallback_ladder": f"""
        WITH {_legs_sql(10)}, {_rrf_sql("r", "SELECT query_id, doc_id, rank FROM a WHERE score > 60 UNION ALL SELECT query_id, doc_id, rank FROM b WHERE score > 60", 5)},
        u AS (SELECT query_id, doc_id, score, rank, 'hybrid' AS mode FROM r UNION ALL SELECT query_id, doc_id, score, rank, 'sparse' FROM a WHERE score > 30 AND rank <= 5 AND query_id NOT IN (SELECT query_id FROM r))
        SELECT item_id AS query_id, doc_id, score, rank, coalesce(mode, 'none') AS mode FROM benchmark LEFT JOIN u ON item_id = query_id""",
    "rt7_production": f"WITH {_legs_sql(30)}, {_rrf_sql('r', _BOTH, 5)} SELECT query_id, doc_id, score, rank FROM r WHERE score >= 0.02",
}
