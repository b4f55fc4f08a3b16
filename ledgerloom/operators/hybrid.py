"""Hybrid retrieval: a dense and a lexical leg, modes, ladders with their attempts, scoped funnels, expansion and fan-in.

A dense leg is any ranking (query_id, doc_id, score, rank) of vectors, such as `retrieval.inner_product_blocks`. All queries run in one plan, and
each ladder computes its legs once and chooses by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.planning import asks_for_records, required_types
from ledgerloom.functions.rules import DISEASES, SYMPTOMS, drugs, symptoms
from ledgerloom.functions.tables import read
from ledgerloom.functions.text import any_of, found_in
from ledgerloom.operators import retrieval
from ledgerloom.operators.lexical import bm25, ranked
from ledgerloom.operators.lexicon import matches
from ledgerloom.operators.retrieval import fused

VERIFIED = ["user_confirmed", "clinician_verified"]
LEAF = 3


def tagged(legs: dict[str, DataFrame]) -> DataFrame:
    """Legs (query_id, doc_id, score, rank) as one frame with their names."""
    out = None
    for name, leg in legs.items():
        rows = leg.select("query_id", "doc_id", "score", "rank", F.lit(name).alias("leg"))
        out = rows if out is None else out.unionByName(rows)
    return out


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, versions: DataFrame | None = None) -> DataFrame:
    """Both legs to 2k, fused to 3k, then the newest version of each (document, content), and the first k.

    versions (doc_id, doc_key, version). Without them hits are cut to k.
    """
    both = tagged({"dense": dense.where(F.col("rank") <= 2 * k), "sparse": sparse.where(F.col("rank") <= 2 * k)})
    hits = fused(both, 3 * k)
    return newest(hits, versions, k) if versions is not None else ranked(hits.drop("rank"), k)


def newest(hits: DataFrame, versions: DataFrame, k: int) -> DataFrame:
    """hits (query_id, doc_id, score, rank): the newest version of each key at the key's first place, ties to the first; then the first k."""
    with_key = hits.join(versions, "doc_id")
    best = with_key.groupBy("query_id", "doc_key").agg(F.min("rank").alias("slot"), F.max_by(F.struct("doc_id", "score"), F.struct(F.col("version"), -F.col("rank"))).alias("r"))
    return ranked(best.select("query_id", "slot", "r.doc_id", "r.score"), k, F.asc("slot")).drop("slot")


def by_mode(mode: str, dense: DataFrame, sparse: DataFrame, k: int, candidates: int = 20, rerank: DataFrame | None = None) -> DataFrame:
    """Evaluation modes: bm25, dense, hybrid, or hybrid_rerank: `candidates` fused hits in the order of rerank (query_id, doc_id, rerank_score), those without a score by their own."""
    if mode in ("bm25", "dense"):
        return (sparse if mode == "bm25" else dense).where(F.col("rank") <= k)
    hits = fused(tagged({"dense": dense.where(F.col("rank") <= candidates), "sparse": sparse.where(F.col("rank") <= candidates)}), candidates)
    if mode == "hybrid":
        return hits.where(F.col("rank") <= k)
    if mode != "hybrid_rerank":
        raise ValueError(f"unknown mode {mode!r}")
    scored = hits.drop("rank").join(rerank, ["query_id", "doc_id"], "left") if rerank is not None else hits.drop("rank").withColumn("rerank_score", F.lit(None).cast("double"))
    return ranked(scored.select("query_id", "doc_id", F.coalesce("rerank_score", "score").alias("score")), k)


def ladder(legs: dict[str, DataFrame], queries: DataFrame, k: int, empty: str = "no_results") -> DataFrame:
    """(query_id, mode, attempts, degraded, hits): the first leg that has hits, and what each leg tried until then gave.

    attempts lists (mode, status ok or empty, count) up to the leg that was taken; degraded if it wasn't the first.
    """
    names = list(legs)
    hits = tagged(legs).where(F.col("rank") <= k)
    by_leg = hits.groupBy("query_id", "leg").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("h"))  # k rows of each leg
    found = by_leg.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("leg", "h"))).alias("m"))
    none = F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")
    out = queries.select("query_id").join(found, "query_id", "left").withColumn("all", F.array(*[F.struct(F.lit(n).alias("mode"), F.coalesce(F.try_element_at(F.coalesce("m", F.create_map().cast("map<string,array<struct<rank:int,doc_id:bigint,score:double>>>")), F.lit(n)), none).alias("h")) for n in names]))
    at = F.array_position(F.transform("all", lambda x: F.size(x["h"]) > 0), True)
    tried = F.when(at > 0, at.cast("int")).otherwise(len(names))
    attempts = F.transform(F.slice("all", F.lit(1), tried), lambda x: F.struct(x["mode"].alias("mode"), F.when(F.size(x["h"]) > 0, "ok").otherwise("empty").alias("status"), F.size(x["h"]).alias("count")))
    taken = F.get("all", (at - 1).cast("int"))
    return out.select("query_id", F.coalesce(F.when(at > 0, taken["mode"]), F.lit(empty)).alias("mode"), attempts.alias("attempts"), (at != 1).alias("degraded"), F.coalesce(F.when(at > 0, taken["h"]), none).alias("hits"))


def merged(hits: DataFrame, k: int | None = None) -> DataFrame:
    """Bag union of hits (query_id, doc_id, score, pos) of several branches: each document at its first place with its greatest score."""
    return ranked(hits.groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"), F.max("score").alias("score")), k, F.asc("pos"))


def fan_in(branches: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """branches (query_id, sub_id, status), hits (query_id, sub_id, doc_id, score, rank): (documents, summary) of each query.

    Branch after branch, each document once. The summary tells the mode, whether it is degraded and why: all branches failed, all
    are empty, or some failed.
    """
    docs = merged(hits.select("query_id", "doc_id", "score", F.struct("sub_id", "rank").alias("pos"))).drop("pos")
    n = branches.groupBy("query_id").agg(F.count("*").alias("branches"), F.count_if(F.col("status") == "error").alias("failed"))
    got = docs.groupBy("query_id").agg(F.count("*").alias("documents"))
    out = n.join(got, "query_id", "left").na.fill(0, ["documents"])
    reason = F.when((F.col("failed") > 0) & (F.col("failed") == F.col("branches")), "all_sub_agents_failed").when(F.col("documents") == 0, "all_sub_agents_empty").when(F.col("failed") > 0, "partial_sub_agent_failure").otherwise("")
    return docs, out.select("query_id", "branches", "failed", "documents", F.when(F.col("documents") > 0, "parallel_synthesis").otherwise("no_results").alias("mode"), ((F.col("failed") > 0) | (F.col("documents") == 0)).alias("degraded"), reason.alias("reason"))


def expanded(strategy: Column, hyde: DataFrame, step_back: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of the expansions of each query: hyde, step_back or (complex) both, hyde first; each document once."""
    first = hyde.select("query_id", "doc_id", "score", F.struct(F.lit(0).alias("leg"), "rank").alias("pos"), F.array(F.lit("hyde"), F.lit("complex")).alias("of"))
    second = step_back.select("query_id", "doc_id", "score", F.struct(F.lit(1).alias("leg"), "rank").alias("pos"), F.array(F.lit("step_back"), F.lit("complex")).alias("of"))
    chosen = queries.select("query_id", F.coalesce(strategy, F.lit("step_back")).alias("strategy"))
    return merged(first.unionByName(second).join(chosen, "query_id").where(F.array_contains("of", F.col("strategy")))).drop("pos")


def document_ids(sections: DataFrame, topics: DataFrame, most: int = 100) -> DataFrame:
    """sections (document_id, chunk_level, section_path, pos), topics (query_id, terms): up to `most` documents of each query, in first-seen order.

    Only upper levels count. Each section is searched once for the terms of all queries, however many, and meets the queries by term.
    """
    asked = topics.select("query_id", F.explode("terms").alias("term")).distinct()
    upper = sections.where(F.col("chunk_level").isin(1, 2) & (F.coalesce("document_id", F.lit("")) != "")).select(F.struct("document_id", "pos").alias("id"), "section_path")
    paths = matches(upper, "id", "section_path", asked).select("id.document_id", "id.pos", "term")
    seen = paths.groupBy("document_id", "term").agg(F.min("pos").alias("pos")).join(asked, "term").groupBy("query_id", "document_id").agg(F.min("pos").alias("pos"))
    return ranked(seen, most, F.asc("pos"), F.asc("document_id"))


def topic_terms(text: Column, diseases=DISEASES, aliases=SYMPTOMS) -> Column:
    """Diseases, symptom names and drugs of a question, each once."""
    return F.array_distinct(F.concat(found_in(text, diseases), symptoms(text, aliases), drugs(text)))


def stage_scope(questions: DataFrame, markers, diseases=DISEASES, aliases=SYMPTOMS) -> DataFrame:
    """questions (query_id, text, patient) with domain public, patient or both, whether a personal marker stands in it, and the resource types that it needs.

    Without a patient, or without a marker, only public documents are searched.
    """
    marker = asks_for_records(F.col("text"), markers)
    general = F.size(topic_terms(F.col("text"), diseases, aliases)) > 0
    domain = F.when(F.col("patient").isNull() | ~marker, "public").when(general, "both").otherwise("patient")
    return questions.select("*", domain.alias("domain"), marker.alias("patient_marker"), required_types(F.col("text")).alias("resource_types"))


def funnel(questions: DataFrame, chunks: DataFrame, k: int, markers, lexicon: list[str], scored) -> tuple[DataFrame, DataFrame]:
    """Scope, topic, document: (hits, trace) of each question.

    questions (query_id, text, patient), chunks (doc_id, text, domain, patient, document_id, chunk_level, section_path). The scope decides which domains are searched, and private
    chunks are seen only by questions of their patient. A question whose text holds terms of the lexicon sees only chunks that hold one of them, and, where
    documents have such a term in an upper section, only those documents. `scored(chunks, questions, k)` ranks what its `tags`, `documents` and `scope` let a question see (`bm25`,
    for instance): all filters come before the ranking, and only k hits of each question leave a task.
    """
    has = found_in(F.col("text"), lexicon)
    q = stage_scope(questions, markers, lexicon, {}).withColumn("terms", has)
    leaves = chunks.where(F.col("chunk_level") == LEAF).withColumn("tags", has)
    parts = []
    for order, domain in enumerate(("public", "patient")):
        own = q.where(F.col("domain").isin(domain, "both"))
        rows = leaves.where(F.col("domain") == domain)
        upper = chunks.where(F.col("domain") == domain)
        scope = F.lit("all") if domain == "public" else F.col("patient")
        narrowed = document_ids(upper.select("document_id", "chunk_level", "section_path", F.col("doc_id").alias("pos")), own.select("query_id", "terms"))
        within = narrowed.groupBy("query_id").agg(F.collect_set("document_id").alias("documents"))  # document_ids gives so many at most
        asking = own.select("query_id", "text", F.col("terms").alias("tags"), scope.alias("scope")).join(within, "query_id", "left")
        hits = scored(rows.withColumn("scope", scope).withColumn("documents", F.array("document_id")), asking, k)
        parts.append(hits.select("query_id", "doc_id", "score", F.struct(F.lit(order).alias("domain"), "rank").alias("pos")))
    hits = merged(parts[0].unionByName(parts[1]))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    trace = q.join(found, "query_id", "left").select("query_id", "domain", "patient_marker", F.array_join("terms", ",").alias("terms"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("degraded"), ((F.col("domain") == "public") & F.col("patient_marker")).alias("final_public_fallback"))
    return hits.drop("pos"), trace


# queries

_N = 5


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _dense(spark, d, k):
    v = read(spark, d, "embeddings")
    return retrieval.inner_product_blocks(v, v.join(_questions(spark, d).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), k)


def _both(spark, d, k):
    return _dense(spark, d, k), bm25(_docs(spark, d), _questions(spark, d), k)


def rt3_hybrid(spark, d):
    """Dense and BM25 legs, fusion and version dedup: documents of one source and length class are versions of each other."""
    v = read(spark, d, "documents").select("doc_id", F.concat_ws("|", "source", "lang", (F.col("n_chars") % 11).cast("string")).alias("doc_key"), (F.col("doc_id") % 4).alias("version"))
    dense, sparse = _both(spark, d, 2 * _N)
    return hybrid(dense, sparse, _N, v).select("query_id", "doc_id", "score", "rank")


def rt4_modes(spark, d):
    dense, sparse = _both(spark, d, 20)
    rerank = sparse.select("query_id", "doc_id", ((F.col("doc_id") * 7919) % 1000 / 1000.0).alias("rerank_score")).where("doc_id % 3 > 0")
    out = None
    for mode in ("bm25", "dense", "hybrid", "hybrid_rerank"):
        rows = by_mode(mode, dense, sparse, _N, 20, rerank).select(F.lit(mode).alias("mode"), "query_id", "doc_id", "score", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def _ladder_rows(out):
    log = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["mode"], a["status"], a["count"].cast("string"))), ",")
    return out.select("query_id", "mode", log.alias("attempts"), "degraded", F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("hits"))


def rt8_ladder(spark, d):
    """Hybrid, dense and sparse rungs, each behind a threshold of its own, with the attempts."""
    dense, sparse = _both(spark, d, 2 * _N)
    strong = hybrid(dense, sparse, _N).where("score > 0.0325")
    return _ladder_rows(ladder({"hybrid": strong, "dense_fallback": dense.where("score > 0.45"), "sparse_fallback": sparse.where("score > 40")}, _questions(spark, d), _N))


def rt9_patient_ladder(spark, d):
    """The ladder within a patient's own rows: a document belongs to patient doc_id % 7, a question to item_id % 9."""
    docs = _docs(spark, d).withColumn("scope", (F.col("doc_id") % 7).cast("string"))
    asked = _questions(spark, d).withColumn("scope", (F.col("query_id") % 9).cast("string"))
    sparse = bm25(docs, asked, 2 * _N)
    v = read(spark, d, "embeddings")
    mine = v.join(asked.select(F.col("query_id").alias("vec_id"), "scope"), "vec_id")
    dense = retrieval.inner_product(v.withColumn("scope", (F.col("vec_id") % 7).cast("string")), mine, 2 * _N)
    good = sparse.where("score > 12")
    return _ladder_rows(ladder({"hybrid": fused(tagged({"dense": dense.where("score > 0.4"), "sparse": good}), _N).where("score > 0.032"), "dense": dense.where("score > 0.42"), "sparse": good}, asked, _N))


LEX = ["license", "tion", "ingon", "der", "las"]


def _funnel(spark, d):
    docs = read(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "patient").otherwise("public").alias("domain"), (F.col("doc_id") % 5).cast("string").alias("patient"), F.concat(F.lit("d"), F.col("doc_id") % 90).alias("document_id"),
        F.when(F.col("doc_id") % 4 == 0, 1).otherwise(3).alias("chunk_level"), F.left(F.coalesce("text", F.lit("")), F.lit(40)).alias("section_path"),
    )
    q = _questions(spark, d).withColumn("patient", F.when(F.col("query_id") % 4 > 0, (F.col("query_id") % 5).cast("string")))
    return funnel(q, docs, _N, ["el", "ta"], LEX, bm25)


def rt10_funnel(spark, d):
    return _funnel(spark, d)[0].select("query_id", "doc_id", "score", "rank")


def rt10_trace(spark, d):
    return _funnel(spark, d)[1].select("query_id", "domain", "patient_marker", "terms", "n", "degraded", "final_public_fallback")


def fl3_documents(spark, d):
    s = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id") % 300).alias("document_id"), (F.col("doc_id") % 4).cast("int").alias("chunk_level"), F.coalesce("text", F.lit("")).alias("section_path"), F.col("doc_id").alias("pos"))
    topics = spark.createDataFrame([(1, ["license"]), (2, ["ana", "der "]), (3, [])], "query_id int, terms array<string>")
    return document_ids(s, topics, 30).select("query_id", "document_id", "rank")


def fl6_verified(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "user_confirmed").when(F.col("o_orderstatus") == "P", "clinician_verified").otherwise("candidate").alias("verification_status"))
    return o.where(F.col("verification_status").isin(*VERIFIED)).select("o_orderkey")


def rt16_fan_in(spark, d):
    """Sub-questions are the halves of the passages; those of every seventh fail."""
    docs, summary = _fan(spark, d)
    return docs.join(summary.select("query_id", "mode", "reason"), "query_id").select("query_id", "doc_id", "score", "rank", "mode", "reason")


def st2_fan_summary(spark, d):
    return _fan(spark, d)[1]


def _fan(spark, d):
    from ledgerloom.functions.text import words

    w = words(F.col("text"))
    half = F.floor(F.size(w) / 2).cast("int")
    subs = _questions(spark, d).select("query_id", F.posexplode(F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, F.size(w)), " "))).alias("sub_id", "text"))
    status = F.when((F.col("query_id") % 7 == 0) & ((F.col("sub_id") == 1) | (F.col("query_id") % 14 == 0)), "error").otherwise("ok")
    subs = subs.withColumn("status", status)
    hits = bm25(_docs(spark, d), subs.where("status = 'ok'").select("query_id", "sub_id", "text"), 3, by=("query_id", "sub_id"))
    return fan_in(subs.select("query_id", "sub_id", "status"), hits)


def rt15_expanded(spark, d):
    q = _questions(spark, d)
    strategy = F.get(F.array(F.lit("hyde"), F.lit("step_back"), F.lit("complex"), F.lit(None)), (F.col("query_id") % 4).cast("int"))
    dense, sparse = _both(spark, d, 3)
    return expanded(strategy, dense, sparse, q).select("query_id", "doc_id", "score", "rank")


def rt11_memory(spark, d):
    """Recall of a user's own turns: questions are the last user turns, memories all other turns of the same conversation."""
    c = read(spark, d, "conversations").where("text is not null")
    last = c.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    asked = c.join(last, ["conv_id", "turn"]).select(F.col("conv_id").alias("query_id"), "text", F.col("conv_id").cast("string").alias("scope"))
    rows = c.join(last, ["conv_id", "turn"], "left_anti").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text", F.col("conv_id").cast("string").alias("scope"))
    return bm25(rows, asked, 3).select("query_id", "doc_id", "score", "rank")


def tk2_over_fetch(spark, d):
    """Legs of 2k, fused to 3k, cut to k after dedup by source."""
    dense, sparse = _both(spark, d, 2 * _N)
    hits = fused(tagged({"dense": dense, "sparse": sparse}), 3 * _N)
    s = read(spark, d, "documents").select("doc_id", F.col("source").alias("doc_key"), F.lit(0).alias("version"))
    return newest(hits, s, _N).select("query_id", "doc_id", "rank")


QUERIES = {f.__name__: f for f in (rt3_hybrid, rt4_modes, rt8_ladder, rt9_patient_ladder, rt10_funnel, rt10_trace, fl3_documents, fl6_verified, rt16_fan_in, st2_fan_summary, rt15_expanded, rt11_memory, tk2_over_fetch)}

_R = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank"


def _dense_sql(name: str, k: int) -> str:
    return f"""{name} AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark) QUALIFY rank <= {k})"""


_D = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def _both_sql(k: int) -> str:
    return _dense_sql("e", k) + ", " + retrieval.bm25_sql("s", _D, retrieval._Q, k)


def _fuse_sql(name: str, legs: str, k: int) -> str:
    return f"{name}_u AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / ({retrieval.RRF_K} + rank)), 9) AS score FROM ({legs}) GROUP BY ALL), {name} AS (SELECT *, {_R} FROM {name}_u QUALIFY rank <= {k})"


_ES = "SELECT query_id, doc_id, rank FROM e UNION ALL SELECT query_id, doc_id, rank FROM s"
_log = lambda legs: "concat_ws(',', " + ", ".join(f"CASE WHEN upto >= {i} THEN '{n}:' || CASE WHEN n{i} > 0 THEN 'ok' ELSE 'empty' END || ':' || n{i} END" for i, n in enumerate(legs, 1)) + ")"


def _ladder_sql(legs: list[str], selects: list[str], queries: str) -> str:
    parts = ", ".join(f"g{i} AS (SELECT query_id, count(*) AS n{i}, string_agg(doc_id, ',' ORDER BY rank) AS h{i} FROM ({s}) WHERE rank <= {_N} GROUP BY 1)" for i, s in enumerate(selects, 1))
    joins = " ".join(f"LEFT JOIN g{i} USING (query_id)" for i in range(1, len(legs) + 1))
    ns = ", ".join(f"coalesce(n{i}, 0) AS n{i}, h{i}" for i in range(1, len(legs) + 1))
    first = "CASE " + " ".join(f"WHEN n{i} > 0 THEN {i}" for i in range(1, len(legs) + 1)) + " END"
    return f"""{parts}, b AS (SELECT query_id, {ns} FROM ({queries}) {joins}), chosen AS (SELECT *, {first} AS got, coalesce({first}, {len(legs)}) AS upto FROM b)
        SELECT query_id, CASE got {" ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(legs, 1))} ELSE 'no_results' END AS mode, {_log(legs)} AS attempts, got IS DISTINCT FROM 1 AS degraded,
            coalesce(CASE got {" ".join(f"WHEN {i} THEN h{i}" for i in range(1, len(legs) + 1))} END, '') AS hits FROM chosen"""


def _scored_sql(name: str, docs: str, queries: str, tags: bool = False, scope: bool = False) -> str:
    """All scored pairs; docs (doc_id, text[, tags, scope]), queries (query_id, text[, tags, scope]); statistics of all documents."""
    base = retrieval.bm25_sql(name, f"SELECT doc_id, text FROM ({docs})", f"SELECT query_id, text FROM ({queries})", 1_000_000_000)
    if not (tags or scope):
        return base
    ok = " AND ".join((["(len(q.tags) = 0 OR list_has_any(q.tags, d.tags))"] if tags else []) + (["q.scope = d.scope"] if scope else []))
    return base + f", {name}f AS (SELECT a.query_id, a.doc_id, a.score FROM {name} a JOIN ({queries}) q USING (query_id) JOIN ({docs}) d USING (doc_id) WHERE {ok})"


_has = lambda c, ts: "list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{t}') THEN '{t}' END" for t in ts) + "], lambda x: x IS NOT NULL)"
_C = f"""SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN 'patient' ELSE 'public' END AS domain, CAST(doc_id % 5 AS VARCHAR) AS patient, 'd' || (doc_id % 90) AS document_id,
    CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS chunk_level, left(coalesce(text, ''), 40) AS section_path FROM documents"""
_QS = f"""SELECT *, CASE WHEN patient IS NULL OR NOT marker THEN 'public' WHEN len(terms) > 0 OR n_drugs > 0 THEN 'both' ELSE 'patient' END AS domain FROM (SELECT item_id AS query_id, text, CASE WHEN item_id % 4 > 0 THEN CAST(item_id % 5 AS VARCHAR) END AS patient, contains(text, 'el') OR contains(text, 'ta') AS marker, {_has("text", LEX)} AS terms, 0 AS n_drugs FROM benchmark)"""


def _funnel_sql(tail: str) -> str:
    out = f"WITH c AS ({_C}), q AS ({_QS})"
    for name, domain, scope in (("p", "public", "'all'"), ("r", "patient", "patient")):
        docs = f"SELECT doc_id, text, {_has('text', LEX)} AS tags, {scope} AS scope FROM c WHERE chunk_level = 3 AND domain = '{domain}'"
        qs = f"SELECT query_id, text, terms AS tags, {scope} AS scope FROM q WHERE domain IN ('{domain}', 'both')"
        out += f""", {_scored_sql(name, docs, qs, True, True)},
            {name}n AS (SELECT query_id, document_id FROM (SELECT query_id, document_id, min(doc_id) AS pos FROM (SELECT * FROM q WHERE domain IN ('{domain}', 'both')) qq JOIN c ON c.domain = '{domain}' AND c.chunk_level IN (1, 2) AND len(list_filter(qq.terms, lambda t: contains(c.section_path, t))) > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, document_id) <= 100),
            {name}h AS (SELECT f.query_id, f.doc_id, f.score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.doc_id) AS rank FROM {name}f f JOIN c USING (doc_id) LEFT JOIN {name}n n ON n.query_id = f.query_id AND n.document_id = c.document_id WHERE n.query_id IS NOT NULL OR f.query_id NOT IN (SELECT query_id FROM {name}n) QUALIFY rank <= {_N})"""
    return out + f""", u AS (SELECT query_id, doc_id, score, (0, rank) AS pos FROM ph UNION ALL SELECT query_id, doc_id, score, (1, rank) FROM rh),
        m AS (SELECT query_id, doc_id, max(score) AS score, min(pos) AS pos FROM u GROUP BY ALL), o AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM m) {tail}"""


_SUBS = rf"""w AS (SELECT item_id AS query_id, {retrieval._W.format("text")} AS w FROM benchmark), sb AS (SELECT query_id, i AS sub_id, CASE WHEN i = 0 THEN array_to_string(w[1 : len(w) // 2], ' ') ELSE array_to_string(w[len(w) // 2 + 1 :], ' ') END AS text,
    CASE WHEN query_id % 7 = 0 AND (i = 1 OR query_id % 14 = 0) THEN 'error' ELSE 'ok' END AS status FROM w, unnest([0, 1]) AS t(i))"""
_FAN = f"""WITH {_SUBS}, {retrieval.bm25_sql("h", _D, "SELECT query_id * 2 + sub_id AS query_id, text FROM sb WHERE status = 'ok'", 3)},
    g AS (SELECT query_id // 2 AS query_id, doc_id, max(score) AS score, min((query_id % 2, rank)) AS pos FROM h GROUP BY ALL), dd AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM g),
    b AS (SELECT query_id, count(*) AS branches, count(*) FILTER (status = 'error') AS failed FROM sb GROUP BY 1), n AS (SELECT query_id, count(*) AS documents FROM dd GROUP BY 1),
    z AS (SELECT query_id, branches, failed, coalesce(documents, 0) AS documents FROM b LEFT JOIN n USING (query_id)),
    y AS (SELECT *, CASE WHEN documents > 0 THEN 'parallel_synthesis' ELSE 'no_results' END AS mode, failed > 0 OR documents = 0 AS degraded, CASE WHEN failed > 0 AND failed = branches THEN 'all_sub_agents_failed' WHEN documents = 0 THEN 'all_sub_agents_empty' WHEN failed > 0 THEN 'partial_sub_agent_failure' ELSE '' END AS reason FROM z)"""
_QQ = "SELECT item_id AS query_id FROM benchmark"
SQL = {
    "rt3_hybrid": f"""WITH {_both_sql(2 * _N)}, {_fuse_sql("f", _ES, 3 * _N)},
        v AS (SELECT f.*, source || '|' || lang || '|' || (n_chars % 11) AS doc_key, doc_id % 4 AS version FROM f JOIN documents USING (doc_id)),
        n AS (SELECT *, min(rank) OVER (PARTITION BY query_id, doc_key) AS slot FROM v QUALIFY row_number() OVER (PARTITION BY query_id, doc_key ORDER BY version DESC, rank) = 1)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY slot) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY slot) <= {_N}""",
    "rt4_modes": f"""WITH {_both_sql(20)}, {_fuse_sql("f", _ES, 20)},
        x AS (SELECT f.query_id, f.doc_id, coalesce(CASE WHEN s.doc_id IS NOT NULL AND f.doc_id % 3 > 0 THEN (f.doc_id * 7919) % 1000 / 1000.0::DOUBLE END, f.score) AS score FROM f LEFT JOIN s USING (query_id, doc_id)),
        xr AS (SELECT *, {_R} FROM x QUALIFY rank <= {_N})
        SELECT 'bm25' AS mode, query_id, doc_id, score, rank FROM s WHERE rank <= {_N} UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM e WHERE rank <= {_N}
        UNION ALL SELECT 'hybrid', query_id, doc_id, score, rank FROM f WHERE rank <= {_N} UNION ALL SELECT 'hybrid_rerank', query_id, doc_id, score, rank FROM xr""",
    "rt8_ladder": f"""WITH {_both_sql(2 * _N)}, {_fuse_sql("f", _ES, 3 * _N)}, """
    + _ladder_sql(["hybrid", "dense_fallback", "sparse_fallback"], [f"SELECT * FROM f WHERE rank <= {_N} AND score > 0.0325", "SELECT * FROM e WHERE score > 0.45", "SELECT * FROM s WHERE score > 40"], _QQ),
    "rt9_patient_ladder": f"""WITH {_dense_sql("ea", 1_000_000)}, e AS (SELECT query_id, doc_id, score, {_R} FROM (SELECT query_id, doc_id, score FROM ea WHERE doc_id % 7 = query_id % 9) QUALIFY rank <= {2 * _N}),
        {_scored_sql("sa", "SELECT doc_id, coalesce(text, '') AS text, doc_id % 7 AS scope FROM documents", "SELECT item_id AS query_id, text, item_id % 9 AS scope FROM benchmark", False, True)},
        s AS (SELECT query_id, doc_id, score, {_R} FROM saf QUALIFY rank <= {2 * _N}), t AS (SELECT * FROM s WHERE score > 12),
        {_fuse_sql("f", "SELECT query_id, doc_id, rank FROM e WHERE score > 0.4 UNION ALL SELECT query_id, doc_id, rank FROM t", _N)}, """
    + _ladder_sql(["hybrid", "dense", "sparse"], ["SELECT * FROM f WHERE score > 0.032", "SELECT * FROM e WHERE score > 0.42", "SELECT * FROM t"], _QQ),
    "rt10_funnel": _funnel_sql("SELECT query_id, doc_id, score, rank FROM o"),
    "rt10_trace": _funnel_sql(
        ", k AS (SELECT query_id, count(*) AS n FROM o GROUP BY 1) SELECT query_id, domain, marker AS patient_marker, array_to_string(terms, ',') AS terms, coalesce(n, 0) AS n, n IS NULL AS degraded, domain = 'public' AND marker AS final_public_fallback FROM q LEFT JOIN k USING (query_id)"
    ),
    "fl3_documents": "WITH t AS (SELECT * FROM (VALUES (1, 'license'), (2, 'ana'), (2, 'der ')) AS t(query_id, term)), m AS (SELECT query_id, 'd' || (doc_id % 300) AS document_id, min(doc_id) AS pos FROM documents JOIN t ON contains(text, term) WHERE doc_id % 4 IN (1, 2) GROUP BY ALL) SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY pos, document_id) AS rank FROM m QUALIFY rank <= 30",
    "fl6_verified": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "rt16_fan_in": f"{_FAN} SELECT query_id, doc_id, score, rank, mode, reason FROM dd JOIN y USING (query_id)",
    "st2_fan_summary": f"{_FAN} SELECT query_id, branches, failed, documents, mode, degraded, reason FROM y",
    "rt15_expanded": f"""WITH {_both_sql(3)}, u AS (SELECT query_id, doc_id, score, (0, rank) AS pos FROM e WHERE query_id % 4 IN (0, 2) UNION ALL SELECT query_id, doc_id, score, (1, rank) FROM s WHERE query_id % 4 IN (1, 2, 3)),
        m AS (SELECT query_id, doc_id, max(score) AS score, min(pos) AS pos FROM u GROUP BY ALL) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM m""",
    "rt11_memory": "WITH c AS (SELECT * FROM conversations WHERE text IS NOT NULL), l AS (SELECT conv_id, max(turn) AS turn FROM c WHERE role = 'user' GROUP BY 1), "
    + _scored_sql("m", "SELECT conv_id * 100 + turn AS doc_id, text, conv_id AS scope FROM c ANTI JOIN l USING (conv_id, turn)", "SELECT conv_id AS query_id, text, conv_id AS scope FROM c JOIN l USING (conv_id, turn)", False, True)
    + f" SELECT query_id, doc_id, score, {_R} FROM mf QUALIFY rank <= 3",
    "tk2_over_fetch": f"""WITH {_both_sql(2 * _N)}, {_fuse_sql("f", _ES, 3 * _N)}, v AS (SELECT f.query_id, f.doc_id, f.rank, source FROM f JOIN documents USING (doc_id)), n AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n.rank) <= {_N}""",
}
