"""Rows to chunks, lookups and deletes by id, vectors to be made, and results written with their manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import sanitize
from ledgerloom.functions.tables import read, small
from ledgerloom.functions.text import fingerprint
from ledgerloom.operators.chunking import windows

#: Fields that a manifest must have.
MANIFEST = ["dataset_hash", "config", "command", "commit", "schema_version", "summary"]


def question_chunks(rows: DataFrame, source: str, size: int = 1800, overlap: int = 120) -> DataFrame:
    """rows (n, question, answer): chunks of `问题：…\\n答案：…`, or of the question alone, with ids `source::qa::n::i`. Rows with neither give none."""
    q, a = (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("question", "answer"))
    text = F.when(a != "", F.concat(F.lit("问题："), q, F.lit("\n答案："), a)).otherwise(q)
    out = rows.where((q != "") | (a != "")).select("n", q.alias("qa_question"), F.left(a, F.lit(1500)).alias("qa_answer"), F.posexplode(windows(text, size, overlap)).alias("i", "text"))
    id_ = F.concat_ws("::", F.lit(source), F.lit("qa"), F.col("n").cast("string"), F.col("i").cast("string"))
    return out.select("n", id_.alias("chunk_id"), F.trim("text").alias("text"), "qa_question", "qa_answer").where("text <> ''")


def textbook_chunks(rows: DataFrame, dataset: str, size: int = 1200, overlap: int = 120) -> DataFrame:
    """rows (id, title, content): chunks with the record as parent and root, and a hash of record and text. Content is sanitized first."""
    safe = dataset.replace("/", "_").replace("\\", "_")
    r = rows.select(sanitize(F.col("id").cast("string")).alias("id"), F.coalesce(F.nullif(sanitize(F.col("title")), F.lit("")), F.lit(dataset)).alias("title"), F.trim(sanitize(F.col("content"))).alias("content"))
    out = r.select("id", "title", F.posexplode(windows(F.col("content"), size, overlap)).alias("i", "text")).withColumn("text", F.trim("text")).where("text <> ''")
    root = F.concat_ws("::", F.lit(safe), "id")
    return out.select(F.concat_ws("::", root, F.col("i").cast("string")).alias("chunk_id"), root.alias("parent_chunk_id"), F.left("title", F.lit(255)).alias("filename"), F.col("i").cast("bigint").alias("chunk_idx"), "text", F.left(fingerprint(F.col("id"), F.col("text")), F.lit(20)).alias("source_hash"))


def shuffled(rows: DataFrame, id_: str, seed: int) -> DataFrame:
    """Rows in an order that depends only on the seed and their ids. A range partitioning sorts it; nothing is gathered."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_)), id_)


def scanned(rows: DataFrame, predicate: Column | None, fields: list[str]) -> DataFrame:
    """All rows that fit, with the fields; predicate and columns reach the scan."""
    return (rows.where(predicate) if predicate is not None else rows).select(*fields)


def looked_up(rows: DataFrame, ids: DataFrame, key: str, scope: Column | None = None) -> DataFrame:
    """ids (pos, key): the rows of the ids, in the ids' order, with `pos`; ids that don't exist, or aren't in scope, give none; blank ids neither."""
    asked = ids.select("pos", F.trim(F.col(key)).alias(key)).where(F.col(key) != "")
    return (rows.where(scope) if scope is not None else rows).join(small(asked), key).orderBy("pos")


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of the given keys, such as a filename, or a document with tenant and patient."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def deleted_everywhere(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The same deletion in several tables (documents, chunks, vectors). Write all results before the old ones are replaced."""
    return {name: deleted(t, gone, keys) for name, t in tables.items()}


def with_vectors(rows: DataFrame, vectors: DataFrame, key: str, embed) -> DataFrame:
    """rows (key, text) with `embedding` and `reused`: from vectors (key, embedding) where there is one, else `embed(text)`, which is evaluated for those rows only."""
    known = rows.join(vectors.select(key, F.col("embedding").alias("_v")), key, "left")
    return known.withColumn("embedding", F.when(F.col("_v").isNotNull(), F.col("_v")).otherwise(embed(F.col("text")))).withColumn("reused", F.col("_v").isNotNull()).drop("_v")


def export_cases(cases: DataFrame, path: str) -> None:
    """Approved cases as JSON lines, ordered by external id. Files are ordered ranges; nothing is gathered in one task."""
    cases.where("status = 'approved'").orderBy("external_id").write.mode("overwrite").json(path)


def manifest_errors(manifest: dict, records: DataFrame, keys: list[str]) -> list[str]:
    """What is missing in a manifest, and which metrics no record has; numbers on the driver only."""
    errors = [f"missing field: {f}" for f in MANIFEST if f not in manifest]
    have = records.agg(F.count("*").alias("n"), *[F.count(k).alias(k) for k in keys if k in records.columns]).first()
    if not have["n"]:
        errors.append("no records")
    return errors + [f"metric without values: {k}" for k in keys if k not in records.columns or not have[k]]


def write_experiment(path: str, manifest: dict, records: DataFrame, summary: DataFrame) -> None:
    """Records as JSON lines, the summary as JSON and CSV, and the manifest as one JSON line, in folders of their own."""
    spark = records.sparkSession
    records.write.mode("overwrite").json(f"{path}/records")
    summary.write.mode("overwrite").json(f"{path}/summary")
    summary.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/comparison")  # a row for each baseline
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def sc12_questions(spark, d):
    n = F.col("doc_id")
    r = read(spark, d, "documents").select(n.alias("n"), F.when(n % 3 > 0, F.concat(F.lit(" q"), n)).alias("question"), F.when(n % 2 == 0, F.trim(F.regexp_replace("text", r"\s+", " "))).alias("answer"))
    return question_chunks(r, "src").select("chunk_id", F.sha2("text", 256).alias("sha"), "qa_question", F.length("qa_answer").cast("bigint").alias("n_answer"))


def sc13_textbooks(spark, d):
    r = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("content"))
    return textbook_chunks(r, "books/one").select("chunk_id", "parent_chunk_id", "filename", "chunk_idx", F.sha2("text", 256).alias("sha"), "source_hash")


def sc14_shuffled(spark, d):
    """The set of rows stays the same in any order."""
    return shuffled(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


def sc18_scan(spark, d):
    return scanned(read(spark, d, "embeddings"), F.col("label").isin(1, 4), ["vec_id", "label"])


def sc19_lookup(spark, d):
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("pos"), F.when(F.col("id") % 2 == 0, (F.col("id") % 700).cast("string")).otherwise(" ").alias("key"))
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang", "source")
    return looked_up(rows, ids, "key").select("pos", "key", "lang")


def sc23_parents(spark, d):
    ids = spark.range(0, 2000, 3).select(F.col("id").alias("pos"), (F.col("id") % 500).cast("string").alias("key"))
    rows = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("key"), "lang", (F.col("doc_id") % 4).alias("tenant_id"))
    return looked_up(rows, ids, "key", F.col("tenant_id") == 1).select("pos", "key", "lang")


def sc24_deleted(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", "lang")
    return deleted(docs, docs.where("doc_id % 9 = 0").select("source", "lang").limit(1).unionByName(docs.where("doc_id = 5").select("source", "lang")).where("1 = 0").unionByName(docs.where("doc_id = 3").select("source", "lang")), ["source", "lang"])


def iv7_deleted(spark, d):
    o, l, c = (read(spark, d, t) for t in ("orders", "lineitem", "customer"))
    key = "k"
    tables = {"orders": o.select(F.col("o_orderkey").alias(key)), "lineitem": l.select(F.col("l_orderkey").alias(key)), "customer": c.select(F.col("c_custkey").alias(key))}
    out = deleted_everywhere(tables, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias(key)), [key])
    rows = None
    for name, t in out.items():
        one = t.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("total"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def sc20_vectors(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    v = read(spark, d, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    out = with_vectors(docs, v, "k", lambda t: F.array(F.length(t).cast("double")))
    return out.select("k", "reused", F.size("embedding").alias("dim"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


QUERIES = {f.__name__: f for f in (sc12_questions, sc13_textbooks, sc14_shuffled, sc18_scan, sc19_lookup, sc20_vectors, sc23_parents, sc24_deleted, iv7_deleted)}
_T = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_cut = lambda size, step: f"unnest(range(0, greatest(ceil((length(t) - {size}) / {step}.0), 0)::BIGINT + 1)) AS u(i)"
SQL = {
    "sc12_questions": f"""
        WITH r AS (SELECT doc_id AS n, CASE WHEN doc_id % 3 > 0 THEN 'q' || doc_id ELSE '' END AS q, CASE WHEN doc_id % 2 = 0 THEN {_T} ELSE '' END AS a FROM documents),
        x AS (SELECT *, CASE WHEN a <> '' THEN '问题：' || q || chr(10) || '答案：' || a ELSE q END AS t FROM r WHERE q <> '' OR a <> '')
        SELECT 'src::qa::' || n || '::' || i AS chunk_id, sha256(trim(substr(t, i * 1680 + 1, 1800))) AS sha, q AS qa_question, length(left(a, 1500)) AS n_answer FROM x, {_cut(1800, 1680)} WHERE trim(substr(t, i * 1680 + 1, 1800)) <> ''""",
    "sc13_textbooks": f"""
        WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'books/one' END AS title, {_T} AS t FROM documents), c AS (SELECT doc_id, title, i, trim(substr(t, i * 1080 + 1, 1200)) AS c FROM x, {_cut(1200, 1080)} WHERE t <> '')
        SELECT 'books_one::' || doc_id || '::' || i AS chunk_id, 'books_one::' || doc_id AS parent_chunk_id, left(title, 255) AS filename, i AS chunk_idx, sha256(c) AS sha, left(sha256(doc_id || chr(31) || c), 20) AS source_hash FROM c WHERE c <> ''""",
    "sc14_shuffled": "SELECT o_orderkey FROM orders",
    "sc18_scan": "SELECT vec_id, label FROM embeddings WHERE label IN (1, 4)",
    "sc19_lookup": "SELECT i AS pos, CAST(doc_id AS VARCHAR) AS key, lang FROM range(0, 3000, 7) AS t(i) JOIN documents ON doc_id = i % 700 WHERE i % 2 = 0",
    "sc20_vectors": "SELECT doc_id AS k, vec_id IS NOT NULL AS reused, CASE WHEN vec_id IS NOT NULL THEN len(embedding) ELSE 1 END AS dim, round(CASE WHEN vec_id IS NOT NULL THEN embedding[1]::DOUBLE ELSE length(coalesce(text, '')) END, 6) AS first FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) ON vec_id = doc_id",
    "sc23_parents": "SELECT i AS pos, CAST(doc_id AS VARCHAR) AS key, lang FROM range(0, 2000, 3) AS t(i) JOIN documents ON doc_id = i % 500 WHERE doc_id % 4 = 1",
    "sc24_deleted": "SELECT doc_id, source, lang FROM documents WHERE (source, lang) NOT IN (SELECT (source, lang) FROM documents WHERE doc_id = 3)",
    "iv7_deleted": """
        WITH g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'orders' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders WHERE o_orderkey NOT IN (SELECT k FROM g)
        UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM g) UNION ALL SELECT 'customer', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT k FROM g)""",
}
