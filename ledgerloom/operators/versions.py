"""Incremental maintenance of versioned indexes: reuse by fingerprint, applying versions, rollback, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.storage import saved
from ledgerloom.functions.tables import dealt, read


def reuse_plan(new: DataFrame, old: DataFrame, normalization: str | None = None) -> DataFrame:
    """new (chunk_id, fingerprint), old (old_id, fingerprint): the n-th new chunk of a fingerprint takes the vector of the n-th old one.

    With `normalization`, old rows must also have (normalization, vector), and count only with this normalization and a vector that isn't empty.
    Occurrences are numbered within a fingerprint; a very common one is numbered by a window of its own rows.
    """
    if normalization is not None:
        old = old.where((F.col("normalization") == normalization) & (F.size("vector") > 0)).select("old_id", "fingerprint")
    nth = lambda c: F.row_number().over(Window.partitionBy("fingerprint").orderBy(c))
    a, b = new.withColumn("nth", nth("chunk_id")), old.withColumn("nth", nth("old_id"))
    return a.join(b, ["fingerprint", "nth"], "left").select("chunk_id", "fingerprint", "old_id", F.col("old_id").isNotNull().alias("reused"))


def reuse_counts(plan: DataFrame) -> DataFrame:
    """One row: chunks that take an old vector, and those to embed."""
    return plan.agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("embedded"))


def apply_version(active: DataFrame, archive: DataFrame, new: DataFrame, now: Column, retention_days: int) -> tuple[DataFrame, DataFrame]:
    """(active, archive) after new versions of documents.

    active and new (document_id, version, chunk_id, fingerprint, content_sha), archive with retention_until as well. A document
    whose content is the same stays as it is; a changed one's old chunks are archived and its new ones become the next version. Both
    tables are dealt together by document in tasks of bounded rows, and written once with what becomes of each row; this runs when it is called.
    """
    both = active.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    rows, own = active.count() + new.count(), Window.partitionBy("document_id")
    old = lambda c: F.max(F.when(~F.col("_new"), F.col(c))).over(own)
    both = dealt(both, "document_id", rows).withColumns({"_current": old("version"), "_old": old("content_sha")})
    both = both.withColumn("_changed", F.coalesce(F.max(F.when(F.col("_new"), ~F.col("content_sha").eqNullSafe(F.col("_old")))).over(own), F.lit(False)) & F.col("document_id").isNotNull())
    both = saved(both, "versions")
    incoming = both.where(F.col("_new") & F.col("_changed")).withColumn("version", F.coalesce("_current", F.lit(0)) + 1)
    staying, leaving = both.where(~F.col("_new") & ~F.col("_changed")), both.where(~F.col("_new") & F.col("_changed"))
    leaving = leaving.withColumn("retention_until", F.date_add(now.cast("date"), retention_days))
    return staying.select(*active.columns).unionByName(incoming.select(*active.columns)), archive.unionByName(leaving.select(*archive.columns))


def rollback(active: DataFrame, archive: DataFrame, targets: DataFrame) -> DataFrame:
    """Active rows after the documents of targets (document_id, version) went back; targets without archived rows change nothing."""
    back = archive.join(targets, ["document_id", "version"])
    return active.join(back.select("document_id").distinct(), "document_id", "left_anti").unionByName(back.select(*active.columns))


def expired(versions: DataFrame, documents: DataFrame, now: Column, limit: int) -> DataFrame:
    """Superseded or deleted versions past their retention, the oldest `limit`."""
    gone = versions.where(F.col("status").isin("superseded", "deleted") & (F.col("retention_until") <= now))
    return gone.join(documents, "document_id").orderBy("retention_until", "document_id", "version").limit(limit)


def purge(archive: DataFrame, gone: DataFrame) -> DataFrame:
    return archive.join(gone.select("document_id", "version").distinct(), ["document_id", "version"], "left_anti")


def import_plan(old: DataFrame, new: DataFrame, key: list[str], sha: str) -> DataFrame:
    """key and action of each row: insert, update where the hash changed, unchanged, or absent from the new ones."""
    both = old.select(*key, F.col(sha).alias("old_sha")).join(new.select(*key, F.col(sha).alias("new_sha")), key, "full_outer")
    return both.select(*key, F.when(F.col("old_sha").isNull(), "insert").when(F.col("new_sha").isNull(), "absent").when(F.col("old_sha") == F.col("new_sha"), "unchanged").otherwise("update").alias("action"))


def stratified_split(cases: DataFrame, stratum: list[str], id_: str, pilot: int, seed: str) -> DataFrame:
    """`cases` with `pilot` true for exactly `pilot` of them: quotas by largest remainder, members by a hash of the id.

    The window over quotas has one row for each stratum, not for each case.
    """
    sizes = cases.groupBy(*stratum).agg(F.count("*").alias("n"))
    total = cases.count()
    exact = F.col("n") * F.lit(pilot / total)
    quota = sizes.withColumn("q", F.floor(exact)).withColumn("fraction", F.round(exact - F.floor(exact), 9))
    over = Window.orderBy(F.desc("fraction"), *stratum)
    left = F.lit(pilot) - F.sum("q").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    quota = quota.withColumn("q", F.col("q") + (F.row_number().over(over) <= left).cast("int")).select(*stratum, "q")
    place = F.row_number().over(Window.partitionBy(*stratum).orderBy(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(id_)), 256)))
    return cases.withColumn("place", place).join(quota, stratum).withColumn("pilot", F.col("place") <= F.col("q")).drop("place", "q")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `old` whose key `new` doesn't have, and `new`."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def archive_dedup(rows: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Of rows with one key: the last one's values at the first one's position."""
    values = [c for c in rows.columns if c not in (*key, pos)]
    g = rows.groupBy(*key).agg(F.min(pos).alias("_pos"), F.max_by(F.struct(*values), pos).alias("_v"))
    return g.select(*key, F.col("_pos").alias(pos), *[F.col(f"_v.{c}").alias(c) for c in values])


def _chunks(spark, d, year):
    o = read(spark, d, "orders").where(F.year("o_orderdate") == year)
    return o.select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("version"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("fingerprint"))


def _with_sha(c):
    prints = F.collect_list("fingerprint").over(Window.partitionBy("document_id"))
    sha = F.sha2(F.array_join(F.sort_array(prints), "|"), 256).alias("content_sha")
    return dealt(c, "document_id", c.count()).select("document_id", "version", "chunk_id", "fingerprint", sha)


def j3_reuse_plan(spark, d):
    f = lambda y: _chunks(spark, d, y).select("chunk_id", F.concat_ws("|", "document_id", "fingerprint").alias("fingerprint"))
    return reuse_plan(f(1996), f(1995).withColumnRenamed("chunk_id", "old_id"))


def iv2_counts(spark, d):
    f = lambda y: _chunks(spark, d, y).select("chunk_id", F.concat_ws("|", "document_id", "fingerprint").alias("fingerprint"))
    old = f(1995).withColumnRenamed("chunk_id", "old_id").withColumn("normalization", F.when(F.col("old_id") % 3 > 0, "v1").otherwise("v0"))
    old = old.withColumn("vector", F.when(F.col("old_id") % 4 > 0, F.array(F.lit(1.0))).when(F.col("old_id") % 8 == 0, F.array().cast("array<double>")))
    return reuse_counts(reuse_plan(f(1996), old, "v1"))


def iv3_apply(spark, d):
    active, new = _with_sha(_chunks(spark, d, 1995)), _with_sha(_chunks(spark, d, 1996))
    none = active.withColumn("retention_until", F.lit(None).cast("date")).limit(0)
    a, b = apply_version(active, none, new, F.lit("1997-01-01"), 30)
    out = a.select("document_id", "version", "chunk_id", F.lit("active").alias("state"), F.lit(None).cast("string").alias("until"))
    return out.unionByName(b.select("document_id", "version", "chunk_id", F.lit("archived").alias("state"), F.col("retention_until").cast("string").alias("until")))


def iv6_gc(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), "c_name")
    v = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("status"), F.date_add("o_orderdate", 30).alias("retention_until"))
    return expired(v, c, F.lit("1995-06-01").cast("date"), 200).select("document_id", "version", "c_name")


def iv8_golden_import(spark, d):
    f = lambda y: read(spark, d, "orders").where(F.year("o_orderdate") == y).groupBy("o_custkey").agg(F.sha2(F.max("o_orderpriority"), 256).alias("sha"))
    return import_plan(f(1995), f(1996), ["o_custkey"], "sha")


def wn6_stratified_split(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_nationkey") % 3).alias("band"))
    return stratified_split(c, ["c_mktsegment", "band"], "c_custkey", 100, "seed")


def sc22_upsert(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return upsert(c, c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")), "c_custkey")


def wn11_archive_dedup(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return archive_dedup(o, ["o_custkey", "o_orderpriority"], "o_orderkey")


QUERIES = {f.__name__: f for f in (j3_reuse_plan, iv2_counts, iv3_apply, iv6_gc, iv8_golden_import, wn6_stratified_split, sc22_upsert, wn11_archive_dedup)}
_C = "SELECT o_custkey AS document_id, o_orderkey AS chunk_id, o_orderpriority AS fingerprint FROM orders WHERE year(o_orderdate) = "
SQL = {
    "j3_reuse_plan": f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY chunk_id) AS nth FROM ({_C} 1996)), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY chunk_id) AS nth FROM ({_C} 1995)) SELECT n.chunk_id, n.document_id || '|' || n.fingerprint AS fingerprint, o.chunk_id AS old_id, o.chunk_id IS NOT NULL AS reused FROM n LEFT JOIN o USING (document_id, fingerprint, nth)",
    "iv2_counts": f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY chunk_id) AS nth FROM ({_C} 1996)), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, fingerprint ORDER BY chunk_id) AS nth FROM ({_C} 1995) WHERE chunk_id % 3 > 0 AND chunk_id % 4 > 0) SELECT count(o.chunk_id) AS reused, count(*) - count(o.chunk_id) AS embedded FROM n LEFT JOIN o USING (document_id, fingerprint, nth)",
    "iv3_apply": f"""
        WITH o AS ({_C} 1995), n AS ({_C} 1996), os AS (SELECT document_id, string_agg(fingerprint, '|' ORDER BY fingerprint) AS s FROM o GROUP BY 1), ns AS (SELECT document_id, string_agg(fingerprint, '|' ORDER BY fingerprint) AS s FROM n GROUP BY 1),
        ch AS (SELECT document_id, os.s IS NULL AS fresh FROM ns LEFT JOIN os USING (document_id) WHERE ns.s IS DISTINCT FROM os.s)
        SELECT document_id, 1 AS version, chunk_id, 'active' AS state, NULL AS until FROM o ANTI JOIN ch USING (document_id)
        UNION ALL SELECT document_id, CASE WHEN fresh THEN 1 ELSE 2 END, chunk_id, 'active', NULL FROM n JOIN ch USING (document_id)
        UNION ALL SELECT document_id, 1, chunk_id, 'archived', '1997-01-31' FROM o SEMI JOIN ch USING (document_id)""",
    "iv6_gc": "SELECT o_custkey AS document_id, o_orderkey AS version, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND CAST(o_orderdate AS DATE) + 30 <= DATE '1995-06-01' ORDER BY CAST(o_orderdate AS DATE), o_custkey, o_orderkey LIMIT 200",
    "iv8_golden_import": "WITH a AS (SELECT o_custkey, max(o_orderpriority) AS s FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), b AS (SELECT o_custkey, max(o_orderpriority) AS s FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) SELECT o_custkey, CASE WHEN a.s IS NULL THEN 'insert' WHEN b.s IS NULL THEN 'absent' WHEN a.s = b.s THEN 'unchanged' ELSE 'update' END AS action FROM a FULL JOIN b USING (o_custkey)",
    "wn6_stratified_split": """
        WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey % 3 AS band FROM customer), t AS (SELECT count(*) AS t FROM c),
        s AS (SELECT c_mktsegment, band, count(*) * (100.0::DOUBLE / any_value(t)) AS e FROM c, t GROUP BY ALL), f AS (SELECT *, floor(e) AS q, round(e - floor(e), 9) AS r FROM s),
        q AS (SELECT c_mktsegment, band, q + CASE WHEN row_number() OVER (ORDER BY r DESC, c_mktsegment, band) <= 100 - sum(q) OVER () THEN 1 ELSE 0 END AS q FROM f)
        SELECT c_custkey, c_mktsegment, band, row_number() OVER (PARTITION BY c_mktsegment, band ORDER BY sha256('seed:' || c_custkey)) <= q AS pilot FROM c JOIN q USING (c_mktsegment, band)""",
    "sc22_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer",
    "wn11_archive_dedup": "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL",
}
