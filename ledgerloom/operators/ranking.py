"""Orders, caps, merges and set comparisons; joins of records with their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.operators.prefix import running_before
from ledgerloom.operators.retrieval import ranked


def effective(score: Column, rerank: Column) -> Column:
    return F.coalesce(rerank, score, F.lit(0.0))


def pool_size(k: Column, wanted: Column) -> Column:
    """Candidates to fetch: what is asked for, at least k; else three times k."""
    return F.when(wanted.isNotNull(), F.greatest(wanted, k)).otherwise(k * 3)


def first_seen(rankings: list[DataFrame], k: int) -> DataFrame:
    """Several rankings (query_id, doc_id, rank) merged by first appearance, list after list."""
    out = None
    for i, r in enumerate(rankings):
        rows = r.select("query_id", "doc_id", F.struct(F.lit(i).alias("list"), "rank").alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return ranked(out.groupBy("query_id", "doc_id").agg(F.min("at").alias("at")), k, F.asc("at"))


def rank_places(places: DataFrame, department: str) -> DataFrame:
    """places (owner, name, departments, distance): matching department first, unknown distances last, a distance of zero counts as very far."""
    far = F.when(F.col("distance") == 0, 1e9).otherwise(F.col("distance"))
    return ranked(places, None, F.desc(F.contains("departments", F.lit(department))), F.col("distance").isNull().asc(), far.asc(), F.asc("name"), by=("owner",))


def budget(parts: DataFrame, by: str, pos: str, most: int) -> DataFrame:
    """Parts (text) of each owner in order until `most` characters; the last one is cut, and those after it go. An owner of any size is in many tasks."""
    near = running_before(parts, by, pos, F.coalesce(F.length("text"), F.lit(0)), "_before", below=most)
    return near.withColumn("text", F.left("text", (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")


def first_distinct(items: Column, most: int = 5) -> Column:
    return F.slice(F.array_distinct(F.array_compact(items)), 1, most)


def _grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))


def fuzzy(names: DataFrame, terms: DataFrame, most: int = 3, gram: int = 4) -> DataFrame:
    """terms (term) with up to `most` names (name) each that contain them or are contained in them, the longest first.

    Of two texts of which one contains the other, the longer has the shorter one's first `gram` characters among its n-grams: that is an equi-join,
    in both directions; texts shorter than `gram` are looked up by all grams of their own length. `contains` decides.
    """
    a, b = names.select("name").distinct(), terms.select("term").distinct()

    def inside(short: DataFrame, s: str, long: DataFrame, l: str) -> DataFrame:
        sizes = [r[0] for r in short.where(F.length(s) > 0).select(F.least(F.length(s), F.lit(gram)).alias("n")).distinct().collect()]  # `gram` sizes at most
        heads = short.where(F.length(s) > 0).select(s, F.left(s, F.lit(gram)).alias("_g"))
        grams = F.array_distinct(F.flatten(F.array(*[_grams(F.col(l), n) for n in sizes]))) if sizes else F.array().cast("array<string>")
        return heads.join(long.select(l, F.explode(grams).alias("_g")), "_g").where(F.contains(l, s)).select("term", "name")

    both = inside(b, "term", a, "name").union(inside(a, "name", b, "term")).distinct()
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc(F.length("name")), "name"))).where(F.col("rank") <= most)


def missing_rows(have: DataFrame, want: DataFrame, keys: list[str]) -> DataFrame:
    """`have` and the rows of `want` whose key it lacks, one for each key."""
    new = want.join(have.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
    return have.unionByName(new)


def deliveries(rows: DataFrame, notifications: DataFrame, consent: DataFrame) -> DataFrame:
    """rows (delivery_id, notification_id, user): send, or why not."""
    out = rows.join(notifications.select("notification_id", F.lit(True).alias("_n")), "notification_id", "left").join(consent.select("user", F.col("ok").alias("_ok")), "user", "left")
    return out.select("delivery_id", F.when(F.col("_n").isNull(), "missing_notification").when(F.coalesce("_ok", F.lit(False)), "send").otherwise("no_consent").alias("outcome"))


def owners_backfill(users: DataFrame, patients: DataFrame, members: DataFrame) -> DataFrame:
    """Memberships (tenant, user), and one for each patient's owner that has none in the patient's tenant."""
    owners = patients.join(users, "user", "left_semi").select("tenant", "user").distinct()
    return members.unionByName(owners.join(members, ["tenant", "user"], "left_anti"))


def finite_means(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Mean of the finite values, and their number."""
    ok = lambda m: F.when(~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
    return df.groupBy(by).agg(*[x for m in metrics for x in (F.round(F.avg(ok(m)), 6).alias(m), F.count(ok(m)).alias(f"n_{m}"))])


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def overlap(a: Column, b: Column) -> Column:
    """Whether at least a fifth of the distinct characters of b occur in a."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(chars(a), chars(b))), F.size(chars(b))) >= 0.2, F.lit(False))


def trace_merge(steps: DataFrame, by: str, pos: str) -> DataFrame:
    """Counters add up, flags are or-ed, settings keep their first value that isn't null."""
    return steps.groupBy(by).agg(F.sum("counter").alias("counter"), F.bool_or("flag").alias("flag"), F.min_by("setting", F.when(F.col("setting").isNotNull(), F.col(pos))).alias("setting"))


def _ev(spark, d):
    return read(spark, d, "events")


def wn4_effective_order(spark, d):
    e = _ev(spark, d)
    hits = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), effective(F.when(F.col("event_type") != "view", F.col("value")), F.when(F.col("event_id") % 3 == 0, F.col("value") / 2)).alias("score"))
    return ranked(hits, 5)


def wn9_first_seen(spark, d):
    e = _ev(spark, d)
    r = lambda t: ranked(e.where(F.col("event_type") == t).groupBy(F.col("user_id").alias("query_id"), (F.col("event_id") % 40).alias("doc_id")).agg(F.max("value").alias("score")), 10)
    return first_seen([r("click"), r("view")], 12).select("query_id", "doc_id", "rank")


def wn10_poi_rank(spark, d):
    s = read(spark, d, "supplier")
    places = s.select(F.col("s_nationkey").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "eye,skin").otherwise("bone").alias("departments"), F.when(F.col("s_suppkey") % 5 > 0, F.greatest(F.round("s_acctbal", 0), F.lit(0.0))).alias("distance"))
    return rank_places(places, "skin").select("owner", "name", "rank")


def wn12_budget(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "text")
    return budget(docs, "source", "doc_id", 16000).select("source", "doc_id", F.length("text").cast("bigint").alias("n"))


def wn13_plan_cap(spark, d):
    e = _ev(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("event_id") % 7).alias("tool")))).alias("s"))
    tools = F.transform("s", lambda x: F.when(x["tool"] > 0, x["tool"].cast("string")))
    return e.select("user_id", F.array_join(first_distinct(tools), ",").alias("tools"))


def j10_fuzzy(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return fuzzy(names, names.select(F.left("name", F.lit(6)).alias("term")).distinct()).select("term", "name", "rank")


def j6_idempotent(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return missing_rows(o.where("o_custkey % 2 = 0").distinct(), o, ["o_custkey", "o_orderpriority"])


def j15_deliveries(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    rows = o.select(F.col("o_orderkey").alias("delivery_id"), (F.col("o_orderkey") % 2000).alias("notification_id"), F.col("o_custkey").alias("user"))
    return deliveries(rows, c.select(F.col("c_custkey").alias("notification_id")), c.select(F.col("c_custkey").alias("user"), (F.col("c_acctbal") > 0).alias("ok")))


def j16_backfill(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    patients = c.select(F.col("c_nationkey").alias("tenant"), (F.col("c_custkey") % 120).alias("user"))
    members = s.select(F.col("s_nationkey").alias("tenant"), F.col("s_suppkey").alias("user"))
    return owners_backfill(s.select(F.col("s_suppkey").alias("user")), patients, members)


def ag11_finite(spark, d):
    e = _ev(spark, d)
    x = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 7 == 0, float("inf")).otherwise(F.col("value"))
    return finite_means(e.select("event_type", x.alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("b")), "event_type", ["a", "b"])


def ag18_documents(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"))


def ag19_periodic(spark, d):
    return _ev(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


def ag26_max_version(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.year("o_orderdate")).alias("version"))


def ag27_trace(spark, d):
    e = _ev(spark, d).select("user_id", "event_id", F.col("value").alias("counter"), (F.col("event_type") == "error").alias("flag"), F.when(F.col("event_id") % 4 == 1, F.col("event_type")).alias("setting"))
    return trace_merge(e, "user_id", "event_id").withColumn("counter", F.round("counter", 4))


def nd15_distance(spark, d):
    n = read(spark, d, "nation")
    p = n.select("n_nationkey", (F.col("n_nationkey") * 7 % 90).cast("double").alias("lat"), (F.col("n_nationkey") * 13 % 180).cast("double").alias("lon"))
    return p.select("n_nationkey", F.round(haversine(F.col("lat"), F.col("lon"), F.lit(31.2), F.lit(121.5)), 6).alias("km"))


def nd18_overlap(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", overlap(F.col("p_name"), F.col("p_type")).alias("close"))


def fl13_quota(spark, d):
    e = _ev(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    return e.where("n <= 15").orderBy("n", "event_type").limit(40).select("event_id")


def st_sets(spark, d):
    e = _ev(spark, d).groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 200, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") < 60, F.col("event_type"))).alias("b"))
    return e.select("user_id", F.size(F.array_intersect("a", "b")).alias("both"), F.size(F.array_union("a", "b")).alias("any"), (F.size(F.array_except("a", "b")) == 0).alias("subset"))


QUERIES = {f.__name__: f for f in (wn4_effective_order, wn9_first_seen, wn10_poi_rank, wn12_budget, wn13_plan_cap, j10_fuzzy, j6_idempotent, j15_deliveries, j16_backfill, ag11_finite, ag18_documents, ag19_periodic, ag26_max_version, ag27_trace, nd15_distance, nd18_overlap, fl13_quota, st_sets)}
_top = lambda t: f"SELECT * FROM (SELECT user_id AS query_id, event_id % 40 AS doc_id, max(value) AS score FROM events WHERE event_type = '{t}' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"
SQL = {
    "wn4_effective_order": "WITH h AS (SELECT user_id AS query_id, event_id AS doc_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value / 2 END, CASE WHEN event_type <> 'view' THEN value END, 0) AS score FROM events) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 5",
    "wn9_first_seen": f"""WITH u AS (SELECT query_id, doc_id, 0 AS l, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ({_top("click")}) UNION ALL SELECT query_id, doc_id, 1, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) FROM ({_top("view")})),
        m AS (SELECT query_id, doc_id, min((l, r)) AS ord FROM u GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS rank FROM m QUALIFY rank <= 12""",
    "wn10_poi_rank": "WITH p AS (SELECT s_nationkey AS owner, s_name AS name, s_suppkey % 3 = 0 AS hit, CASE WHEN s_suppkey % 5 > 0 THEN greatest(round(s_acctbal, 0), 0) END AS d FROM supplier) SELECT owner, name, row_number() OVER (PARTITION BY owner ORDER BY hit DESC, d IS NULL, CASE WHEN d = 0 THEN 1e9 ELSE d END, name) AS rank FROM p",
    "wn12_budget": "WITH b AS (SELECT source, doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) SELECT source, doc_id, least(n, 16000 - before)::BIGINT AS n FROM b WHERE before < 16000",
    "wn13_plan_cap": "WITH f AS (SELECT user_id, event_id % 7 AS tool, min((ts, event_id)) AS ord FROM events GROUP BY ALL), r AS (SELECT * FROM f WHERE tool > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ord) <= 5) SELECT user_id, coalesce(string_agg(tool, ',' ORDER BY ord), '') AS tools FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN r USING (user_id) GROUP BY user_id",
    "j10_fuzzy": "WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT DISTINCT left(name, 6) AS term FROM n) SELECT term, name, row_number() OVER (PARTITION BY term ORDER BY length(name) DESC, name) AS rank FROM n JOIN t ON contains(name, term) OR contains(term, name) QUALIFY rank <= 3",
    "j6_idempotent": "SELECT DISTINCT o_custkey, o_orderpriority FROM orders",
    "j15_deliveries": "SELECT o_orderkey AS delivery_id, CASE WHEN n.c_custkey IS NULL THEN 'missing_notification' WHEN coalesce(c.c_acctbal > 0, false) THEN 'send' ELSE 'no_consent' END AS outcome FROM orders LEFT JOIN customer n ON n.c_custkey = o_orderkey % 2000 LEFT JOIN customer c ON c.c_custkey = o_custkey",
    "j16_backfill": """SELECT s_nationkey AS tenant, s_suppkey AS "user" FROM supplier UNION ALL SELECT DISTINCT c_nationkey, c_custkey % 120 FROM customer WHERE c_custkey % 120 IN (SELECT s_suppkey FROM supplier) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey % 120)""",
    "ag11_finite": "SELECT event_type, round(avg(value) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0), 6) AS a, count(*) FILTER (event_id % 5 <> 0 AND event_id % 7 <> 0) AS n_a, round(avg(value) FILTER (event_id % 2 = 0), 6) AS b, count(*) FILTER (event_id % 2 = 0) AS n_b FROM events GROUP BY 1",
    "ag18_documents": "SELECT source, lang, count(*) AS chunks FROM documents GROUP BY ALL",
    "ag19_periodic": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "ag26_max_version": "SELECT o_custkey, max(year(o_orderdate)) AS version FROM orders GROUP BY 1",
    "ag27_trace": "SELECT user_id, round(sum(value), 4) AS counter, bool_or(event_type = 'error') AS flag, arg_min(event_type, event_id) FILTER (event_id % 4 = 1) AS setting FROM events GROUP BY 1",
    "nd15_distance": "WITH p AS (SELECT n_nationkey, radians((n_nationkey * 7 % 90)::DOUBLE) AS a, radians(31.2) AS b, radians(121.5 - (n_nationkey * 13 % 180)) AS l FROM nation), h AS (SELECT n_nationkey, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(l / 2), 2) AS h FROM p) SELECT n_nationkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM h",
    "nd18_overlap": "WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name, '')) AS a, list_distinct(string_split(p_type, '')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) / len(b) >= 0.2 AS close FROM p",
    "fl13_quota": "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events QUALIFY n <= 15) ORDER BY n, event_type LIMIT 40",
    "st_sets": "WITH g AS (SELECT user_id, coalesce(list_distinct(list(event_type) FILTER (value > 200)), []) AS a, coalesce(list_distinct(list(event_type) FILTER (value < 60)), []) AS b FROM events GROUP BY 1) SELECT user_id, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS any, len(list_filter(a, lambda t: NOT list_contains(b, t))) = 0 AS subset FROM g",
}
