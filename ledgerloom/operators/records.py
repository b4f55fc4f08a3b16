"""Longitudinal records: scoped reads, trends, timelines, goals, grants, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small

#: Levels of a grant, from weak to strong.
LEVELS = ["read", "write", "manage"]


class Scope:
    """Reads rows of one tenant and patient; the only way to read patient rows. Ids are checked."""

    def __init__(self, tenant_id: str, patient_id: str):
        for x in (tenant_id, patient_id):
            if not (isinstance(x, str) and 0 < len(x) <= 64 and all(c.isascii() and (c.isalnum() or c == "-") for c in x)):
                raise ValueError(f"not a valid id: {x!r}")
        self.tenant_id, self.patient_id = tenant_id, patient_id

    def predicate(self, domain: str = "patient", level: int | None = None) -> Column:
        out = (F.col("document_domain") == domain) & (F.col("tenant_id") == self.tenant_id) & (F.col("patient_id") == self.patient_id)
        return out & (F.col("chunk_level") == level) if level is not None else out

    def read(self, rows: DataFrame, level: int | None = None) -> DataFrame:
        return rows.where(self.predicate(level=level))


def number(c: Column) -> Column:
    """First signed decimal in a text."""
    return F.nullif(F.regexp_extract(c, r"[-+]?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).try_cast("double")


def rounded(c: Column, places: int) -> Column:
    """A double rounded as SQL engines with binary arithmetic do: scaled, then halves away from zero. Spark's own round takes the shortest decimal, which can lie on the other side of a half."""
    scaled = F.abs(c) * float(10**places)
    whole = F.floor(scaled).cast("double")
    out = F.signum(c) * (whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)) / float(10**places)
    return F.when(scaled < 2.0**52, out).otherwise(c)


def trend(obs: DataFrame, code: str, limit: int = 200, by: str = "patient") -> DataFrame:
    """obs (by, code, at, id, value): per patient, the newest `limit` observations of any code, then those of `code`: count, extremes, change, direction, slope per day."""
    w = Window.partitionBy(by).orderBy(F.desc("at"), F.desc("id"))
    new = obs.withColumn("n", F.row_number().over(w)).where((F.col("n") <= limit) & (F.col("code") == code))
    order = F.struct("at", "id")
    g = new.groupBy(by).agg(F.count("*").alias("count"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("latest"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.min("at").alias("start"), F.max("at").alias("end"))
    delta = F.col("latest") - F.col("first")
    days = F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / 86400.0
    tolerance = F.greatest(F.abs("first") * 0.02, F.lit(0.01))
    direction = F.when(F.col("count") < 2, "insufficient_data").when(delta > tolerance, "rising").when(delta < -tolerance, "falling").otherwise("stable")
    return g.select(by, "count", "first", "latest", "minimum", "maximum", rounded(delta, 4).alias("delta"), rounded(F.try_divide(delta, F.abs("first")) * 100, 2).alias("percent_change"), direction.alias("direction"), rounded(F.try_divide(delta, F.nullif(days, F.lit(0.0))), 4).alias("slope_per_day"))


def next_chain(events: DataFrame, by: str, at: str, id_: str) -> DataFrame:
    """Each event with the next one of its owner."""
    return events.withColumn("next_id", F.lead(id_).over(Window.partitionBy(by).orderBy(at, id_)))


def goals_met(goals: DataFrame, obs: DataFrame) -> DataFrame:
    """goals (patient, code, op, target), obs (patient, code, at, id, value): each goal against the latest observation; `lte`, `gte`, else equal; null without a number."""
    latest = obs.groupBy("patient", "code").agg(F.max_by("value", F.struct("at", "id")).alias("value"))
    v, t = F.col("value"), F.col("target")
    return goals.join(latest, ["patient", "code"], "left").withColumn("met", F.when(F.col("op") == "lte", v <= t).when(F.col("op") == "gte", v >= t).otherwise(v == t))


def access(requests: DataFrame, patients: DataFrame, members: DataFrame, grants: DataFrame, needed: str, now: Column) -> DataFrame:
    """requests (user, patient): 200, 403 or 404. A patient must exist in the user's tenant; owners pass, others need an unexpired grant that is strong enough."""
    strength = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")), F.lit(0))
    out = requests.join(members, "user", "left").join(patients.withColumnRenamed("tenant", "patient_tenant"), "patient", "left").join(grants, ["user", "patient"], "left")
    seen = F.coalesce(F.col("tenant") == F.col("patient_tenant"), F.lit(False))
    may = (F.col("owner") == F.col("user")) | F.coalesce((strength >= LEVELS.index(needed) + 1) & (F.col("expires").isNull() | (F.col("expires") > now)), F.lit(False))
    return out.select("user", "patient", F.when(~seen, 404).when(may, 200).otherwise(403).alias("status"))


def missing_types(required: DataFrame, present: DataFrame) -> DataFrame:
    """required (owner, type) without present (owner, type): the sorted missing types of each owner."""
    return required.join(present, ["owner", "type"], "left_anti").groupBy("owner").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("missing"))


def retracted(facts: DataFrame, retractions: DataFrame) -> DataFrame:
    """Facts with status after a log of retractions (fact_id)."""
    gone = retractions.select("fact_id").distinct().withColumn("gone", F.lit(True))
    return facts.join(gone, "fact_id", "left").withColumn("active", F.col("gone").isNull()).withColumn("verification", F.when(F.col("gone"), "entered-in-error").otherwise(F.col("verification"))).drop("gone")


def candidates(chunks: DataFrame, patterns: list[tuple[str, str, float]]) -> DataFrame:
    """chunks (chunk_id, text): a row for each match of patterns (type, regex with one group, confidence), with the first date of the chunk."""
    found = F.flatten(F.array(*[_facts(*p) for p in patterns]))
    date = F.nullif(F.regexp_extract("text", r"20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}", 0), F.lit(""))
    parts = F.split(date, "[-/.年月]")
    when = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")).try_cast("date")
    return chunks.select("chunk_id", when.alias("date"), F.explode(found).alias("f")).select("chunk_id", "f.type", F.left(F.trim("f.display"), F.lit(500)).alias("display"), "f.confidence", F.when(F.col("date").isNotNull(), "day").otherwise("approximate").alias("precision"))


# The lines and observations that hold facts, their types and confidences.
LINE_FACTS = [
    ("AllergyIntolerance", r"(?:过敏史|药物过敏)\s*[:：]\s*([^\n。；;]{2,120})", 0.58),
    ("MedicationStatement", r"(?:当前用药|服用药物|用药)\s*[:：]\s*([^\n。；;]{2,160})", 0.58),
    ("Condition", r"(?:诊断|既往史|疾病史)\s*[:：]\s*([^\n。；;]{2,160})", 0.58),
    ("Procedure", r"(?:手术史|操作)\s*[:：]\s*([^\n。；;]{2,160})", 0.58),
    ("Immunization", r"(?:疫苗|免疫接种)\s*[:：]\s*([^\n。；;]{2,160})", 0.58),
]
PRESSURE = r"(?iU)血压\s*[:：]?\s*(\d{2,3})\s*[/／]\s*(\d{2,3})\s*(mmHg)?"
SUGAR = r"(?iU)(?:空腹)?血糖\s*[:：]?\s*(\d+(?:\.\d+)?)\s*(mmol/L)?"
OBSERVED = 0.72
DATE = r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"


def fact_candidates(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, page, text): candidates (chunk_id, page, resource_type, display, value, effective_start, time_precision, confidence, evidence_text).

    Facts of lines and observations of pressure and sugar, with the chunk's first date. A chunk whose date doesn't exist (13/45) has none;
    value is a map, empty for facts of lines.
    """
    found = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    none = F.create_map().cast("map<string,string>")
    row = lambda kind, display, value, sure, hit: F.struct(F.lit(kind).alias("resource_type"), display.alias("display"), value.alias("value"), F.lit(sure).alias("confidence"), hit.alias("evidence_text"))

    def line(kind: str, pattern: str, sure: float) -> Column:
        return F.transform(found(pattern), lambda m: row(kind, F.regexp_replace(F.regexp_extract(m, pattern, 1), r"(?U)^\s+|\s+$", ""), none, sure, m))

    lines = [line(*x) for x in LINE_FACTS]
    unit = lambda m, p, i, usual: F.coalesce(F.nullif(F.regexp_extract(m, p, i), F.lit("")), F.lit(usual))
    number = lambda m, p, i: F.regexp_extract(m, p, i).cast("double").cast("string")
    whole = lambda m, p, i: F.regexp_extract(m, p, i).cast("int").cast("string")
    pressure = F.transform(found(PRESSURE), lambda m: row("Observation", F.lit("血压"), F.create_map(F.lit("systolic"), whole(m, PRESSURE, 1), F.lit("diastolic"), whole(m, PRESSURE, 2), F.lit("unit"), unit(m, PRESSURE, 3, "mmHg")), OBSERVED, m))
    sugar = F.transform(found(SUGAR), lambda m: row("Observation", F.lit("血糖"), F.create_map(F.lit("value"), number(m, SUGAR, 1), F.lit("unit"), unit(m, SUGAR, 2, "mmol/L")), OBSERVED, m))
    part = lambda i: F.regexp_extract("text", DATE, i)
    date = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")
    out = chunks.select("chunk_id", "page", date.alias("effective_start"), F.explode(F.flatten(F.array(*lines, pressure, sugar))).alias("f"))
    return out.select("chunk_id", "page", "f.resource_type", "f.display", "f.value", "effective_start", F.when(F.col("effective_start").isNotNull(), "day").otherwise("approximate").alias("time_precision"), "f.confidence", "f.evidence_text")


def candidate_key(document_id: Column, resource_type: Column, display: Column, effective_start: Column, chunk_id: Column) -> Column:
    """Digest by which a candidate is known again; nulls are empty."""
    start = F.coalesce(F.concat(effective_start.cast("string"), F.lit(" 00:00:00")), F.lit(""))
    return F.sha2(F.concat_ws("|", document_id, F.coalesce(resource_type, F.lit("")), F.lower(F.trim(F.coalesce(display, F.lit("")))), start, F.coalesce(chunk_id, F.lit(""))), 256)


def _facts(kind: str, pattern: str, confidence: float) -> Column:
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("display"), F.lit(confidence).alias("confidence")))


def profile(edges: DataFrame, node: DataFrame, most: int = 20) -> DataFrame:
    """One hop from each node (id): up to `most` names of each relation of edges (src, relation, dst), sorted."""
    out = edges.join(small(node.select(F.col("id").alias("src"))), "src").withColumn("n", F.row_number().over(Window.partitionBy("src", "relation").orderBy("dst")))
    return out.where(F.col("n") <= most).groupBy("src", "relation").agg(F.array_join(F.sort_array(F.collect_list("dst")), ",").alias("names"))


def reversed_profile(edges: DataFrame, node: DataFrame, most: int = 20) -> DataFrame:
    """One hop against the edges: up to `most` names that have a relation to each node (id), such as the diseases of a symptom or the makers of a drug."""
    return profile(edges.select(F.col("dst").alias("src"), "relation", F.col("src").alias("dst")), node, most)


def _obs(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("patient"), F.col("event_type").alias("code"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "value")


def pt2_trend(spark, d):
    return trend(_obs(spark, d), "click", 40)


def tk3_timeline(spark, d):
    return read(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).select("o_orderkey", "o_custkey")


def j9_next_chain(spark, d):
    return next_chain(_obs(spark, d), "patient", "at", "id").select("patient", "id", "next_id")


def j12_goal_check(spark, d):
    goals = _obs(spark, d).select("patient").distinct().select("patient", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(o).alias("op"), F.lit(t).alias("target")) for c, o, t in (("click", "lte", 40.0), ("view", "gte", 60.0), ("none", "gte", 1.0))])).alias("g")).select("patient", "g.*")
    return goals_met(goals, _obs(spark, d)).select("patient", "code", "value", "met")


def j4_grants(spark, d):
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    patients = c.select(F.col("c_custkey").alias("patient"), F.col("c_nationkey").alias("tenant"), (F.col("c_custkey") % 50).alias("owner"))
    members = s.select(F.col("s_suppkey").alias("user"), F.col("s_nationkey").alias("tenant"))
    o = read(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("user"), F.col("o_custkey").alias("patient"), "o_orderdate", "o_orderkey", "o_orderpriority")
    grants = o.groupBy("user", "patient").agg(F.max_by(F.when(F.col("o_orderpriority").startswith("1"), "manage").when(F.col("o_orderpriority").startswith("2"), "write").otherwise("read"), "o_orderkey").alias("level"), F.max("o_orderdate").alias("expires"))
    return access(o.select("user", "patient").distinct(), patients, members, grants, "write", F.lit("1996-01-01").cast("timestamp_ntz"))


def j14_missing(spark, d):
    e = read(spark, d, "events")
    owners = e.select(F.col("user_id").alias("owner")).distinct()
    required = owners.select("owner", F.explode(F.array(*[F.lit(x) for x in ("error", "purchase", "refund", "signup")])).alias("type"))
    return missing_types(required, e.where("value > 250").select(F.col("user_id").alias("owner"), F.col("event_type").alias("type")))


def pt3_retract(spark, d):
    o = read(spark, d, "orders")
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.lit("user_confirmed").alias("verification"))
    return retracted(facts, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("fact_id")))


def nd16_candidates(spark, d):
    chunks = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return candidates(chunks, [("Phone", r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})", 0.72), ("Address", r"\b([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})\b", 0.58)])


def nd16_facts(spark, d):
    """Notes made of suppliers: a line of each kind in turn, a pressure, a sugar and a date."""
    n, name = F.col("s_suppkey"), F.col("s_name")
    word = F.get(F.array(*[F.lit(x) for x in ("过敏史", "用药", "既往史", "手术史", "疫苗")]), (n % 5).cast("int"))
    date = F.concat(F.lit("日期 2024年"), (n % 14).cast("string"), F.lit("月"), (n % 33).cast("string"), F.lit("日"))
    text = F.concat(date, F.lit("\n"), word, F.lit(" ： "), name, F.lit(" ；血压:"), (n % 60 + 90).cast("string"), F.lit("／"), (n % 30 + 60).cast("string"), F.when(n % 2 == 0, " MMHG").otherwise(""), F.lit("，空腹血糖 "), (n % 9).cast("string"), F.lit(".5"))
    c = fact_candidates(read(spark, d, "supplier").select(F.concat(F.lit("c"), n).alias("chunk_id"), (n % 7).cast("int").alias("page"), text.alias("text")))
    key = candidate_key(F.lit("doc"), F.col("resource_type"), F.col("display"), F.col("effective_start"), F.col("chunk_id"))
    v = lambda k: F.try_element_at("value", F.lit(k)).alias(k)
    return c.select("chunk_id", "page", "resource_type", "display", v("systolic"), v("diastolic"), v("value"), v("unit"), F.col("effective_start").cast("string").alias("effective_start"), "time_precision", "confidence", "evidence_text", key.alias("key"))


def j8_profile(spark, d):
    p = read(spark, d, "part")
    edges = p.select(F.col("p_brand").alias("src"), F.explode(F.array(F.struct(F.lit("type").alias("relation"), F.col("p_type").alias("dst")), F.struct(F.lit("name").alias("relation"), F.col("p_name").alias("dst")))).alias("e")).select("src", "e.*").distinct()
    return profile(edges, p.select(F.col("p_brand").alias("id")).distinct())


def j8_reverse(spark, d):
    p = read(spark, d, "part")
    edges = p.select(F.col("p_name").alias("src"), F.lit("type").alias("relation"), F.col("p_type").alias("dst")).union(p.select("p_brand", F.lit("brand"), "p_type")).distinct()
    return reversed_profile(edges, p.select(F.col("p_type").alias("id")).distinct())


def fl1_scope(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.lit("patient").alias("document_domain"), F.col("c_nationkey").cast("string").alias("tenant_id"), F.col("c_mktsegment").alias("patient_id"))
    return Scope("7", "BUILDING").read(c).select("c_custkey")


QUERIES = {f.__name__: f for f in (pt2_trend, tk3_timeline, j9_next_chain, j12_goal_check, j4_grants, j14_missing, pt3_retract, nd16_candidates, nd16_facts, j8_profile, j8_reverse, fl1_scope)}
SQL = {
    "pt2_trend": """
        WITH n AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40),
        g AS (SELECT user_id AS patient, count(*) AS count, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS latest, min(value) AS minimum, max(value) AS maximum, date_sub('second', min(ts), max(ts)) / 86400.0 AS days FROM n WHERE event_type = 'click' GROUP BY 1)
        SELECT patient, count, first, latest, minimum, maximum, round(latest - first, 4) AS delta, round((latest - first) / abs(first) * 100, 2) AS percent_change,
            CASE WHEN count < 2 THEN 'insufficient_data' WHEN latest - first > greatest(abs(first) * 0.02, 0.01) THEN 'rising' WHEN latest - first < -greatest(abs(first) * 0.02, 0.01) THEN 'falling' ELSE 'stable' END AS direction,
            round((latest - first) / nullif(days, 0), 4) AS slope_per_day FROM g""",
    "tk3_timeline": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500",
    "j9_next_chain": "SELECT user_id AS patient, event_id AS id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id FROM events",
    "j12_goal_check": """
        WITH o AS (SELECT user_id AS patient, event_type AS code, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
        g AS (SELECT patient, code, op, target FROM (SELECT DISTINCT user_id AS patient FROM events), (VALUES ('click', 'lte', 40.0), ('view', 'gte', 60.0), ('none', 'gte', 1.0)) AS t(code, op, target))
        SELECT patient, code, value, CASE op WHEN 'lte' THEN value <= target WHEN 'gte' THEN value >= target ELSE value = target END AS met FROM g LEFT JOIN o USING (patient, code)""",
    "j4_grants": """
        WITH o AS (SELECT o_orderkey % 100 AS u, o_custkey AS p, * FROM orders),
        g AS (SELECT u, p, arg_max(CASE left(o_orderpriority, 1) WHEN '1' THEN 3 WHEN '2' THEN 2 ELSE 1 END, o_orderkey) AS s, max(o_orderdate) AS e FROM o GROUP BY ALL)
        SELECT g.u AS "user", g.p AS patient, CASE WHEN s_nationkey IS DISTINCT FROM c_nationkey OR s_nationkey IS NULL THEN 404 WHEN c_custkey % 50 = g.u OR (s >= 2 AND e > TIMESTAMP '1996-01-01') THEN 200 ELSE 403 END AS status
        FROM g LEFT JOIN supplier ON s_suppkey = g.u LEFT JOIN customer ON c_custkey = g.p""",
    "j14_missing": "WITH r AS (SELECT owner, type FROM (SELECT DISTINCT user_id AS owner FROM events), (VALUES ('error'), ('purchase'), ('refund'), ('signup')) AS t(type)) SELECT owner, string_agg(type, ',' ORDER BY type) AS missing FROM r WHERE NOT EXISTS (SELECT 1 FROM events WHERE value > 250 AND user_id = owner AND event_type = type) GROUP BY owner",
    "pt3_retract": "SELECT o_orderkey AS fact_id, CASE WHEN o_orderstatus = 'F' THEN 'entered-in-error' ELSE 'user_confirmed' END AS verification, o_orderstatus <> 'F' AS active FROM orders",
    "nd16_candidates": r"""
        WITH f AS (SELECT doc_id AS chunk_id, text, 'Phone' AS type, unnest(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS display, 0.72::DOUBLE AS confidence FROM documents
                   UNION ALL SELECT doc_id, text, 'Address', unnest(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b')), 0.58 FROM documents)
        SELECT chunk_id, type, display, confidence, CASE WHEN try_cast(replace(replace(regexp_extract(text, '20[0-9]{2}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}'), '/', '-'), '.', '-') AS DATE) IS NOT NULL THEN 'day' ELSE 'approximate' END AS precision FROM f""",
    "nd16_facts": """
        WITH s AS (SELECT s_suppkey AS n, 'c' || s_suppkey AS chunk_id, (s_suppkey % 7)::INTEGER AS page, s_name, try_cast('2024-' || lpad((s_suppkey % 14)::VARCHAR, 2, '0') || '-' || lpad((s_suppkey % 33)::VARCHAR, 2, '0') AS DATE) AS day FROM supplier),
        f AS (SELECT s.*, ['AllergyIntolerance', 'MedicationStatement', 'Condition', 'Procedure', 'Immunization'][n % 5 + 1] AS resource_type, trim(s_name) AS display, NULL::VARCHAR AS systolic, NULL::VARCHAR AS diastolic, NULL::VARCHAR AS value, NULL::VARCHAR AS unit, 0.58::DOUBLE AS confidence,
                ['过敏史', '用药', '既往史', '手术史', '疫苗'][n % 5 + 1] || ' ： ' || s_name || ' ' AS evidence_text FROM s
            UNION ALL SELECT s.*, 'Observation', '血压', (n % 60 + 90)::VARCHAR, (n % 30 + 60)::VARCHAR, NULL, CASE WHEN n % 2 = 0 THEN 'MMHG' ELSE 'mmHg' END, 0.72, '血压:' || (n % 60 + 90) || '／' || (n % 30 + 60) || CASE WHEN n % 2 = 0 THEN ' MMHG' ELSE '' END FROM s
            UNION ALL SELECT s.*, 'Observation', '血糖', NULL, NULL, (n % 9) || '.5', 'mmol/L', 0.72, '空腹血糖 ' || (n % 9) || '.5' FROM s)
        SELECT chunk_id, page, resource_type, display, systolic, diastolic, value, unit, day::VARCHAR AS effective_start, CASE WHEN day IS NULL THEN 'approximate' ELSE 'day' END AS time_precision, confidence, evidence_text,
            sha256('doc|' || resource_type || '|' || lower(display) || '|' || coalesce(day || ' 00:00:00', '') || '|' || chunk_id) AS key FROM f""",
    "j8_profile": "WITH e AS (SELECT DISTINCT p_brand AS src, 'type' AS relation, p_type AS dst FROM part UNION SELECT p_brand, 'name', p_name FROM part), r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, relation ORDER BY dst) <= 20) SELECT src, relation, string_agg(dst, ',' ORDER BY dst) AS names FROM r GROUP BY ALL",
    "j8_reverse": "WITH e AS (SELECT p_type AS src, 'type' AS relation, p_name AS dst FROM part UNION SELECT p_type, 'brand', p_brand FROM part), r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, relation ORDER BY dst) <= 20) SELECT src, relation, string_agg(dst, ',' ORDER BY dst) AS names FROM r GROUP BY ALL",
    "fl1_scope": "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'",
}
