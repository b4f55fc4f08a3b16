"""Patient facts, candidates, goals and graph texts as frames: creation with timeline events, review states, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.planning import event_summary
from ledgerloom.functions.tables import read, small

# The resource types of facts.
TYPES = ["Condition", "AllergyIntolerance", "MedicationStatement", "Observation", "DiagnosticReport", "Procedure", "FamilyMemberHistory", "Immunization", "Encounter"]


def created(facts: DataFrame, types: list[str] = TYPES) -> tuple[DataFrame, DataFrame]:
    """facts (fact_id, resource_type, display, value, unit, effective_start, confidence): (facts, timeline events), one event for each fact.

    Facts of unknown types are refused: they give no rows. Confidence is clamped to 0..1.
    """
    ok = facts.where(F.col("resource_type").isin(*types)).withColumn("confidence", F.least(F.greatest(F.coalesce(F.col("confidence").cast("double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))
    events = ok.select(F.concat(F.lit("event-"), F.col("fact_id").cast("string")).alias("event_id"), F.col("resource_type").alias("event_type"), F.col("display").alias("title"), event_summary(F.col("resource_type"), F.col("display"), F.col("value"), F.col("unit")).alias("summary"), F.col("effective_start").alias("effective_at"), F.col("fact_id").alias("source_fact_id"))
    return ok, events


def listed(facts: DataFrame, resource_type: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Facts of a type, active ones unless asked for all, the newest first."""
    out = facts if include_inactive else facts.where("active")
    return (out.where(F.col("resource_type") == resource_type) if resource_type else out).orderBy(F.desc("effective_start"), F.desc("fact_id"))


def normalized(items: DataFrame, chunks: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """items (resource_type, display, source_chunk_id, source_page, confidence, evidence_text, clinical_status, time_precision), chunks (chunk_id, page, text): candidates with bounded fields.

    Unknown types and empty displays go. The page and, where none is given, the evidence come from the chunk; a confidence that isn't a number is 0.5.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    chunk = chunks.select(F.col("chunk_id").alias("_c"), F.col("page").alias("_p"), F.left("text", F.lit(1000)).alias("_t"))
    out = items.where(text("resource_type").isin(*types) & (text("display") != "")).withColumn("source_chunk_id", F.nullif(text("source_chunk_id"), F.lit("")))
    out = out.join(chunk, F.col("source_chunk_id") == F.col("_c"), "left")
    number = F.when(F.col("confidence").isNull(), F.lit(0.5)).otherwise(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.5)))
    evidence = F.when(text("evidence_text") != "", text("evidence_text")).otherwise(F.coalesce("_t", F.lit("")))
    made = {
        "resource_type": text("resource_type"), "display": F.left(text("display"), F.lit(500)), "source_page": F.coalesce(F.col("source_page").try_cast("int"), F.when(F.col("source_page").isNull(), F.col("_p").cast("int"))),
        "confidence": F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)), "evidence_text": F.left(evidence, F.lit(1200)), "clinical_status": F.left(F.coalesce(F.nullif(F.col("clinical_status"), F.lit("")), F.lit("active")), F.lit(40)),
        "time_precision": F.left(F.coalesce(F.nullif(F.col("time_precision"), F.lit("")), F.lit("approximate")), F.lit(20)),
    }
    return out.withColumns(made).drop("_c", "_p", "_t")


def candidate_key(document_id: Column, resource_type: Column, display: Column, start: Column, chunk_id: Column) -> Column:
    """SHA-256 of the parts of a candidate, joined by bars; the display trimmed and in lower case."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.sha2(F.concat_ws("|", blank(document_id), blank(resource_type), F.lower(F.trim(blank(display))), blank(start), blank(chunk_id)), 256)


def reviewed(candidates: DataFrame, commands: DataFrame) -> DataFrame:
    """candidates (candidate_id, display, effective_start), commands (candidate_id, at, action confirm or reject, new_display, new_start): status, final fields and the fact's id.

    Commands count in order: the first that is possible decides. A confirmation needs a date, its own or one given then or by an earlier attempt; after a rejection
    nothing changes, and a confirmed candidate can't be rejected. A candidate becomes at most one fact. Each candidate's commands are folded in one row.
    """
    log = commands.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("at", "action", "new_display", "new_start"))).alias("log"))
    state = lambda status, display, start, refused: F.struct(status.alias("status"), display.alias("display"), start.alias("start"), refused.alias("refused"))

    def step(s, c):
        display, start = F.coalesce(c["new_display"], s["display"]), F.coalesce(c["new_start"], s["start"])
        confirm = F.when((s["status"] == "pending") & start.isNotNull(), state(F.lit("confirmed"), display, start, s["refused"])).when(s["status"] == "pending", state(s["status"], display, start, s["refused"] + 1))
        reject = F.when(s["status"] == "pending", state(F.lit("rejected"), s["display"], s["start"], s["refused"]))
        same = (s["status"] == "confirmed") & (c["action"] == "confirm") | (s["status"] == "rejected") & (c["action"] == "reject")
        other = F.when(same, s).otherwise(state(s["status"], s["display"], s["start"], s["refused"] + 1))
        return F.coalesce(F.when(c["action"] == "confirm", confirm), F.when(c["action"] == "reject", reject), other)

    none = F.array().cast(dict(log.dtypes)["log"])
    first = state(F.lit("pending"), F.col("display"), F.col("effective_start"), F.lit(0))
    out = candidates.join(log, "candidate_id", "left").select("candidate_id", F.aggregate(F.coalesce("log", none), first, step).alias("s"))
    return out.select("candidate_id", "s.status", "s.display", F.col("s.start").alias("effective_start"), "s.refused", F.when(F.col("s.status") == "confirmed", F.concat(F.lit("fact-"), F.col("candidate_id").cast("string"))).alias("fact_id"))


def goal_progress(goals: DataFrame, observations: DataFrame) -> DataFrame:
    """goals (goal_id, patient, code, op, target), observations (patient, code, at, id, value, active, verification): outcome of each goal against the latest verified one.

    waiting_input without one; met is null where a value isn't a number; the operator is at most (lte), at least (gte), else equal.
    """
    good = observations.where(F.col("active") & F.col("verification").isin("user_confirmed", "clinician_verified"))
    latest = good.groupBy("patient", "code").agg(F.max_by(F.struct("id", "value"), F.struct("at", "id")).alias("o"))
    actual, wanted = F.col("o.value").try_cast("double"), F.col("target").try_cast("double")
    met = F.when(F.col("op") == "lte", actual <= wanted).when(F.col("op") == "gte", actual >= wanted).otherwise(actual == wanted)
    return goals.join(latest, ["patient", "code"], "left").select("goal_id", F.when(F.col("o").isNull(), "waiting_input").otherwise("completed").alias("outcome"), F.col("o.id").alias("observation_id"), F.col("o.value").alias("actual"), met.alias("met"))


def document_listing(records: DataFrame) -> DataFrame:
    """records (document_id, filename, status, created_at, metadata JSON) with the counts and the extraction's state out of the metadata, the newest first."""
    at = lambda p: F.get_json_object("metadata", p)
    return records.select(
        "document_id", "filename", "status", "created_at", F.coalesce(at("$.leaf_chunks").try_cast("int"), F.lit(0)).alias("chunks"), F.coalesce(at("$.fact_extraction.candidate_count").try_cast("int"), F.lit(0)).alias("candidates"),
        F.coalesce(at("$.fact_extraction.status"), F.lit("not_started")).alias("extraction"),
    ).orderBy(F.desc("created_at"), "document_id")


def version_listing(versions: DataFrame, document_id) -> DataFrame:
    return versions.where(F.col("document_id") == document_id).orderBy(F.desc("version"))


def graph_text(edges: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """edges (src, relation, dst), nodes (name): for each node the text of its profile, a line for each relation with up to `most` names.

    A node reached only backward gets a line of the nodes that point to it. Sections are joined by blank lines, relations by name.
    """
    asked = small(nodes.select(F.col("name")).distinct())

    def lines(key: str, other: str, label: Column):
        one = edges.select(key, "relation", other).distinct().join(asked, F.col(key) == F.col("name")).withColumn("n", F.row_number().over(Window.partitionBy(key, "relation").orderBy(other))).where(F.col("n") <= most)
        by_relation = one.groupBy("name", "relation").agg(F.array_join(F.sort_array(F.collect_list(other)), "、").alias("names"))
        return by_relation.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("relation", "names"))), lambda x: F.concat(label, x["relation"], F.lit(": "), x["names"])), "\n").alias("t"))

    ahead, back = lines("src", "dst", F.lit("- ")).withColumnRenamed("t", "a"), lines("dst", "src", F.lit("< ")).withColumnRenamed("t", "b")
    head = F.when(F.col("a").isNotNull(), F.concat(F.col("name"), F.lit("\n"), F.col("a")))
    back_text = F.when(F.col("b").isNotNull(), F.concat(F.col("name"), F.lit("\n"), F.col("b")))
    return ahead.join(back, "name", "full_outer").select("name", F.concat_ws("\n\n", head, back_text).alias("text"))


def merged_traces(steps: DataFrame) -> DataFrame:
    """steps (trace_id, pos, tool, setting, chunks array): tools in order of use, the first setting that isn't null, and the last chunks that aren't empty."""
    s = steps.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tool", "chunks"))).alias("s"), F.min_by("setting", F.when(F.col("setting").isNotNull(), F.col("pos"))).alias("setting"))
    tools = F.array_distinct(F.filter(F.transform("s", lambda x: x["tool"]), lambda t: t.isNotNull()))
    last = F.aggregate("s", F.array().cast(dict(steps.dtypes)["chunks"]), lambda a, x: F.when(F.size(x["chunks"]) > 0, x["chunks"]).otherwise(a))
    return s.select("trace_id", F.array_join(tools, " + ").alias("tools"), "setting", last.alias("chunks"))


# queries


def _facts(spark, d):
    n, kinds = F.col("event_id"), F.array(*[F.lit(x) for x in [*TYPES[:4], "Other"]])
    return read(spark, d, "events").select(n.alias("fact_id"), F.get(kinds, (n % 5).cast("int")).alias("resource_type"), F.col("event_type").alias("display"), F.when(n % 3 > 0, F.col("user_id").cast("string")).alias("value"), F.when(n % 2 == 0, "mg").alias("unit"), F.col("ts").alias("effective_start"), (F.col("value") / 300 - 0.2).alias("confidence"))


def pt1_created(spark, d):
    facts, events = created(_facts(spark, d))
    return facts.select("fact_id", "resource_type", F.round("confidence", 6).alias("confidence")).join(events.select("event_id", "summary", F.col("source_fact_id").alias("fact_id")), "fact_id")


def fl7_listed(spark, d):
    f = _facts(spark, d).withColumn("active", F.col("fact_id") % 7 > 0)
    return listed(f, "Observation").select("fact_id", "display")


def nd17_normalized(spark, d):
    docs = read(spark, d, "documents")
    n = F.col("doc_id")
    items = docs.select(n, F.get(F.array(F.lit("Observation"), F.lit(" Condition "), F.lit("Else")), (n % 3).cast("int")).alias("resource_type"), F.when(n % 11 > 0, F.col("text")).otherwise("  ").alias("display"), F.when(n % 2 == 0, (n + 1).cast("string")).alias("source_chunk_id"), F.when(n % 5 == 0, "7").when(n % 5 == 1, "x").alias("source_page"), F.when(n % 4 == 0, "1.7").when(n % 4 == 1, "low").when(n % 4 == 2, "0.25").alias("confidence"), F.when(n % 6 == 0, "seen").alias("evidence_text"), F.lit("").alias("clinical_status"), F.lit(None).cast("string").alias("time_precision"))
    chunks = docs.select(n.cast("string").alias("chunk_id"), (n % 40).cast("int").alias("page"), "text")
    out = normalized(items, chunks)
    return out.select("doc_id", "resource_type", F.length("display").cast("bigint").alias("n"), "source_page", "confidence", F.sha2("evidence_text", 256).alias("evidence"), "clinical_status", "time_precision", candidate_key(n, F.col("resource_type"), F.col("display"), F.lit(None), F.col("source_chunk_id")).alias("key"))


def pt4_reviewed(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    cand = c.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("display"), F.when(F.col("c_custkey") % 3 > 0, F.lit("2020-01-01")).alias("effective_start"))
    k = F.col("o_orderkey")
    commands = o.select(F.col("o_custkey").alias("candidate_id"), k.alias("at"), F.when(k % 4 == 0, "reject").otherwise("confirm").alias("action"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("new_display"), F.when(k % 6 == 0, F.lit("2021-05-05")).alias("new_start"))
    return reviewed(cand, commands)


def pt5_goals(spark, d):
    e = read(spark, d, "events")
    obs = e.select(F.col("user_id").alias("patient"), F.col("event_type").alias("code"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 > 0, F.col("value").cast("string")).otherwise("n/a").alias("value"), (F.col("event_id") % 6 > 0).alias("active"), F.when(F.col("event_id") % 4 > 0, "user_confirmed").otherwise("candidate").alias("verification"))
    goals = e.select(F.col("user_id").alias("patient")).distinct().select("patient", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(o).alias("op"), F.lit(t).alias("target")) for c, o, t in (("click", "lte", "40"), ("view", "gte", "60"), ("error", "eq", "x"), ("none", "gte", "1"))])).alias("g"))
    goals = goals.select(F.concat_ws("-", F.col("patient").cast("string"), "g.code").alias("goal_id"), "patient", "g.*")
    return goal_progress(goals, obs)


def pt6_documents(spark, d):
    n = F.col("event_id")
    meta = F.when(n % 3 == 0, F.concat(F.lit('{"leaf_chunks": '), n % 9, F.lit(', "fact_extraction": {"candidate_count": "'), n % 4, F.lit('", "status": "done"}}'))).when(n % 3 == 1, '{"leaf_chunks": "x"}')
    r = read(spark, d, "events").select(n.alias("document_id"), F.col("event_type").alias("filename"), F.lit("ready").alias("status"), F.col("ts").alias("created_at"), meta.alias("metadata"))
    return document_listing(r).drop("created_at")


def pt7_versions(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return version_listing(o, 7)


def pt10_graph_text(spark, d):
    p = read(spark, d, "part")
    edges = p.select(F.col("p_brand").alias("src"), F.explode(F.array(F.struct(F.lit("type").alias("relation"), F.col("p_type").alias("dst")), F.struct(F.lit("size").alias("relation"), F.lpad(F.col("p_size").cast("string"), 2, "0").alias("dst")))).alias("e")).select("src", "e.*")
    nodes = p.select(F.col("p_brand").alias("name")).distinct().unionByName(p.select(F.col("p_type").alias("name")).distinct())
    return graph_text(edges, nodes).select("name", F.sha2("text", 256).alias("sha"))


def ag28_traces(spark, d):
    n = F.col("event_id")
    s = read(spark, d, "events").select(F.col("user_id").alias("trace_id"), n.alias("pos"), F.when(n % 3 > 0, F.col("event_type")).alias("tool"), F.when(n % 4 == 1, n.cast("string")).alias("setting"), F.when(n % 5 == 0, F.array(n)).otherwise(F.array().cast("array<bigint>")).alias("chunks"))
    return merged_traces(s).select("trace_id", "tools", "setting", F.get("chunks", F.lit(0)).alias("chunk"))


QUERIES = {f.__name__: f for f in (pt1_created, fl7_listed, nd17_normalized, pt4_reviewed, pt5_goals, pt6_documents, pt7_versions, pt10_graph_text, ag28_traces)}
_KIND = "['Condition', 'AllergyIntolerance', 'MedicationStatement', 'Observation', 'Other'][event_id % 5 + 1]"
SQL = {
    "pt1_created": f"""WITH f AS (SELECT *, {_KIND} AS k FROM events WHERE event_id % 5 < 4)
        SELECT event_id AS fact_id, k AS resource_type, round(least(greatest(value / 300 - 0.2, 0), 1), 6) AS confidence, 'event-' || event_id AS event_id, CASE WHEN event_id % 3 > 0 THEN trim(k || ': ' || event_type || ' = ' || user_id || ' ' || CASE WHEN event_id % 2 = 0 THEN 'mg' ELSE '' END) ELSE k || ': ' || event_type END AS summary FROM f""",
    "fl7_listed": "SELECT event_id AS fact_id, event_type AS display FROM events WHERE event_id % 5 = 3 AND event_id % 7 > 0",
    "nd17_normalized": """
        WITH i AS (SELECT doc_id, doc_id % 3 AS k, trim(text) AS t, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END AS c FROM documents WHERE doc_id % 3 < 2 AND doc_id % 11 > 0 AND trim(coalesce(text, '')) <> ''),
        j AS (SELECT i.*, o.doc_id AS o, o.text AS otext FROM i LEFT JOIN documents o ON o.doc_id = c)
        SELECT doc_id, CASE k WHEN 0 THEN 'Observation' ELSE 'Condition' END AS resource_type, length(left(t, 500)) AS n, CASE doc_id % 5 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE o % 40 END::INT AS source_page, CASE doc_id % 4 WHEN 0 THEN 1.0 WHEN 2 THEN 0.25 ELSE 0.5 END::DOUBLE AS confidence,
            sha256(CASE WHEN doc_id % 6 = 0 THEN 'seen' ELSE left(coalesce(otext, ''), 1000) END) AS evidence, 'active' AS clinical_status, 'approximate' AS time_precision,
            sha256(doc_id || '|' || CASE k WHEN 0 THEN 'Observation' ELSE 'Condition' END || '|' || lower(trim(left(t, 500))) || '||' || coalesce(CAST(c AS VARCHAR), '')) AS key FROM j""",
    "pt5_goals": """
        WITH o AS (SELECT user_id AS patient, event_type AS code, arg_max(event_id, (ts, event_id)) AS id, arg_max(CASE WHEN event_id % 10 > 0 THEN value END, (ts, event_id)) AS v0, arg_max(CASE WHEN event_id % 10 > 0 THEN CAST(value AS VARCHAR) ELSE 'n/a' END, (ts, event_id)) AS s FROM events WHERE event_id % 6 > 0 AND event_id % 4 > 0 GROUP BY ALL),
        g AS (SELECT patient, code, op, target FROM (SELECT DISTINCT user_id AS patient FROM events), (VALUES ('click', 'lte', '40'), ('view', 'gte', '60'), ('error', 'eq', 'x'), ('none', 'gte', '1')) AS t(code, op, target)),
        x AS (SELECT g.*, id, s, try_cast(s AS DOUBLE) AS v, try_cast(target AS DOUBLE) AS w FROM g LEFT JOIN o USING (patient, code))
        SELECT patient || '-' || code AS goal_id, CASE WHEN id IS NULL THEN 'waiting_input' ELSE 'completed' END AS outcome, id AS observation_id, s AS actual, CASE op WHEN 'lte' THEN v <= w WHEN 'gte' THEN v >= w ELSE v = w END AS met FROM x""",
    "pt6_documents": "SELECT event_id AS document_id, event_type AS filename, 'ready' AS status, CASE WHEN event_id % 3 = 0 THEN event_id % 9 ELSE 0 END AS chunks, CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE 0 END AS candidates, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'not_started' END AS extraction FROM events",
    "pt7_versions": "SELECT o_custkey AS document_id, o_orderkey AS version, o_orderstatus AS status FROM orders WHERE o_custkey = 7",
    "pt10_graph_text": """
        WITH e AS (SELECT DISTINCT p_brand AS src, 'type' AS relation, p_type AS dst FROM part UNION SELECT p_brand, 'size', lpad(CAST(p_size AS VARCHAR), 2, '0') FROM part), n AS (SELECT p_brand AS name FROM part UNION SELECT p_type FROM part),
        a1 AS (SELECT src AS name, relation, dst AS x FROM e JOIN n ON name = src QUALIFY row_number() OVER (PARTITION BY src, relation ORDER BY dst) <= 20), b1 AS (SELECT dst AS name, relation, src AS x FROM e JOIN n ON name = dst QUALIFY row_number() OVER (PARTITION BY dst, relation ORDER BY src) <= 20),
        a2 AS (SELECT name, relation, string_agg(x, '、' ORDER BY x) AS x FROM a1 GROUP BY ALL), b2 AS (SELECT name, relation, string_agg(x, '、' ORDER BY x) AS x FROM b1 GROUP BY ALL),
        a AS (SELECT name, name || chr(10) || string_agg('- ' || relation || ': ' || x, chr(10) ORDER BY relation) AS t FROM a2 GROUP BY name), b AS (SELECT name, name || chr(10) || string_agg('< ' || relation || ': ' || x, chr(10) ORDER BY relation) AS t FROM b2 GROUP BY name)
        SELECT name, sha256(concat_ws(chr(10) || chr(10), a.t, b.t)) AS sha FROM a FULL JOIN b USING (name)""",
    "ag28_traces": """
        WITH t AS (SELECT user_id, event_type, min(event_id) AS p FROM events WHERE event_id % 3 > 0 GROUP BY ALL), s AS (SELECT user_id, string_agg(event_type, ' + ' ORDER BY p) AS tools FROM t GROUP BY 1)
        SELECT u.user_id AS trace_id, coalesce(tools, '') AS tools, setting, chunk FROM (SELECT user_id, CAST(min(event_id) FILTER (event_id % 4 = 1) AS VARCHAR) AS setting, max(event_id) FILTER (event_id % 5 = 0) AS chunk FROM events GROUP BY 1) u LEFT JOIN s USING (user_id)""",
}
