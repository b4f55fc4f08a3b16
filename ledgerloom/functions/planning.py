"""Planning rules over questions and traces: needed records, tools, execution plans, evidence states, memory and error predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.functions.text import any_of, collapsed

# Markers, resource types, tool names and their words.
PERSONAL = ["我", "我的", "本人", "结合病历", "结合报告", "结合我的"]
NEEDS = [
    (["药", "服用", "剂量", "停药", "能不能吃", "可以吃", "正在吃"], ["AllergyIntolerance", "MedicationStatement", "Condition"]),
    (["检查", "报告", "指标", "血压", "血糖", "化验"], ["Observation", "DiagnosticReport"]),
    (["过敏", "禁忌"], ["AllergyIntolerance"]),
    (["病史", "诊断", "疾病"], ["Condition"]),
]
TOOLS = [
    (["过敏", "禁忌", "allerg"], ["get_patient_allergies"]),
    (["药", "服用", "用药", "剂量", "medication", "drug"], ["get_current_medications", "get_patient_allergies", "get_recent_conditions"]),
    (["病史", "疾病", "诊断", "condition", "diagnos"], ["get_recent_conditions"]),
    (["检查", "报告", "指标", "血压", "血糖", "体重", "心率", "体温", "化验", "observation", "lab"], ["get_latest_observations"]),
    (["趋势", "变化", "升高", "降低", "波动", "trend", "change"], ["get_observation_trend"]),
    (["病历", "病史", "报告", "检查单", "文档", "record", "report"], ["search_patient_record_text"]),
    (["时间线", "什么时候", "历次", "就诊记录", "timeline", "history"], ["get_patient_timeline"]),
    (["图谱", "时序", "关联", "temporal", "graph"], ["search_patient_temporal_graph"]),
]
GENERIC = (["我", "我的", "本人", "my ", "patient"], "get_patient_timeline")
ALLOWED = ["get_patient_allergies", "get_current_medications", "get_recent_conditions", "get_latest_observations", "get_patient_timeline", "search_patient_record_text", "get_observation_trend", "search_patient_temporal_graph"]
KNOWLEDGE, GRAPH = "search_knowledge_base", "search_medical_kg"
PLANS = {
    "symptom_assessment": [KNOWLEDGE, GRAPH],
    "general_medical_qa": [KNOWLEDGE, GRAPH],
    "medication_safety": [KNOWLEDGE, GRAPH, "get_patient_allergies", "get_current_medications"],
    "report_interpretation": [KNOWLEDGE, GRAPH, "get_latest_observations", "search_patient_record_text"],
    "patient_record_query": [KNOWLEDGE, "get_patient_allergies", "get_current_medications", "get_latest_observations", "search_patient_record_text"],
    "timeline_trend": [KNOWLEDGE, "get_latest_observations", "get_patient_timeline"],
    "health_task": ["create_health_reminder_draft"],
    "care_navigation": [KNOWLEDGE, "search_nearby_medical_care"],
    "urgent_care": [],
}
TRANSIENT = ["timeout", "timed out", "connection", "429", "502", "503", "504"]
PLACES = ["医院", "急诊", "医疗", "卫生院", "诊所", "门诊部", "医务室"]
SEMANTIC = ["长期服用", "正在吃", "正在用", "怀孕", "备孕", "哺乳", "不能吃", "不适合", "偏好", "希望回答", "回答简短"]
TERMINAL = ["completed", "cancelled", "failed"]


def strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def asks_for_records(text: Column, markers=PERSONAL) -> Column:
    return F.coalesce(any_of(text, markers), F.lit(False))


def required_types(text: Column, needs=NEEDS) -> Column:
    """Resource types of the rules whose words occur, each once, in order."""
    low = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[F.when(any_of(low, words), strings(types)).otherwise(strings([])) for words, types in needs])))


def tool_plan(text: Column, tools=TOOLS, generic=GENERIC, most: int = 5) -> Column:
    """Names of the tools of the rules whose words occur, each once, the first `most`; without any, the generic one for personal questions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.array_distinct(F.flatten(F.array(*[F.when(any_of(low, words), strings(names)).otherwise(strings([])) for words, names in tools])))
    return F.slice(F.when(F.size(named) > 0, named).when(any_of(low, generic[0]), strings([generic[1]])).otherwise(strings([])), 1, most)


def validated_plan(calls: Column, allowed=ALLOWED, most: int = 5) -> Column:
    """A model's calls array<struct<tool_name, argument, reason>>: of the first `most`, the allowed ones, each tool once, with bounded arguments.

    A query is cut at 4,000 characters, a code at 100, a reason at 200; a limit is from 1 to 100 and 50 where it isn't a number; other tools take none.
    """
    name = lambda c: c["tool_name"]
    limit = lambda c: F.least(F.greatest(F.coalesce(c["argument"].try_cast("int"), F.lit(50)), F.lit(1)), F.lit(100)).cast("string")
    bounded = lambda c: (
        F.when(name(c) == "search_patient_record_text", F.left(F.coalesce(c["argument"], F.lit("")), F.lit(4000)))
        .when(name(c) == "get_observation_trend", F.left(F.coalesce(c["argument"], F.lit("observation")), F.lit(100)))
        .when(name(c).isin("get_patient_timeline", "search_patient_temporal_graph"), limit(c))
        .otherwise("")
    )
    good = F.filter(F.slice(calls, 1, most), lambda c: name(c).isin(*allowed))
    first = F.filter(F.transform(good, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: F.array_position(F.transform(good, lambda g: g["tool_name"]), x["c"]["tool_name"]) == x["i"] + 1)
    return F.transform(first, lambda x: F.struct(name(x["c"]).alias("tool_name"), bounded(x["c"]).alias("argument"), F.left(F.coalesce(x["c"]["reason"], F.lit("llm_selected")), F.lit(200)).alias("reason")))


def execution_plan(intent: Column, writes: Column, plans=PLANS) -> Column:
    """struct<allowed_tools, parallel, requires_confirmation, write_requested> of an intent; unknown intents may search the knowledge base."""
    tools = F.when(F.lit(False), strings([]))
    for name, names in plans.items():
        tools = tools.when(intent == name, strings(names))
    tools = tools.otherwise(strings([KNOWLEDGE]))
    return F.struct(tools.alias("allowed_tools"), F.array_contains(tools, GRAPH).alias("parallel"), writes.alias("requires_confirmation"), (intent == "health_task").alias("write_requested"))


def evidence_state(high_risk: Column, missing: Column, conflict: Column, chunks: Column, graph_hits: Column, mode: Column, state: Column, action: Column) -> Column:
    """struct<state, action> of a finished trace, the first that holds: high risk, missing fields, conflict, evidence, none found, else as it was."""
    got = lambda s, a: F.struct(F.lit(s).alias("state"), F.lit(a).alias("action"))
    return (
        F.when(high_risk, got("HIGH_RISK", "ESCALATE_URGENT"))
        .when(missing > 0, got("PATIENT_DATA_MISSING", "ASK"))
        .when(conflict, got("CONFLICTING", "ANSWER"))
        .when((chunks > 0) | (F.coalesce(graph_hits, F.lit(0)) > 0), got("SUFFICIENT", "ANSWER"))
        .when(mode.isin("no_results", "unavailable"), got("NO_EVIDENCE", "REFUSE"))
        .otherwise(F.struct(F.coalesce(state, F.lit("PARTIAL")).alias("state"), F.coalesce(action, F.lit("ANSWER")).alias("action")))
    )


def graph_conflict(graph_hits: Column, polarities: Column) -> Column:
    """Whether the graph has hits while a document's polarity is negative or mixed."""
    return (F.coalesce(graph_hits, F.lit(0)) > 0) & F.exists(F.coalesce(polarities, strings([])), lambda p: p.isin("negative", "mixed"))


def is_transient(message: Column) -> Column:
    return any_of(F.lower(F.coalesce(message, F.lit(""))), TRANSIENT)


def is_medical_place(name: Column, kind: Column, terms=PLACES) -> Column:
    return any_of(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(kind, F.lit(""))), terms)


def worth_remembering(text: Column, markers=SEMANTIC) -> Column:
    return any_of(F.coalesce(text, F.lit("")), markers)


def event_summary(kind: Column, display: Column, value: Column, unit: Column) -> Column:
    """`kind: display = value unit`; without a value `kind: display`."""
    return F.when(value.isNull(), F.concat(kind, F.lit(": "), display)).otherwise(F.trim(F.concat(kind, F.lit(": "), display, F.lit(" = "), value, F.lit(" "), F.coalesce(unit, F.lit("")))))


def memory_texts(user: Column, session: Column, said: Column, answer: Column, markers=SEMANTIC) -> Column:
    """array<struct<memory_type, text>>: the episode of a turn, and the fact worth keeping if it has a marker; texts to 1,800 characters, answers to 800."""
    episode = F.concat(F.lit("用户 "), user, F.lit(" 在会话 "), session, F.lit(" 中提问："), said, F.lit("\n系统回答摘要："), F.left(answer, F.lit(800)))
    fact = F.concat(F.lit("用户 "), user, F.lit(" 的长期医疗相关事实或偏好："), said)
    doc = lambda kind, text: F.struct(F.lit(kind).alias("memory_type"), F.left(text, F.lit(1800)).alias("text"))
    return F.when(worth_remembering(said, markers), F.array(doc("episodic_memory", episode), doc("semantic_memory", fact))).otherwise(F.array(doc("episodic_memory", episode)))


def bundle_text(sections: Column, most: int = 3000) -> Column:
    """Sections that aren't empty, with blank lines between, cut at `most` characters."""
    return F.left(F.array_join(F.filter(sections, lambda s: F.coalesce(s, F.lit("")) != ""), "\n\n"), F.lit(most))


#: Rules in words of the synthetic tables, so that each branch is taken there.
_NEEDS = [(["ent"], ["A", "M", "C"]), (["and"], ["O", "D"]), (["der"], ["A"]), (["las"], ["C"])]
_TOOLS = [(["ent", "zzz"], ["t_a"]), (["ar"], ["t_m", "t_a", "t_c"]), (["las"], ["t_c"]), (["der"], ["t_o"]), (["el"], ["t_x"]), (["es"], ["t_y"])]


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def fl14_markers(spark, d):
    return _docs(spark, d).select("doc_id", asks_for_records(F.col("text"), ["mein", "der Sohn"]).alias("personal"), worth_remembering(F.col("text"), ["las ", "nicht"]).alias("remember"))


def fl15_transient(spark, d):
    e = read(spark, d, "events")
    said = F.get(F.array(*[F.lit(x) for x in ("Read Timeout", "HTTP 503", "bad input", "Connection reset", "")]), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", is_transient(said).alias("transient"))


def fl16_places(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", is_medical_place(F.col("p_name"), F.col("p_type"), ["STEEL", "SMALL", "almond"]).alias("medical"))


def fl19_open(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.get(F.array(*[F.lit(x) for x in ("active", "completed", "cancelled", "failed", "waiting")]), (F.col("o_orderkey") % 5).cast("int")).alias("status"))
    return o.where(~F.col("status").isin(*TERMINAL)).select("o_orderkey", "status")


def nd12_required_types(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(required_types(F.col("text"), _NEEDS), ",").alias("types"))


def nd13_tool_plan(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(tool_plan(F.col("text"), _TOOLS, (["a"], "t_g"), 4), ",").alias("tools"))


def nd13_validated(spark, d):
    """Calls made of a conversation's turns: names in turn order, some of them unknown or repeated."""
    names = [*ALLOWED[:6], "drop_tables", "get_patient_timeline"]
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("t"))
    calls = F.transform("t", lambda x: F.struct(F.get(strings(names), (x["n"] % 8).cast("int")).alias("tool_name"), F.when(x["n"] % 3 > 0, (x["n"] * 2).cast("string")).alias("argument"), F.when(x["n"] % 2 == 0, F.lit("why")).alias("reason")))
    got = F.transform(validated_plan(calls), lambda c: F.concat_ws(":", c["tool_name"], c["argument"], c["reason"]))
    return c.select("conv_id", F.array_join(got, ",").alias("calls"))


def nd11_execution_plan(spark, d):
    e = read(spark, d, "events").select("event_id", F.get(strings([*PLANS, "other"]), (F.col("event_id") % 10).cast("int")).alias("intent"))
    return e.select("event_id", execution_plan(F.col("intent"), F.col("event_id") % 2 == 0).alias("p")).select("event_id", F.array_join("p.allowed_tools", ",").alias("tools"), "p.parallel", "p.requires_confirmation", "p.write_requested")


def nd9_evidence_state(spark, d):
    e, n = read(spark, d, "events"), F.col("event_id")
    mode = F.get(strings(["hybrid", "no_results", "unavailable"]), (n % 3).cast("int"))
    s = evidence_state(n % 11 == 0, F.when(n % 7 == 0, 1).otherwise(0), n % 5 == 0, F.when(n % 4 == 0, 2).otherwise(0), F.when(n % 9 == 0, 1), mode, F.when(n % 2 == 0, F.lit("KEPT")), F.lit(None).cast("string"))
    return e.select("event_id", s.alias("s")).select("event_id", "s.state", "s.action")


def nd8_graph_conflict(spark, d):
    from ledgerloom.operators.evidence import polarity

    docs = _docs(spark, d).groupBy((F.col("doc_id") % 200).alias("query_id")).agg(F.collect_set(polarity(F.col("text"), ["there"], ["tion"])).alias("p"))
    return docs.select("query_id", graph_conflict(F.when(F.col("query_id") % 3 > 0, F.col("query_id") % 5), F.col("p")).alias("conflict"))


def tx21_summary(spark, d):
    e = read(spark, d, "events")
    return e.select("event_id", event_summary(F.lit("Observation"), F.col("event_type"), F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")), F.when(F.col("event_id") % 2 == 0, F.lit("ms"))).alias("summary"))


def tx22_memory(spark, d):
    c = read(spark, d, "conversations")
    m = memory_texts(F.col("role"), F.col("conv_id").cast("string"), F.coalesce("text", F.lit("")), F.repeat(F.coalesce("text", F.lit("")), 3), ["las", "der"])
    return c.select("conv_id", "turn", F.explode(m).alias("m")).select("conv_id", "turn", "m.memory_type", F.sha2("m.text", 256).alias("sha"), F.length("m.text").cast("bigint").alias("n"))


def tx20_bundle(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", collapsed(F.coalesce("text", F.lit("")))).alias("s")))).alias("t"))
    return c.select("conv_id", F.sha2(bundle_text(F.transform("t", lambda x: F.when(x["turn"] != 1, x["s"]))), 256).alias("sha"))


QUERIES = {f.__name__: f for f in (fl14_markers, fl15_transient, fl16_places, fl19_open, nd12_required_types, nd13_tool_plan, nd13_validated, nd11_execution_plan, nd9_evidence_state, nd8_graph_conflict, tx21_summary, tx22_memory, tx20_bundle)}
_has = lambda c, ts: "(" + " OR ".join(f"contains({c}, '{t}')" for t in ts) + ")"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_rules = lambda c, rules: "flatten([" + ", ".join(f"CASE WHEN {_has(c, w)} THEN {_list(t)} ELSE []::VARCHAR[] END" for w, t in rules) + "])"
_distinct = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
SQL = {
    "fl14_markers": f"SELECT doc_id, coalesce({_has('text', ['mein', 'der Sohn'])}, false) AS personal, {_has('coalesce(text, chr(32))', ['las ', 'nicht'])} AS remember FROM documents",
    "fl15_transient": "SELECT event_id, event_id % 5 IN (0, 1, 3) AS transient FROM events",
    "fl16_places": f"SELECT p_partkey, {_has(chr(34) + 't' + chr(34), ['STEEL', 'SMALL', 'almond'])} AS medical FROM (SELECT p_partkey, p_name || ' ' || p_type AS t FROM part)",
    "fl19_open": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'active' ELSE 'waiting' END AS status FROM orders WHERE o_orderkey % 5 IN (0, 4)",
    "nd12_required_types": f"WITH x AS (SELECT doc_id, {_rules('coalesce(text, chr(32))', _NEEDS)} AS t FROM documents) SELECT doc_id, array_to_string({_distinct('t')}, ',') AS types FROM x",
    "nd13_tool_plan": f"WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), x AS (SELECT doc_id, low, {_rules('low', _TOOLS)} AS t FROM l), y AS (SELECT doc_id, low, {_distinct('t')} AS t FROM x) SELECT doc_id, array_to_string((CASE WHEN len(t) > 0 THEN t WHEN contains(low, 'a') THEN ['t_g'] ELSE []::VARCHAR[] END)[1:4], ',') AS tools FROM y",
    "nd13_validated": f"""
        WITH t AS (SELECT conv_id, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS i FROM conversations),
        c AS (SELECT conv_id, i, n, list_extract({_list([*ALLOWED[:6], "drop_tables", "get_patient_timeline"])}, (n % 8 + 1)::INT) AS tool FROM t WHERE i <= 5),
        k AS (SELECT * FROM c WHERE tool IN ({", ".join(f"'{x}'" for x in ALLOWED)}) QUALIFY row_number() OVER (PARTITION BY conv_id, tool ORDER BY i) = 1),
        s AS (SELECT conv_id, i, concat_ws(':', tool, CASE tool WHEN 'search_patient_record_text' THEN CASE WHEN n % 3 > 0 THEN CAST(n * 2 AS VARCHAR) ELSE '' END WHEN 'get_patient_timeline' THEN CAST(least(greatest(CASE WHEN n % 3 > 0 THEN n * 2 ELSE 50 END, 1), 100) AS VARCHAR) ELSE '' END, CASE WHEN n % 2 = 0 THEN 'why' ELSE 'llm_selected' END) AS s FROM k)
        SELECT conv_id, coalesce(string_agg(s, ',' ORDER BY i), '') AS calls FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN s USING (conv_id) GROUP BY conv_id""",
    "nd11_execution_plan": "SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{','.join(t)}'" for i, t in enumerate(PLANS.values())) + f" ELSE '{KNOWLEDGE}' END AS tools, event_id % 10 IN ({', '.join(str(i) for i, t in enumerate(PLANS.values()) if GRAPH in t)}) AS parallel, event_id % 2 = 0 AS requires_confirmation, event_id % 10 = {list(PLANS).index('health_task')} AS write_requested FROM events",
    "nd9_evidence_state": """
        WITH s AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'HIGH_RISK' WHEN event_id % 7 = 0 THEN 'PATIENT_DATA_MISSING' WHEN event_id % 5 = 0 THEN 'CONFLICTING' WHEN event_id % 4 = 0 OR event_id % 9 = 0 THEN 'SUFFICIENT' WHEN event_id % 3 > 0 THEN 'NO_EVIDENCE' WHEN event_id % 2 = 0 THEN 'KEPT' ELSE 'PARTIAL' END AS state FROM events)
        SELECT event_id, state, CASE state WHEN 'HIGH_RISK' THEN 'ESCALATE_URGENT' WHEN 'PATIENT_DATA_MISSING' THEN 'ASK' WHEN 'NO_EVIDENCE' THEN 'REFUSE' ELSE 'ANSWER' END AS action FROM s""",
    "nd8_graph_conflict": "SELECT doc_id % 200 AS query_id, (CASE WHEN (doc_id % 200) % 3 > 0 THEN (doc_id % 200) % 5 ELSE 0 END) > 0 AND bool_or(contains(lower(coalesce(text, '')), 'there')) AS conflict FROM documents GROUP BY doc_id % 200",
    "tx21_summary": "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN trim('Observation: ' || event_type || ' = ' || user_id || ' ' || CASE WHEN event_id % 2 = 0 THEN 'ms' ELSE '' END) ELSE 'Observation: ' || event_type END AS summary FROM events",
    "tx22_memory": """
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
        m AS (SELECT conv_id, turn, 'episodic_memory' AS memory_type, left('用户 ' || role || ' 在会话 ' || conv_id || ' 中提问：' || t || chr(10) || '系统回答摘要：' || left(repeat(t, 3), 800), 1800) AS x FROM c
              UNION ALL SELECT conv_id, turn, 'semantic_memory', left('用户 ' || role || ' 的长期医疗相关事实或偏好：' || t, 1800) FROM c WHERE contains(t, 'las') OR contains(t, 'der'))
        SELECT conv_id, turn, memory_type, sha256(x) AS sha, length(x) AS n FROM m""",
    "tx20_bundle": r"SELECT conv_id, sha256(left(coalesce(string_agg(role || ': ' || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) FILTER (turn <> 1), ''), 3000)) AS sha FROM conversations GROUP BY 1",
}
