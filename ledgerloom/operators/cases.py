"""Evaluation cases: conversion, selection, scoring of answers and retrieval, summaries and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.functions.text import fingerprint, let
from ledgerloom.operators import retrieval
from ledgerloom.operators.lexical import bm25
from ledgerloom.operators.retrieval import gold_by_containment, unique_ranking

CUTOFFS = [1, 3, 5, 10]
KEYS = ["answer", "choice", "option", "label"]


def norm_key(c: Column) -> Column:
    """Lower case, without white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")


def norm_answer(c: Column) -> Column:
    """Lower case, collapsed, without punctuation."""
    flat = F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(flat, r"(?U)[^\w\s]", ""))


def norm_text(c: Column) -> Column:
    """Lower case and collapsed."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def choice_accuracy(prediction: Column, gold: Column) -> Column:
    """1.0 or 0.0: whether the answer names the gold letter; null where gold isn't a single letter."""
    g, p = norm_answer(gold), norm_answer(prediction)
    alone = F.regexp_extract(p, r"(?:^|\s)([a-z])(?:\s|$)", 1)
    told = F.regexp_extract(p, r"\b(?:answer|option)\s*(?:is|:)?\s*([a-z])\b", 1)
    return F.when(g.rlike("^[a-z]$"), (F.when(alone != "", alone).otherwise(told) == g).cast("double"))


def extract_choice(text: Column, options: Column) -> Column:
    """Label of a multiple-choice answer, or null. options: array<struct<label, text>>.

    In turn: a field of a JSON object; the words answer, choice, option and a letter; a letter at the start; any letter alone; yes, no or maybe if
    that is an option's text; an option's text inside the answer. Only labels of the options count.
    """
    text, labels = F.coalesce(text, F.lit("")), F.transform(options, lambda o: o["label"])
    json = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    named = F.coalesce(*[F.nullif(F.left(F.upper(F.trim(F.get_json_object(json, f"$.{k}"))), F.lit(1)), F.lit("")) for k in KEYS])
    ok = lambda x: F.when(F.array_contains(labels, x), x)
    patterns = [r"(?i)(?:answer|choice|option|答案|选项)\s*(?:is|:|为|是)?\s*[\(\[]?\s*([A-Z])\s*[\)\]]?", r"(?i)^\s*[\(\[]?\s*([A-Z])\s*[\)\]]?[\s\.:：、-]", r"(?i)\b([A-Z])\b"]
    found = [F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda m: F.upper(m)), lambda m: F.array_contains(labels, m)), F.lit(0)) for p in patterns]
    low = norm_text(text)
    by_text = lambda want: F.get(F.transform(F.filter(F.reverse(options), lambda o: norm_text(o["text"]) == want), lambda o: o["label"]), F.lit(0))
    words = [F.when(low.rlike(rf"\b{w}\b"), by_text(F.lit(w))) for w in ("yes", "no", "maybe")]
    inside = F.get(F.transform(F.filter(options, lambda o: (norm_text(o["text"]) != "") & F.contains(low, norm_text(o["text"]))), lambda o: o["label"]), F.lit(0))
    return F.coalesce(ok(named), *found, *words, inside)


def scored_record(text: Column, options: Column, gold: Column) -> Column:
    """struct<predicted, is_valid, is_correct>."""
    return let(F.struct(extract_choice(text, options).alias("p")), lambda s: F.struct(s["p"].alias("predicted"), s["p"].isNotNull().alias("is_valid"), F.coalesce(s["p"] == F.upper(F.trim(gold)), F.lit(False)).alias("is_correct")))


def judged(scores: dict[str, Column], rationale: Column) -> Column:
    """A judge's scores, clamped to 0..1, with their mean as `quality` and the rationale cut at 800 characters; null where one is missing or no number."""
    clamp = {k: F.round(F.least(F.greatest(c.try_cast("double"), F.lit(0.0)), F.lit(1.0)), 6) for k, c in scores.items()}
    total = sum(clamp.values(), F.lit(0.0))
    out = F.struct(*[c.alias(k) for k, c in clamp.items()], F.round(total / len(clamp), 6).alias("quality"), F.left(F.trim(F.coalesce(rationale, F.lit(""))), F.lit(800)).alias("rationale"))
    missing = F.lit(False)
    for c in scores.values():
        missing = missing | c.try_cast("double").isNull() | F.isnan(c.try_cast("double"))
    return F.when(~missing, out)


def finite_mean(scores: Column) -> Column:
    """Mean of the finite scores of an array, six places; null without any."""
    ok = F.filter(scores, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.round(F.try_divide(F.aggregate(ok, F.lit(0.0), lambda a, x: a + x), F.size(ok)), 6)


def convert(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (row_idx, question, context, reference, page, answer): (corpus, cases).

    The corpus has each context once, under an id made of reference, page and context, with the first row's fields and no answers. Cases hold the gold id. Rows
    without question or context go.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))
    r = rows.select("row_idx", *[flat(c).alias(c) for c in ("question", "context", "reference", "page", "answer")]).where("question <> '' and context <> ''")
    r = r.withColumn("document_id", F.concat(F.lit("doc-"), F.left(fingerprint(F.col("reference"), F.col("page"), F.col("context")), F.lit(24))))
    r = r.withColumn("query_id", F.concat(F.lit("q-"), F.left(fingerprint(F.col("row_idx"), F.col("question"), F.col("document_id")), F.lit(24))))
    number = F.coalesce(F.nullif(F.regexp_extract("page", r"\d+", 0), F.lit("")).try_cast("int"), F.lit(0))
    corpus = r.groupBy("document_id").agg(F.min_by(F.struct(F.col("context").alias("text"), "reference", "page", number.alias("page_number")), "row_idx").alias("x")).select("document_id", "x.*")
    return corpus, r.select("query_id", "row_idx", "question", F.array("document_id").alias("gold_document_ids"), F.col("answer").alias("gold_answer"))


def selected(records: DataFrame, baselines: list[str], most: int = 0) -> DataFrame:
    """records (row_idx, baseline, answer): those of the baselines that have an answer, the first `most` of each by row (0: all)."""
    out = records.where(F.col("baseline").isin(*baselines) & (F.coalesce("answer", F.lit("")) != ""))
    if not most:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("baseline").orderBy("row_idx"))).where(F.col("_n") <= most).drop("_n")


def recall_at(hits: DataFrame, gold: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """Per query of `gold` (query_id, doc_id): recall among the first n distinct documents for each cutoff, and the reciprocal of the first gold rank."""
    met = unique_ranking(hits).join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(*[F.count_if(F.col("rank") <= n).alias(f"n{n}") for n in cutoffs], F.min("rank").alias("first"))
    size = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    return size.join(met, "query_id", "left").select("query_id", *[F.round(F.coalesce(F.col(f"n{n}"), F.lit(0)) / F.col("n_gold"), 6).alias(f"recall_at_{n}") for n in cutoffs], F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def matched(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hits (query_id, rank, haystacks array), expected (query_id, item): (query_id, item, rank) of the first hit that contains the item or is contained in it, normalised.

    A query has few hits and items, so only those of one query meet.
    """
    keys = F.filter(F.transform("haystacks", norm_key), lambda h: h != "")
    one = hits.select("query_id", "rank", keys.alias("h")).join(expected.select("query_id", "item", norm_key(F.col("item")).alias("needle")).where("needle <> ''"), "query_id")
    return one.where(F.exists("h", lambda h: F.contains(h, F.col("needle")) | F.contains(F.col("needle"), h))).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))


def legacy_metrics(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query with expected items: recall, whether any was hit, reciprocal of the first rank that matches."""
    n = expected.where("coalesce(item, '') <> ''").groupBy("query_id").agg(F.count_distinct("item").alias("n"))
    got = matched(hits, expected).groupBy("query_id").agg(F.count("*").alias("m"), F.min("rank").alias("first"))
    return n.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("m", F.lit(0)) / F.col("n"), 6).alias("recall_at_k"), F.when(F.col("m") > 0, 1.0).otherwise(0.0).alias("hit_rate"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def averages(rows: DataFrame, metrics: list[str], places: int = 4) -> DataFrame:
    """Number of rows, and the mean of each metric over the rows that have it."""
    return rows.agg(F.count("*").alias("cases"), *[F.round(F.avg(m), places).alias(f"avg_{m}") for m in metrics])


def nested_means(records: DataFrame, keys: list[str], containers: list[str]) -> DataFrame:
    """Means, six places, of metrics that stand in a column or in maps of a record, the first that has it; records without it don't count."""
    value = lambda k: F.coalesce(*([F.col(k).try_cast("double")] if k in records.columns else []), *[F.try_element_at(F.col(c), F.lit(k)).try_cast("double") for c in containers])
    return records.agg(F.count("*").alias("cases"), *[F.round(F.avg(value(k)), 6).alias(k) for k in keys])


def policy_summary(rows: DataFrame) -> DataFrame:
    """rows (case_id, passed, expected_action, action, and checks): pass rate, accuracies, recall of urgent and of asking cases, and how many failed."""
    checks = [c for c in rows.columns if c.endswith("_correct")]
    recall = lambda action: F.round(F.try_divide(F.count_if((F.col("expected_action") == action) & (F.col("action") == action)), F.count_if(F.col("expected_action") == action)), 4)
    return rows.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"), *[F.round(F.avg(F.col(c).cast("int")), 4).alias(c.replace("_correct", "_accuracy")) for c in checks], recall("ESCALATE_URGENT").alias("high_risk_recall"), recall("ASK").alias("missing_information_recall"), F.count_if(~F.col("passed")).alias("failed"))


def router_report(rows: DataFrame, urgent: str = "urgent_care") -> DataFrame:
    """rows (expected, predicted, high_risk, write_expected, write, latency): accuracy, recall of high risk, rate of false writes, latencies; accepted if all hold."""
    one = rows.agg(
        F.count("*").alias("cases"),
        F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 4).alias("accuracy"),
        F.round(F.try_divide(F.count_if(F.col("high_risk") & (F.col("predicted") == urgent)), F.count_if("high_risk")), 4).alias("high_risk_recall"),
        F.round(F.try_divide(F.count_if(~F.col("write_expected") & F.col("write")), F.count("*")), 4).alias("false_write_rate"),
        F.round(F.avg("latency"), 3).alias("mean_latency"),
        F.round(F.max("latency"), 3).alias("max_latency"),
    )
    return one.withColumn("accepted", (F.col("accuracy") >= 0.97) & F.coalesce(F.col("high_risk_recall") == 1.0, F.lit(False)) & (F.col("false_write_rate") == 0.0))


def readiness(cases: DataFrame, by: str) -> DataFrame:
    """cases (by, status, clinical): number, approved ones, whether all are, and whether all are and need clinical review."""
    g = cases.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(F.col("status") == "approved").alias("approved"), F.bool_and("clinical").alias("_c"))
    ready = F.col("cases") == F.col("approved")
    return g.select(by, "cases", "approved", ready.alias("ready"), (ready & F.col("_c")).alias("clinical_claim_allowed"))


def frozen_errors(cases: DataFrame, required: list[str], count: int, id_col: str = "case_id") -> DataFrame:
    """(error, n) of a frozen set: a wrong number of cases, ids that occur twice, required fields that are null."""
    one = cases.agg(F.abs(F.count("*") - count).alias("wrong_count"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required])
    names = one.columns
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("error"), F.col(c).alias("n")) for c in names])).alias("e")).where("e.n > 0").select("e.error", "e.n")


def trace_summary(turns: DataFrame) -> DataFrame:
    """turns (state, mode, failed, statuses array, latencies array): turns, rates of fallback and of no evidence, tool calls and their success."""
    calls = F.coalesce(F.size("statuses"), F.lit(0))
    ok = F.size(F.filter("statuses", lambda s: s == "ok"))
    return turns.agg(F.count("*").alias("turns"), F.round(F.avg(F.col("failed").cast("int")), 4).alias("fallback_rate"), F.round(F.avg((F.coalesce("state", F.lit("UNKNOWN")) == "NO_EVIDENCE").cast("int")), 4).alias("no_evidence_rate"), F.sum(calls).alias("tool_calls"), F.round(F.try_divide(F.sum(ok), F.sum(calls)), 4).alias("tool_success_rate"))


# queries


def _hits(spark, d, k):
    return bm25(retrieval._corpus(spark, d), retrieval._passages(spark, d), k)


def tx5_normalizers(spark, d):
    t = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return t.select("conv_id", "turn", F.sha2(norm_key(F.col("text")), 256).alias("key"), F.sha2(norm_text(F.col("text")), 256).alias("flat"), F.sha2(norm_answer(F.regexp_replace("text", "[^ -~\n]", "")), 256).alias("answer"))


def ev3_choice(spark, d):
    e = read(spark, d, "events")
    letter = F.chr(F.lit(97) + F.col("event_id") % 4)
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("The answer is "), letter, F.lit("."))).when(F.col("event_type") == "view", F.concat(F.lit("Option "), F.upper(letter))).when(F.col("event_type") == "error", F.lit("none of these")).otherwise(F.concat(letter, F.lit(") because")))
    gold = F.when(F.col("event_id") % 5 == 0, F.lit("two words")).when(F.col("event_id") % 3 == 0, F.lit("B.")).otherwise(F.concat(letter, F.lit(".")))
    return e.select("event_id", choice_accuracy(said, gold).alias("accuracy"))


def ev5_scored(spark, d):
    e = read(spark, d, "events")
    n = F.col("event_id")
    options = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(t).alias("text")) for x, t in (("A", "Yes"), ("B", "no"), ("C", "Heart failure"))])
    letter = F.get(F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit("D")), (n % 4).cast("int"))
    said = F.get(F.array(F.concat(F.lit('```json\n{"choice": "'), F.lower(letter), F.lit('"}\n```')), F.concat(F.lit("answer: ("), letter, F.lit(")")), F.concat(letter, F.lit(". so it is")), F.lit("well, no"), F.lit("it must be heart  failure"), F.lit("unknown to me"), F.lit(None)), (n % 7).cast("int"))
    s = scored_record(said, options, F.when(n % 2 == 0, F.lit(" b ")).otherwise(F.lit("C")))
    return e.select("event_id", s.alias("s")).select("event_id", "s.predicted", "s.is_valid", "s.is_correct")


def ev6_judged(spark, d):
    e = read(spark, d, "events")
    s = judged({"context": F.col("value") / 100, "faithful": F.when(F.col("event_id") % 9 > 0, F.col("user_id") / 10.0), "answer": F.lit(-1.0)}, F.concat(F.lit(" why "), F.col("event_type")))
    return e.select("event_id", s.alias("s")).select("event_id", "s.context", "s.faithful", "s.quality", "s.rationale")


def ev7_case_mean(spark, d):
    n = F.col("event_id")
    return read(spark, d, "events").select("event_id", finite_mean(F.array(F.when(n % 2 == 0, F.col("value")), F.when(n % 3 == 0, F.lit(float("nan"))), F.when(n % 5 == 0, F.lit(float("inf"))), F.when(n % 4 == 0, F.lit(1.5)))).alias("mean"))


def _rows(spark, d):
    c = read(spark, d, "documents")
    return c.select(F.col("doc_id").alias("row_idx"), F.when(F.col("doc_id") % 10 > 0, F.concat(F.lit("Q "), F.col("doc_id") % 50)).alias("question"), F.col("text").alias("context"), F.col("source").alias("reference"), F.concat(F.lit("p. "), F.col("n_chars") % 9).alias("page"), F.lit("a").alias("answer"))


def ev10_corpus(spark, d):
    return convert(_rows(spark, d))[0].select("document_id", "reference", "page_number", F.sha2("text", 256).alias("sha"))


def ev10_cases(spark, d):
    return convert(_rows(spark, d))[1].select("query_id", "row_idx", "question", F.get("gold_document_ids", F.lit(0)).alias("gold"))


def ev1_recalls(spark, d):
    return recall_at(_hits(spark, d, 10), gold_by_containment(retrieval._corpus(spark, d), retrieval._passages(spark, d)))


def _legacy(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit(" "), F.col("doc_id")).alias("filename"), F.col("text").alias("body"))
    hits = _hits(spark, d, 5).join(docs, "doc_id").select("query_id", "rank", F.array(F.concat_ws("|", "filename", F.lit("0")), "filename", "body").alias("haystacks"))
    q = retrieval._passages(spark, d)
    return hits, q.select("query_id", F.explode(F.array(F.translate("text", "aeiost", "AEIOST"), F.left("text", F.lit(20)), F.lit("web 3"))).alias("item"))


def ag21_legacy(spark, d):
    return legacy_metrics(*_legacy(spark, d))


def j7_matched(spark, d):
    return matched(*_legacy(spark, d)).select("query_id", F.sha2("item", 256).alias("item"), "rank")


def ag22_averages(spark, d):
    return averages(legacy_metrics(*_legacy(spark, d)), ["recall_at_k", "hit_rate", "mrr"])


def ag12_nested(spark, d):
    n = F.col("event_id")
    e = read(spark, d, "events").select(F.when(n % 3 == 0, F.col("value")).alias("recall"), F.create_map(F.lit("recall"), F.col("user_id").cast("string"), F.lit("mrr"), F.when(n % 2 == 0, F.lit("0.25")).otherwise("x")).alias("retrieval"), F.create_map(F.lit("f1"), F.lit("0.5")).alias("answer"))
    return nested_means(e, ["recall", "mrr", "f1", "none"], ["retrieval", "answer"])


def ag8_policy(spark, d):
    n = F.col("event_id")
    names = F.array(F.lit("ESCALATE_URGENT"), F.lit("ASK"), F.lit("ANSWER"))
    e = read(spark, d, "events").select(n.alias("case_id"), F.get(names, (n % 3).cast("int")).alias("expected_action"), F.get(names, ((n + (n % 10 == 0).cast("int")) % 3).cast("int")).alias("action"), (n % 7 > 0).alias("sources_correct"))
    e = e.withColumn("action_correct", F.col("expected_action") == F.col("action"))
    return policy_summary(e.withColumn("passed", F.col("action_correct") & F.col("sources_correct")))


def ag15_router(spark, d):
    n = F.col("event_id")
    e = read(spark, d, "events").select(F.when(n % 4 == 0, "urgent_care").otherwise("qa").alias("expected"), F.when((n % 4 == 0) & (n % 100 > 0), "urgent_care").otherwise("qa").alias("predicted"), (n % 4 == 0).alias("high_risk"), (n % 6 == 0).alias("write_expected"), (n % 9 == 0).alias("write"), F.col("value").alias("latency"))
    return router_report(e)


def ag17_readiness(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("dataset"), F.when((F.col("c_nationkey") % 2 == 0) | (F.col("c_custkey") % 3 > 0), "approved").otherwise("draft").alias("status"), ((F.col("c_nationkey") % 4 == 0) | (F.col("c_custkey") % 5 > 0)).alias("clinical"))
    return readiness(c, "dataset")


def ev11_frozen(spark, d):
    c = read(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("case_id"), F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderpriority")).alias("query"), F.col("o_orderstatus").alias("stratum"))
    return frozen_errors(c, ["query", "stratum"], 100)


def ag7_traces(spark, d):
    n = F.col("event_id")
    t = read(spark, d, "events").select(F.when(n % 5 > 0, F.when(n % 3 == 0, "NO_EVIDENCE").otherwise("SUFFICIENT")).alias("state"), F.lit("hybrid").alias("mode"), (n % 8 == 0).alias("failed"), F.when(n % 2 == 0, F.array(F.lit("ok"), F.when(n % 4 == 0, "error").otherwise("ok"))).alias("statuses"), F.lit(None).cast("array<double>").alias("latencies"))
    return trace_summary(t)


def fl12_selected(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("baseline"), F.when(F.col("o_orderkey") % 3 > 0, "x").alias("answer"))
    return selected(o, ["1-URGENT", "2-HIGH"], 25).select("row_idx", "baseline")


def wn14_first_examples(spark, d):
    """The first of the examples with one text."""
    c = read(spark, d, "documents").select("doc_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    return c.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


def ev13_case(spark, d):
    """Legacy metrics and groundedness of the passage in its hits."""
    from ledgerloom.operators.evidence import groundedness

    docs = read(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    context = _hits(spark, d, 3).join(docs, "doc_id").groupBy("query_id").agg(F.count("*").alias("retrieved"), F.array_join(F.collect_list("body"), "\n").alias("context"))
    g = context.join(retrieval._passages(spark, d), "query_id").select("query_id", "retrieved", groundedness(F.col("text"), F.col("context")).alias("groundedness"))
    return legacy_metrics(*_legacy(spark, d)).join(g, "query_id").select("query_id", "recall_at_k", "mrr", "retrieved", "groundedness")


QUERIES = {f.__name__: f for f in (tx5_normalizers, ev3_choice, ev5_scored, ev6_judged, ev7_case_mean, ev10_corpus, ev10_cases, ev1_recalls, ag21_legacy, j7_matched, ag22_averages, ag12_nested, ag8_policy, ag15_router, ag17_readiness, ev11_frozen, ag7_traces, fl12_selected, wn14_first_examples, ev13_case)}
_S = r"regexp_replace({}, '\s+', '{}', 'g')"
_H = f"h AS (SELECT a.query_id, rank, source || ' ' || doc_id AS f, text FROM a JOIN documents d USING (doc_id))"
_K = lambda c: rf"regexp_replace(lower(coalesce({c}, '')), '\s+', '', 'g')"
_LEGACY = f"""{retrieval.bm25_sql("a", retrieval._D, retrieval._Q, 5)}, {_H}, x AS (SELECT item_id AS query_id, unnest([translate(text, 'aeiost', 'AEIOST'), left(text, 20), 'web 3']) AS item FROM benchmark),
    n AS (SELECT *, {_K("item")} AS k FROM x), hk AS (SELECT query_id, rank, list_filter([{_K("f || '|0'")}, {_K("f")}, {_K("text")}], lambda h: h <> '') AS hs FROM h),
    m AS (SELECT query_id, item, min(rank) AS rank FROM n JOIN hk USING (query_id) WHERE k <> '' AND len(list_filter(hs, lambda h: contains(h, k) OR contains(k, h))) > 0 GROUP BY ALL),
    lg AS (SELECT query_id, round(count(m.item) / count(*), 6) AS recall_at_k, CASE WHEN count(m.item) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS mrr FROM (SELECT DISTINCT query_id, item FROM n) LEFT JOIN m USING (query_id, item) GROUP BY 1)"""
_FLAT = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
_ROWS = f"""r0 AS (SELECT doc_id AS row_idx, CASE WHEN doc_id % 10 > 0 THEN 'Q ' || (doc_id % 50) ELSE '' END AS question, {_FLAT.format("text")} AS context, source AS reference, 'p. ' || (n_chars % 9) AS page, n_chars % 9 AS page_number FROM documents),
    r AS (SELECT *, 'doc-' || left(sha256(reference || chr(31) || page || chr(31) || context), 24) AS document_id FROM r0 WHERE question <> '' AND context <> '')"""
SQL = {
    "tx5_normalizers": rf"SELECT conv_id, turn, sha256({_K('text')}) AS key, sha256(regexp_replace(lower(trim(coalesce(text, ''))), '\s+', ' ', 'g')) AS flat, sha256(trim(regexp_replace(regexp_replace(trim(lower(regexp_replace(coalesce(text, ''), '[^ -~\n]', '', 'g'))), '\s+', ' ', 'g'), '[^\w\s]', '', 'g'))) AS answer FROM conversations",
    "ev3_choice": "WITH e AS (SELECT event_id, event_type, event_id % 4 AS l, CASE WHEN event_id % 3 = 0 THEN 1 ELSE event_id % 4 END AS g FROM events) SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_type = 'error' THEN 0.0 WHEN l = g THEN 1.0 ELSE 0.0 END::DOUBLE AS accuracy FROM e",
    "ev5_scored": """
        WITH e AS (SELECT event_id, ['A', 'B', 'C', 'D'][event_id % 4 + 1] AS l, event_id % 7 AS k FROM events),
        p AS (SELECT event_id, CASE WHEN k IN (0, 1, 2) AND l <> 'D' THEN l WHEN k IN (3, 5) THEN 'B' WHEN k = 4 THEN 'C' END AS predicted FROM e)
        SELECT event_id, predicted, predicted IS NOT NULL AS is_valid, coalesce(predicted = CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'C' END, false) AS is_correct FROM p""",
    "ev6_judged": """
        WITH e AS (SELECT event_id, round(least(greatest(value / 100, 0), 1), 6) AS c, round(least(greatest(user_id / 10.0::DOUBLE, 0), 1), 6) AS f, 'why ' || event_type AS r, event_id % 9 > 0 AS ok FROM events)
        SELECT event_id, CASE WHEN ok THEN c END AS context, CASE WHEN ok THEN f END AS faithful, CASE WHEN ok THEN round((c + f + 0) / 3, 6) END AS quality, CASE WHEN ok THEN r END AS rationale FROM e""",
    "ev7_case_mean": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN round((value + 1.5::DOUBLE) / 2, 6) WHEN event_id % 2 = 0 THEN round(value, 6) END AS mean FROM events",
    "ev10_corpus": f"WITH {_ROWS} SELECT document_id, arg_min(reference, row_idx) AS reference, arg_min(page_number, row_idx) AS page_number, sha256(arg_min(context, row_idx)) AS sha FROM r GROUP BY document_id",
    "ev10_cases": f"WITH {_ROWS} SELECT 'q-' || left(sha256(row_idx || chr(31) || question || chr(31) || document_id), 24) AS query_id, row_idx, question, document_id AS gold FROM r",
    "ev1_recalls": f"""WITH {retrieval.bm25_sql("a", retrieval._D, retrieval._Q, 10)}, gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
        g AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), m AS (SELECT query_id, {", ".join(f"count(*) FILTER (rank <= {n}) AS n{n}" for n in CUTOFFS)}, min(rank) AS first FROM a JOIN gold USING (query_id, doc_id) GROUP BY 1)
        SELECT query_id, {", ".join(f"round(coalesce(n{n}, 0) / n, 6) AS recall_at_{n}" for n in CUTOFFS)}, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM g LEFT JOIN m USING (query_id)""",
    "ag21_legacy": f"WITH {_LEGACY} SELECT * FROM lg",
    "j7_matched": f"WITH {_LEGACY} SELECT query_id, sha256(item) AS item, rank FROM m",
    "ag22_averages": f"WITH {_LEGACY} SELECT count(*) AS cases, round(avg(recall_at_k), 4) AS avg_recall_at_k, round(avg(hit_rate), 4) AS avg_hit_rate, round(avg(mrr), 4) AS avg_mrr FROM lg",
    "ag12_nested": "SELECT count(*) AS cases, round(avg(CASE WHEN event_id % 3 = 0 THEN value ELSE user_id END), 6) AS recall, round(avg(0.25::DOUBLE) FILTER (event_id % 2 = 0), 6) AS mrr, 0.5::DOUBLE AS f1, NULL::DOUBLE AS none FROM events",
    "ag8_policy": """
        WITH e AS (SELECT event_id % 3 AS x, (event_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) % 3 AS a, event_id % 7 > 0 AS s FROM events)
        SELECT count(*) AS cases, round(avg((x = a AND s)::INT), 4) AS pass_rate, round(avg(s::INT), 4) AS sources_accuracy, round(avg((x = a)::INT), 4) AS action_accuracy, round(count(*) FILTER (x = 0 AND a = 0) / count(*) FILTER (x = 0), 4) AS high_risk_recall,
            round(count(*) FILTER (x = 1 AND a = 1) / count(*) FILTER (x = 1), 4) AS missing_information_recall, count(*) FILTER (NOT (x = a AND s)) AS failed FROM e""",
    "ag15_router": """
        WITH e AS (SELECT event_id % 4 = 0 AS u, event_id % 4 = 0 AND event_id % 100 > 0 AS p, event_id % 6 > 0 AND event_id % 9 = 0 AS w, value FROM events),
        r AS (SELECT count(*) AS cases, round(avg((u = p)::INT), 4) AS accuracy, round(count(*) FILTER (u AND p) / count(*) FILTER (u), 4) AS high_risk_recall, round(count(*) FILTER (w) / count(*), 4) AS false_write_rate, round(avg(value), 3) AS mean_latency, round(max(value), 3) AS max_latency FROM e)
        SELECT *, accuracy >= 0.97 AND high_risk_recall = 1 AND false_write_rate = 0 AS accepted FROM r""",
    "ag17_readiness": "WITH c AS (SELECT c_nationkey AS dataset, c_nationkey % 2 = 0 OR c_custkey % 3 > 0 AS ok, c_nationkey % 4 = 0 OR c_custkey % 5 > 0 AS cl FROM customer) SELECT dataset, count(*) AS cases, count(*) FILTER (ok) AS approved, bool_and(ok) AS ready, bool_and(ok) AND bool_and(cl) AS clinical_claim_allowed FROM c GROUP BY 1",
    "ev11_frozen": "WITH c AS (SELECT o_orderkey % 1000 AS id, o_orderkey % 50 = 0 AS gone FROM orders), e AS (SELECT 'wrong_count' AS error, abs(count(*) - 100) AS n FROM c UNION ALL SELECT 'repeated_ids', count(*) - count(DISTINCT id) FROM c UNION ALL SELECT 'missing_query', count(*) FILTER (gone) FROM c) SELECT * FROM e WHERE n > 0",
    "ag7_traces": "SELECT count(*) AS turns, round(avg((event_id % 8 = 0)::INT), 4) AS fallback_rate, round(avg((event_id % 5 > 0 AND event_id % 3 = 0)::INT), 4) AS no_evidence_rate, (2 * count(*) FILTER (event_id % 2 = 0))::BIGINT AS tool_calls, round((2 * count(*) FILTER (event_id % 2 = 0) - count(*) FILTER (event_id % 4 = 0)) / (2 * count(*) FILTER (event_id % 2 = 0)), 4) AS tool_success_rate FROM events",
    "fl12_selected": "SELECT o_orderkey AS row_idx, o_orderpriority AS baseline FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 > 0 QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 25",
    "wn14_first_examples": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(coalesce(text, ''))",
    "ev13_case": f"""WITH {_LEGACY}, t AS (SELECT query_id, count(*) AS retrieved, list_distinct(regexp_extract_all(string_agg(text, chr(10)), '[一-鿿A-Za-z0-9]{{2,}}')) AS y FROM h WHERE rank <= 3 GROUP BY 1),
        b AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(text, '[一-鿿A-Za-z0-9]{{2,}}')) AS x FROM benchmark)
        SELECT query_id, recall_at_k, mrr, retrieved, round(len(list_intersect(x, y)) / len(x), 4) AS groundedness FROM lg JOIN t USING (query_id) JOIN b USING (query_id)""",
}
