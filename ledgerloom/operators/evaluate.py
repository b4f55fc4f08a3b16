"""Answer and classifier evaluation: token F1, choices, agreement, macro F1, grouped summaries, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.functions.text import let, words


def token_f1(prediction: Column, reference: Column) -> Column:
    """F1 of the token multisets; two empty ones agree."""
    p, r = words(F.coalesce(prediction, F.lit(""))), words(F.coalesce(reference, F.lit("")))
    # a token is common as often as both have it: tokens are numbered by occurrence, so sets do
    numbered = lambda a: let(F.array_sort(a), lambda s: F.transform(s, lambda x, i: F.struct(x.alias("t"), (i - F.array_position(s, x)).alias("n"))))
    a, b = numbered(p), numbered(r)
    score = let(F.struct(F.size(F.array_intersect(a, b)).alias("c"), F.size(a).alias("a"), F.size(b).alias("b")), lambda s: F.when(s["a"] + s["b"] == 0, F.lit(1.0)).otherwise(2.0 * s["c"] / F.greatest(s["a"] + s["b"], F.lit(1))))
    return F.round(score, 6)


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean absolute error, Pearson correlation, share within 0.2, of rows that have both scores."""
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    gap = F.abs(F.col(a) - F.col(b))
    return both.agg(F.count("*").alias("n"), F.round(F.avg(gap), 6).alias("mae"), F.round(F.corr(a, b), 6).alias("pearson"), F.round(F.avg((gap <= 0.2).cast("int")), 6).alias("within"))


def macro_f1(pairs: DataFrame, labels: list[str], expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) of a fixed set of labels, and their mean as `macro`; labels that don't occur count as zero."""
    sums = []
    for x in labels:
        sums += [F.count_if((F.col(expected) == x) & (F.col(predicted) == x)), F.count_if(F.col(predicted) == x), F.count_if(F.col(expected) == x)]
    one = pairs.agg(F.array(*sums).alias("s"))
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col("s")[3 * i].alias("tp"), F.col("s")[3 * i + 1].alias("p"), F.col("s")[3 * i + 2].alias("support")) for i, x in enumerate(labels)])).alias("r")).select("r.*")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.select("label", zero(F.try_divide("tp", "p")).alias("precision"), zero(F.try_divide("tp", "support")).alias("recall"), "support", zero(F.try_divide(2.0 * F.col("tp"), F.col("p") + F.col("support"))).alias("f1"))
    # the window is over the fixed labels
    return rows.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"), "support", F.round(F.avg("f1").over(Window.partitionBy()), 6).alias("macro"))


def grouped_means(records: DataFrame, group: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Means by (group, baseline) and by baseline over all groups (`all`), in one pass of grouping sets."""
    g = records.groupingSets([[F.col(group), F.col(baseline)], [F.col(baseline)]], F.col(group), F.col(baseline))
    out = g.agg(F.grouping(group).alias("is_all"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    return out.select(F.when(F.col("is_all") == 1, "all").otherwise(F.col(group).cast("string")).alias("subset"), baseline, *metrics)


def accuracy_rollup(records: DataFrame, dataset: str) -> DataFrame:
    """records (dataset, correct, valid, error, latency): per dataset and overall, with the mean of the datasets' accuracies on the overall row."""
    r = records.rollup(dataset).agg(F.grouping(dataset).alias("all"), F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"), F.avg((~F.col("valid")).cast("int")).alias("invalid"), F.avg(F.col("error").cast("int")).alias("failed"), F.avg("latency").alias("latency"))
    macro = F.avg(F.when(F.col("all") == 0, F.col("acc"))).over(Window.partitionBy())  # one row for each dataset
    return r.select(F.coalesce(F.col(dataset).cast("string"), F.lit("overall")).alias("dataset"), "n", F.round("acc", 6).alias("accuracy"), F.round("invalid", 6).alias("invalid_rate"), F.round("failed", 6).alias("failure_rate"), F.round("latency", 6).alias("latency"), F.when(F.col("all") == 1, F.round(macro, 6)).alias("macro_accuracy"))


def case_status(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """cases (case_id, clinical), reviews (case_id, decision, clinician): rejected > changes > approved (two, and a clinician where needed) > in_review > draft."""
    g = reviews.groupBy("case_id").agg(F.bool_or(F.col("decision") == "reject").alias("no"), F.bool_or(F.col("decision") == "changes").alias("ch"), F.count_if(F.col("decision") == "approve").alias("yes"), F.bool_or((F.col("decision") == "approve") & F.col("clinician")).alias("doc"), F.count("*").alias("n"))
    status = F.when(F.col("no"), "rejected").when(F.col("ch"), "changes_requested").when((F.col("yes") >= 2) & (~F.col("clinical") | F.col("doc")), "approved").when(F.col("n") > 0, "in_review").otherwise("draft")
    return cases.join(g, "case_id", "left").select("case_id", status.alias("status"))


def policy_checks(cases: DataFrame) -> DataFrame:
    """cases (case_id, expected, actual arrays, expected_action, action): sources are a subset, actions agree, both pass."""
    subset = F.size(F.array_except("expected", "actual")) == 0
    return cases.select("case_id", subset.alias("sources_ok"), (F.col("expected_action") == F.col("action")).alias("action_ok"), (subset & (F.col("expected_action") == F.col("action"))).alias("passed"))


def capped(cases: DataFrame, group: str, order: list, per_group: int, total: int) -> DataFrame:
    """At most `per_group` cases of each group and `total` in all, in order."""
    return cases.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= per_group).drop("_n").orderBy(*order).limit(total)


def unit_interval(seed: str, c: Column) -> Column:
    """Deterministic number in [0, 1] from the first eight bytes of a digest."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), F.lit(16)), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551615.0)


def _pairs(spark, d):
    l, docs = read(spark, d, "labels"), read(spark, d, "documents").select("doc_id", "n_chars")
    return l.join(docs, "doc_id").select("doc_id", F.col("quality").cast("double").alias("a"), (F.col("n_chars") % 100 / 100.0).alias("b"), "toxic", "n_chars")


def ev2_token_f1(spark, d):
    c = read(spark, d, "conversations")
    nxt = c.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    return nxt.select("conv_id", "turn", token_f1(F.col("text"), F.col("next")).alias("f1"))


def ag13_agreement(spark, d):
    return agreement(_pairs(spark, d), "a", "b")


def ag14_macro_f1(spark, d):
    p = _pairs(spark, d).select(F.concat(F.lit("q"), F.col("a").cast("int")).alias("expected"), F.concat(F.lit("q"), (F.col("n_chars") % 3).cast("int")).alias("predicted"))
    return macro_f1(p, ["q0", "q1", "q2", "q3"])


def ag9_grouping_sets(spark, d):
    return grouped_means(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_quantity", "l_discount", "l_tax"])


def ag10_rollup(spark, d):
    e = read(spark, d, "events")
    return accuracy_rollup(e.select(F.col("event_type").alias("dataset"), (F.col("event_id") % 3 == 0).alias("correct"), (F.col("event_id") % 7 > 0).alias("valid"), (F.col("user_id") % 11 == 0).alias("error"), F.col("value").alias("latency")), "dataset")


def ag16_case_status(spark, d):
    o = read(spark, d, "orders")
    reviews = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderpriority").startswith("1") & (F.col("o_totalprice") > 180000), "reject").when(F.col("o_orderpriority").startswith("2") & (F.col("o_totalprice") > 150000), "changes").when(F.col("o_orderstatus") == "F", "approve").otherwise("comment").alias("decision"), (F.col("o_orderkey") % 3 == 0).alias("clinician"))
    return case_status(read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 2 == 0).alias("clinical")), reviews)


def ev8_policy(spark, d):
    e = read(spark, d, "events")
    g = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 300, F.col("event_type"))).alias("expected"), F.collect_set(F.when(F.col("value") < 290, F.col("event_type"))).alias("actual"), F.max_by("event_type", "ts").alias("action"), F.min_by("event_type", "ts").alias("expected_action"))
    return policy_checks(g.withColumnRenamed("user_id", "case_id"))


def fl11_selection(spark, d):
    return capped(read(spark, d, "events"), "event_type", ["ts", "event_id"], 30, 100).select("event_id", "event_type")


def ev_hash_sample(spark, d):
    return read(spark, d, "orders").where(unit_interval("s1", F.col("o_orderkey")) < 0.1).select("o_orderkey")


QUERIES = {f.__name__: f for f in (ev2_token_f1, ag13_agreement, ag14_macro_f1, ag9_grouping_sets, ag10_rollup, ag16_case_status, ev8_policy, fl11_selection, ev_hash_sample)}
_P = "p AS (SELECT doc_id, quality::DOUBLE AS a, n_chars % 100 / 100.0::DOUBLE AS b, n_chars FROM labels JOIN documents USING (doc_id))"
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
SQL = {
    "ev2_token_f1": f"""
        WITH n AS (SELECT conv_id, turn, {_TOK.format("text")} AS p, {_TOK.format("next")} AS r FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL),
        a AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS t FROM n) GROUP BY ALL), b AS (SELECT conv_id, turn, t, count(*) AS n FROM (SELECT conv_id, turn, unnest(r) AS t FROM n) GROUP BY ALL),
        c AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS c FROM a JOIN b USING (conv_id, turn, t) GROUP BY ALL)
        SELECT conv_id, turn, round(CASE WHEN len(p) + len(r) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(c, 0) / (len(p) + len(r)) END, 6) AS f1 FROM n LEFT JOIN c USING (conv_id, turn)""",
    "ag13_agreement": f"WITH {_P} SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mae, round(corr(a, b), 6) AS pearson, round(avg((abs(a - b) <= 0.2)::INT), 6) AS within FROM p",
    "ag14_macro_f1": f"""
        WITH {_P}, x AS (SELECT 'q' || a::INT AS e, 'q' || (n_chars % 3) AS p FROM p), l AS (SELECT * FROM (VALUES ('q0'), ('q1'), ('q2'), ('q3')) AS t(label)),
        s AS (SELECT label, count(*) FILTER (e = label AND p = label) AS tp, count(*) FILTER (p = label) AS pn, count(*) FILTER (e = label) AS support FROM l, x GROUP BY label),
        f AS (SELECT label, coalesce(tp / nullif(pn, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(pn + support, 0), 0) AS f1, support FROM s)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, round(avg(f1) OVER (), 6) AS macro FROM f""",
    "ag9_grouping_sets": "SELECT coalesce(l_returnflag, 'all') AS subset, l_linestatus, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus))",
    "ag10_rollup": """
        WITH r AS (SELECT event_type AS d, event_id % 3 = 0 AS c, event_id % 7 = 0 AS i, user_id % 11 = 0 AS f, value FROM events),
        g AS (SELECT d, count(*) AS n, avg(c::INT) AS a, avg(i::INT) AS i, avg(f::INT) AS f, avg(value) AS v FROM r GROUP BY GROUPING SETS ((d), ()))
        SELECT coalesce(d, 'overall') AS dataset, n, round(a, 6) AS accuracy, round(i, 6) AS invalid_rate, round(f, 6) AS failure_rate, round(v, 6) AS latency, CASE WHEN d IS NULL THEN (SELECT round(avg(a), 6) FROM g WHERE d IS NOT NULL) END AS macro_accuracy FROM g""",
    "ag16_case_status": """
        WITH r AS (SELECT o_custkey AS c, CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice > 180000 THEN 'reject' WHEN o_orderpriority LIKE '2%' AND o_totalprice > 150000 THEN 'changes' WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'comment' END AS d, o_orderkey % 3 = 0 AS k FROM orders),
        g AS (SELECT c, bool_or(d = 'reject') AS no, bool_or(d = 'changes') AS ch, count(*) FILTER (d = 'approve') AS yes, bool_or(d = 'approve' AND k) AS doc FROM r GROUP BY 1)
        SELECT c_custkey AS case_id, CASE WHEN no THEN 'rejected' WHEN ch THEN 'changes_requested' WHEN yes >= 2 AND (c_custkey % 2 = 1 OR doc) THEN 'approved' WHEN c IS NOT NULL THEN 'in_review' ELSE 'draft' END AS status FROM customer LEFT JOIN g ON c = c_custkey""",
    "ev8_policy": """
        WITH g AS (SELECT user_id AS case_id, list_distinct(list(event_type) FILTER (value > 300)) AS e, list_distinct(list(event_type) FILTER (value < 290)) AS a, arg_max(event_type, ts) AS x, arg_min(event_type, ts) AS y FROM events GROUP BY 1)
        SELECT case_id, len(list_filter(coalesce(e, []), lambda t: NOT list_contains(coalesce(a, []), t))) = 0 AS sources_ok, x = y AS action_ok, len(list_filter(coalesce(e, []), lambda t: NOT list_contains(coalesce(a, []), t))) = 0 AND x = y AS passed FROM g""",
    "fl11_selection": "SELECT event_id, event_type FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 30) ORDER BY ts, event_id LIMIT 100",
    "ev_hash_sample": "SELECT o_orderkey FROM orders WHERE ('0x' || left(sha256('s1:' || o_orderkey), 16))::UBIGINT::DOUBLE / 18446744073709551615.0::DOUBLE < 0.1",
}
