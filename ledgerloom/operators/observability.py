"""Operational summaries over events: rates, percentiles, histograms, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.operators.quantiles import selected

#: Upper bounds of latency buckets, in the unit of the value.
BUCKETS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
ROUTE_CAP = 200


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(F.try_divide(part, whole), places)


def value_counts(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(field, value, n) of several columns in one pass; columns maps each to the name that stands for a missing value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(missing)).alias("value")) for c, missing in columns.items()]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def percentiles(df: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, bool]]) -> DataFrame:
    """A row for each group of `df` with the exact percentiles of wanted, name to (q, linear); nulls where a group has no values. No task holds a group's values; rounds of `selected` run when this is called."""
    found, kind = selected(df, by, value, list(wanted.values())).withColumnRenamed(by, "_g"), df.schema[value].dataType
    of = lambda q, linear: F.max(F.when((F.col("q") == q) & (F.col("linear") == linear), F.col(value)))
    found = found.groupBy("_g").agg(F.lit(True).alias("_there"), *[(of(q, linear) if linear else of(q, linear).cast(kind)).alias(name) for name, (q, linear) in wanted.items()])
    return df.select(by).distinct().join(found, F.col(by).eqNullSafe(F.col("_g")) & F.col("_there"), "left").drop("_g", "_there")


def summary(events: DataFrame, start: Column, failed: Column, retried: Column, latency: Column) -> DataFrame:
    """One row: calls since `start`, success and retry rates, nearest-rank p50 and p95."""
    now = events.where(F.col("ts") >= start).withColumns({"f": failed, "r": retried, "l": latency})
    now = now.withColumn("one", F.lit(1))
    ranks = percentiles(now, "one", "l", {"p50": (0.5, False), "p95": (0.95, False)})
    out = now.agg(
        F.count("*").alias("calls"),
        F.count_if("f").alias("failures"),
        rate(F.count_if(~F.col("f")), F.count("*")).alias("success_rate"),
        rate(F.count_if("r"), F.count("*")).alias("retry_rate"),
        F.round(F.avg("l"), 4).alias("mean"),
    ).withColumn("one", F.lit(1))
    return out.join(ranks, "one", "left").select("calls", "failures", "success_rate", "retry_rate", "p50", "p95", "mean")


def alerts(one: DataFrame, rules: list[tuple[str, str, str, float, str]]) -> DataFrame:
    """(code, severity, value, threshold) of the rules (code, column, `>` or `<`, threshold, severity) that fire on a one-row summary."""
    cases = [F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.col(c).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), (F.col(c) > t if op == ">" else F.col(c) < t).alias("fires")) for code, c, op, t, sev in rules]
    return one.select(F.explode(F.array(*cases)).alias("a")).where("a.fires").select("a.code", "a.severity", "a.value", "a.threshold")


def histogram(events: DataFrame, by: list[str], value: str, buckets: list[float] = BUCKETS) -> DataFrame:
    """Cumulative counts (le), sum and count for each group, in long form."""
    bounds = F.array(*[F.lit(float(b)) for b in [*buckets, float("inf")]])
    wide = events.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))
    counts = F.array(*[F.col(f"b{i}") for i in range(len(buckets))], F.col("n"))
    return wide.select(*by, "n", "total", F.explode(F.arrays_zip(bounds.alias("le"), counts.alias("c"))).alias("z")).select(*by, F.when(F.col("z.le") == float("inf"), "+Inf").otherwise(F.col("z.le").cast("string")).alias("le"), F.col("z.c").alias("cumulative"), "n", "total")


def capped_routes(events: DataFrame, route: str, cap: int = ROUTE_CAP, other: str = "/other") -> DataFrame:
    """`events` with routes beyond the first `cap` seen, by time, replaced by `other`."""
    first = events.groupBy(route).agg(F.min(F.struct("ts", "event_id")).alias("f")).orderBy("f").limit(cap).select(F.col(route).alias("known"))
    return events.join(F.broadcast(first), F.col(route) == F.col("known"), "left").withColumn(route, F.coalesce("known", F.lit(other))).drop("known")  # cap rows are broadcast


def prometheus(one: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return one.select(F.explode(F.array(*[F.concat(F.lit(f"{prefix}_{c} "), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in columns])).alias("line"))


def _events(spark, d):
    return read(spark, d, "events")


def _summary(spark, d):
    return summary(_events(spark, d), F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"), F.col("event_type") == "error", F.get_json_object("props", "$.k").cast("int") > 50, F.col("value"))


def ag1_summary(spark, d):
    return _summary(spark, d)


def ag1_counts(spark, d):
    return value_counts(_events(spark, d).withColumn("mode", F.when(F.col("event_id") % 3 > 0, F.col("event_type"))), {"event_type": "UNKNOWN", "mode": "not_invoked"})


def ag2_percentiles(spark, d):
    return percentiles(_events(spark, d), "event_type", "value", {f"p{int(x * 100)}": (x, False) for x in (0.5, 0.9, 0.95, 0.99)})


def ag3_linear_percentiles(spark, d):
    p = percentiles(read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"p50": (0.5, True), "p95": (0.95, True)})
    return p.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


ALERTS = [("success_low", "success_rate", "<", 0.9, "warning"), ("p95_high", "p95", ">", 100.0, "warning"), ("failures", "failures", ">", 0, "critical"), ("retry_high", "retry_rate", ">", 0.99, "warning")]


def ag4_alerts(spark, d):
    return alerts(_summary(spark, d), ALERTS)


def ag5_prometheus(spark, d):
    return prometheus(_summary(spark, d), "app", ["calls", "failures"])


def ag6_histogram(spark, d):
    return histogram(_events(spark, d), ["event_type"], "value")


def ag6_route_cap(spark, d):
    e = _events(spark, d).withColumn("route", F.concat(F.lit("/u/"), F.col("user_id")))
    return capped_routes(e, "route", 50).groupBy("route").agg(F.count("*").alias("n"))


def ag25_load(spark, d):
    v, e = F.col("value"), _events(spark, d)
    rest = e.groupBy("event_type").agg(F.min(v).alias("lo"), F.round(F.avg(v), 6).alias("mean"), F.max(v).alias("hi"), F.count("*").alias("n"))
    p = percentiles(e, "event_type", "value", {"p99": (0.99, False)}).withColumnRenamed("event_type", "_type")
    return rest.join(p, F.col("event_type").eqNullSafe(F.col("_type"))).select("event_type", "lo", "mean", "hi", "p99", "n")


def fl18_listing(spark, d):
    return _events(spark, d).where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


QUERIES = {f.__name__: f for f in (ag1_summary, ag1_counts, ag2_percentiles, ag3_linear_percentiles, ag4_alerts, ag5_prometheus, ag6_histogram, ag6_route_cap, ag25_load, fl18_listing)}
_S = "s AS (SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, round(count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 50) / count(*), 4) AS retry_rate, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-29')"
_B = ", ".join(f"({b})" for b in BUCKETS)
SQL = {
    "ag1_summary": f"WITH {_S} SELECT * FROM s",
    "ag1_counts": "SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'mode', CASE WHEN event_id % 3 > 0 THEN event_type ELSE 'not_invoked' END AS value, count(*) FROM events GROUP BY ALL",
    "ag2_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
    "ag3_linear_percentiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1",
    "ag4_alerts": f"WITH {_S} " + " UNION ALL ".join(f"SELECT '{c}' AS code, '{sev}' AS severity, {col}::DOUBLE AS value, {float(t)}::DOUBLE AS threshold FROM s WHERE {col} {op} {t}" for c, col, op, t, sev in ALERTS),
    "ag5_prometheus": f"WITH {_S} SELECT 'app_calls ' || calls AS line FROM s UNION ALL SELECT 'app_failures ' || failures FROM s",
    "ag6_histogram": f"""WITH b AS (SELECT CAST(le AS DOUBLE) AS le FROM (VALUES {_B}) AS t(le)), g AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1)
        SELECT event_type, CAST(le AS VARCHAR) AS le, (SELECT count(*) FROM events e WHERE e.event_type = g.event_type AND value <= le) AS cumulative, n, total FROM g, b UNION ALL SELECT event_type, '+Inf', n, n, total FROM g""",
    "ag6_route_cap": "WITH f AS (SELECT user_id FROM events GROUP BY 1 ORDER BY min((ts, event_id)) LIMIT 50) SELECT CASE WHEN f.user_id IS NULL THEN '/other' ELSE '/u/' || f.user_id END AS route, count(*) AS n FROM events e LEFT JOIN f USING (user_id) GROUP BY 1",
    "ag25_load": "SELECT event_type, min(value) AS lo, round(avg(value), 6) AS mean, max(value) AS hi, quantile_disc(value, 0.99) AS p99, count(*) AS n FROM events GROUP BY 1",
    "fl18_listing": "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50",
}
