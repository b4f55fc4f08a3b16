"""Event-time and state operators, in batch form and as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """Each event with `allowed`: the first `limit` of a key in each fixed window pass."""
    window = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    order = Window.partitionBy(key, window).orderBy("ts", "event_id")
    return events.withColumn("allowed", F.row_number().over(order) <= limit)


def stream_rate_limit(events: DataFrame, key: str, limit: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Streaming form by counts: (key, window, seen, allowed) of each closed window; allowed is the number of events that passed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), key).agg(F.count("*").alias("seen"))
    return w.select(key, F.col("window.start").alias("start"), "seen", F.least("seen", F.lit(limit)).alias("allowed"))


def stream_once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Streaming notifications, each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_summary(events: DataFrame, size: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Streaming sliding windows: events, errors and mean value."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("mean"))
    return g.select(F.col("window.start").alias("start"), "n", "errors", F.round("mean", 6).alias("mean"))


def available(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files, with event time as timestamp."""
    schema = spark.read.parquet(path).schema
    out = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is, appends to `path`, and reads it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def backoff(attempt: Column, base: int, most: int = 3600) -> Column:
    """Seconds before the next attempt."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)) - 1)).cast("bigint"))


def job_states(log: DataFrame, max_attempts: int, base: int = 15) -> DataFrame:
    """log (job_id, at, event: enqueued, failed or completed): each job's attempts, status and next run. Failures retry with growing waits and fail at the last."""
    g = log.groupBy("job_id").agg(F.count_if(F.col("event") == "failed").alias("failures"), F.bool_or(F.col("event") == "completed").alias("done"), F.max("at").alias("last"))
    status = F.when(F.col("done"), "completed").when(F.col("failures") >= max_attempts, "failed").when(F.col("failures") > 0, "retry_wait").otherwise("queued")
    wait = F.when(status == "retry_wait", backoff(F.col("failures"), base))
    return g.select("job_id", F.col("failures").alias("attempts"), status.alias("status"), wait.alias("wait_seconds"))


def claimable(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "retry_wait") & (F.col("run_after") <= now)).orderBy("run_after", "created", "job_id").limit(limit)


def stale(jobs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Running jobs locked for longer than `seconds`, at least a minute, go back to the queue."""
    old = (F.col("status") == "running") & (F.timestamp_diff("SECOND", F.col("locked"), now) > max(60, seconds))
    return jobs.withColumn("status", F.when(old, "queued").otherwise(F.col("status")))


def due_runs(tasks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """tasks (task_id, status, next_run, interval_seconds): runs that are due, one for a task and tick, and the tasks afterwards."""
    due = (F.col("status") == "active") & F.col("next_run").isNotNull() & (F.col("next_run") <= now)
    runs = tasks.where(due).select("task_id", F.col("next_run").alias("scheduled_for"), F.concat_ws("@", "task_id", F.date_format("next_run", "yyyy-MM-dd'T'HH:mm:ss")).alias("run_key"))
    again = F.col("interval_seconds") > 0
    after = tasks.withColumn("status", F.when(due & ~F.coalesce(again, F.lit(False)), "due").otherwise(F.col("status"))).withColumn(
        "next_run", F.when(due & again, F.timestamp_add("SECOND", F.col("interval_seconds"), F.col("next_run"))).when(~due, F.col("next_run"))
    )
    return runs, after


def once(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def _events(spark, d):
    return read(spark, d, "events")


def ss1_rate_limit(spark, d):
    return rate_limit(_events(spark, d), "user_id", 2, 3600).select("event_id", "allowed")


def ss2_backoff(spark, d):
    e = _events(spark, d)
    log = e.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.when((F.col("event_type") == "error") & (F.col("value") > 150), "failed").when((F.col("event_type") == "signup") & (F.col("value") > 200), "completed").otherwise("enqueued").alias("event"))
    return job_states(log, 5)


def ss3_stale(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("locked"))
    return stale(e, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 30).groupBy("status").agg(F.count("*").alias("n"))


def ss4_due_runs(spark, d):
    o = read(spark, d, "orders")
    tasks = o.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "active").otherwise("paused").alias("status"), F.col("o_orderdate").alias("next_run"), F.when(F.col("o_orderkey") % 2 == 0, 86400).alias("interval_seconds"))
    runs, after = due_runs(tasks, F.lit("1994-01-01").cast("timestamp_ntz"))
    return after.join(runs, "task_id", "left").select("task_id", "status", F.date_format("next_run", "yyyy-MM-dd").alias("next_run"), "run_key")


def ss7_once(spark, d):
    return once(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


def ss8_sliding(spark, d):
    w = _events(spark, d).groupBy(F.window("ts", "24 hours", "1 hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n", "errors")


def fl8_claim(spark, d):
    e = _events(spark, d).select(F.col("event_id").alias("job_id"), F.when(F.col("event_type") == "click", "queued").otherwise("running").alias("status"), F.col("ts").alias("run_after"), F.col("ts").alias("created"))
    return claimable(e, F.lit("2024-01-10").cast("timestamp_ntz"), 50).select("job_id")


QUERIES = {f.__name__: f for f in (ss1_rate_limit, ss2_backoff, ss3_stale, ss4_due_runs, ss7_once, ss8_sliding, fl8_claim)}
SQL = {
    "ss1_rate_limit": "SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events",
    "ss2_backoff": """
        WITH g AS (SELECT user_id AS job_id, count(*) FILTER (event_type = 'error' AND value > 150) AS f, bool_or(event_type = 'signup' AND value > 200) AS done FROM events GROUP BY 1),
        s AS (SELECT *, CASE WHEN done THEN 'completed' WHEN f >= 5 THEN 'failed' WHEN f > 0 THEN 'retry_wait' ELSE 'queued' END AS status FROM g)
        SELECT job_id, f AS attempts, status, CASE WHEN status = 'retry_wait' THEN least(3600, 15 * 2 ** (f - 1))::BIGINT END AS wait_seconds FROM s""",
    "ss3_stale": "SELECT CASE WHEN event_type = 'view' THEN CASE WHEN date_sub('second', ts, TIMESTAMP '2024-01-15') > 60 THEN 'queued' ELSE 'running' END ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY 1",
    "ss4_due_runs": """
        WITH t AS (SELECT *, o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1994-01-01' AS due, o_orderkey % 2 = 0 AS again FROM orders)
        SELECT o_orderkey AS task_id, CASE WHEN due AND NOT again THEN 'due' WHEN o_orderstatus = 'F' THEN 'active' ELSE 'paused' END AS status,
            strftime(CASE WHEN due AND again THEN o_orderdate + INTERVAL 1 DAY WHEN NOT due THEN o_orderdate END, '%Y-%m-%d') AS next_run, CASE WHEN due THEN o_orderkey || '@' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS run_key FROM t""",
    "ss7_once": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "ss8_sliding": "WITH h AS (SELECT date_trunc('hour', ts) - INTERVAL (i) HOUR AS start, event_type FROM events, unnest(range(0, 24)) AS t(i)) SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM h GROUP BY start",
    "fl8_claim": "SELECT event_id AS job_id FROM events WHERE event_type = 'click' AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 50",
}
