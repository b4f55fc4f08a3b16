"""Snapshots folded out of logs: progress of jobs, states of tasks and their runs, and memory that grows by turns.

A log is folded by job or task; the last value of a field wins, so most folds are aggregations with partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.planning import memory_texts
from ledgerloom.functions.tables import read

TASK_END = ["completed", "cancelled"]


def progress(log: DataFrame) -> DataFrame:
    """log (job_id, at, kind step, complete_job or fail, step, percent, status, message): (job_id, step, percent, step_status, status, current_step, message) of each job and step.

    A step has the percent (clamped to 0..100) and status of its last entry; a failure keeps the step's percent. If the job's last entry completes it, all steps that
    haven't failed are at 100. The job's status is that of its last entry.
    """
    when = F.col("at")
    is_step, is_fail = F.col("kind") == "step", F.col("kind") == "fail"
    clamp = F.greatest(F.lit(0), F.least(F.lit(100), F.col("percent").cast("int")))
    steps = log.where("step is not null").groupBy("job_id", "step").agg(F.max_by(F.when(is_step, clamp), F.when(is_step, when)).alias("percent"), F.max_by(F.when(is_fail, F.lit("failed")).otherwise(F.col("status")), when).alias("step_status"))
    status = F.when(F.col("kind") == "complete_job", "completed").when(is_fail | (F.col("status") == "failed"), "failed").otherwise("running")
    jobs = log.groupBy("job_id").agg(F.max_by(status, when).alias("job_status"), F.max_by(F.col("message"), when).alias("message"), F.max_by(F.when(F.col("step").isNotNull(), F.col("step")), F.when(F.col("step").isNotNull(), when)).alias("current_step"))
    done = (F.col("job_status") == "completed") & (F.col("step_status") != "failed")
    out = steps.join(jobs, "job_id")
    return out.select("job_id", "step", F.when(done, 100).otherwise(F.coalesce("percent", F.lit(0))).alias("percent"), F.when(done, "completed").otherwise(F.col("step_status")).alias("step_status"), F.col("job_status").alias("status"), "current_step", "message")


def tasks(drafts: DataFrame, commands: DataFrame) -> DataFrame:
    """drafts (task_id, key, due_at, interval_seconds), commands (task_id, at, action): (task_id, status, next_run, transitions) of each task, one for each idempotency key.

    The first draft of a key counts. A draft waits; `confirm` makes a waiting one active, to run when it is due or at once if that has passed; `cancel` ends what hasn't ended;
    `complete` ends an active one that isn't recurring. Other commands change nothing.
    """
    first = drafts.groupBy("key").agg(F.min_by(F.struct("task_id", "due_at", "interval_seconds"), "task_id").alias("d")).select("d.*")
    log = commands.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("at", "action"))).alias("log"))
    made = lambda status, run, path: F.struct(status.alias("status"), run.alias("run"), path.alias("path"))
    none = F.lit(None).cast(dict(drafts.dtypes)["due_at"])

    def step(s, c):
        to = lambda status, run: made(F.lit(status), run, F.concat(s["path"], F.array(F.lit(status))))
        out = F.when((c["action"] == "confirm") & (s["status"] == "waiting_confirmation"), to("active", F.greatest(F.col("due_at"), c["at"])))
        out = out.when((c["action"] == "cancel") & ~s["status"].isin(*TASK_END), to("cancelled", none))
        return out.when((c["action"] == "complete") & (s["status"] == "active") & (F.coalesce("interval_seconds", F.lit(0)) == 0), to("completed", s["run"])).otherwise(s)

    start = made(F.lit("waiting_confirmation"), none, F.array(F.lit("draft"), F.lit("waiting_confirmation")))
    out = first.join(log, "task_id", "left").select("task_id", F.aggregate(F.coalesce("log", F.array().cast(dict(log.dtypes)["log"])), start, step).alias("s"))
    return out.select("task_id", "s.status", F.col("s.run").alias("next_run"), F.col("s.path").alias("transitions"))


def retried(runs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """runs (run_id, status, next_retry) after a retry was asked for (run_id): failed and waiting ones are ready now; all others stay."""
    out = runs.join(asked.select("run_id", F.lit(True).alias("_a")).distinct(), "run_id", "left")
    may = F.coalesce("_a", F.lit(False)) & F.col("status").isin("failed", "retry_wait")
    return out.withColumns({"next_retry": F.when(may, now).otherwise(F.col("next_retry")), "status": F.when(may, "ready").otherwise(F.col("status"))}).drop("_a")


def remembered(turns: DataFrame, markers) -> DataFrame:
    """turns (user, session, turn, said, answer): the rows that a memory appends, with ids in order of type, user, session and turn."""
    rows = turns.select("user", "session", "turn", F.explode(memory_texts(F.col("user"), F.col("session"), F.col("said"), F.col("answer"), markers)).alias("m"))
    return rows.select(F.concat_ws(":", "m.memory_type", "user", "session", F.col("turn").cast("string")).alias("chunk_id"), "user", "m.memory_type", "m.text")


def ss9_progress(spark, d):
    n = F.col("event_id")
    log = read(spark, d, "events").select(
        F.col("user_id").alias("job_id"), n.alias("at"), F.when(n % 11 == 0, "complete_job").when(n % 7 == 0, "fail").otherwise("step").alias("kind"), F.when(n % 11 > 0, F.col("event_type")).alias("step"), (n % 150 - 20).alias("percent"),
        F.when(n % 2 == 0, "running").otherwise("completed").alias("status"), n.cast("string").alias("message"),
    )
    return progress(log)


def ss11_tasks(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    drafts = c.select(F.col("c_custkey").alias("task_id"), (F.col("c_custkey") % 1000).alias("key"), F.lit("1995-01-01").cast("timestamp_ntz").alias("due_at"), F.when(F.col("c_custkey") % 2 == 0, 3600).alias("interval_seconds"))
    k = F.col("o_orderkey")
    commands = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderdate").alias("at"), F.get(F.array(F.lit("confirm"), F.lit("complete"), F.lit("cancel"), F.lit("noise")), (k % 4).cast("int")).alias("action"))
    return tasks(drafts, commands).select("task_id", "status", F.date_format("next_run", "yyyy-MM-dd").alias("next_run"), F.array_join("transitions", ">").alias("transitions"))


def ss11_retried(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.get(F.array(F.lit("failed"), F.lit("ready"), F.lit("retry_wait")), (F.col("o_orderkey") % 3).cast("int")).alias("status"), F.lit(None).cast("string").alias("next_retry"))
    return retried(o, o.where("run_id % 2 = 0").select("run_id"), F.lit("now"))


def ss10_memory(spark, d):
    c = read(spark, d, "conversations").select(F.col("role").alias("user"), F.col("conv_id").cast("string").alias("session"), "turn", F.coalesce("text", F.lit("")).alias("said"), F.lit("ok").alias("answer"))
    return remembered(c, ["der", "las"]).select("chunk_id", "user", "memory_type", F.sha2("text", 256).alias("sha"))


QUERIES = {f.__name__: f for f in (ss9_progress, ss11_retried, ss10_memory, ss11_tasks)}
SQL = {
    "ss9_progress": """
        WITH l AS (SELECT user_id AS job_id, event_id AS n, CASE WHEN event_id % 11 = 0 THEN 'complete_job' WHEN event_id % 7 = 0 THEN 'fail' ELSE 'step' END AS kind, CASE WHEN event_id % 11 > 0 THEN event_type END AS step, greatest(0, least(100, event_id % 150 - 20)) AS p, CASE WHEN event_id % 2 = 0 THEN 'running' ELSE 'completed' END AS st FROM events),
        s AS (SELECT job_id, step, arg_max(p, n) FILTER (kind = 'step') AS p, arg_max(CASE WHEN kind = 'fail' THEN 'failed' ELSE st END, n) AS st FROM l WHERE step IS NOT NULL GROUP BY ALL),
        j AS (SELECT job_id, arg_max(CASE kind WHEN 'complete_job' THEN 'completed' WHEN 'fail' THEN 'failed' ELSE 'running' END, n) AS js, CAST(max(n) AS VARCHAR) AS message, arg_max(step, n) FILTER (step IS NOT NULL) AS cur FROM l GROUP BY 1)
        SELECT job_id, step, CASE WHEN js = 'completed' AND st <> 'failed' THEN 100 ELSE coalesce(p, 0) END AS percent, CASE WHEN js = 'completed' AND st <> 'failed' THEN 'completed' ELSE st END AS step_status, js AS status, cur AS current_step, message FROM s JOIN j USING (job_id)""",
    "ss11_retried": "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN 'ready' ELSE ['failed', 'ready', 'retry_wait'][o_orderkey % 3 + 1] END AS status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 1 THEN 'now' END AS next_retry FROM orders",
    "ss10_memory": """
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations),
        m AS (SELECT conv_id, turn, role, 'episodic_memory' AS memory_type, left('用户 ' || role || ' 在会话 ' || conv_id || ' 中提问：' || t || chr(10) || '系统回答摘要：ok', 1800) AS x FROM c
              UNION ALL SELECT conv_id, turn, role, 'semantic_memory', left('用户 ' || role || ' 的长期医疗相关事实或偏好：' || t, 1800) FROM c WHERE contains(t, 'las') OR contains(t, 'der'))
        SELECT memory_type || ':' || role || ':' || conv_id || ':' || turn AS chunk_id, role AS "user", memory_type, sha256(x) AS sha FROM m""",
}
