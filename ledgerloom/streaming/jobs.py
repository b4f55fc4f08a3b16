"""Job leases and retries as keyed state: one fold, as a batch over sorted events and as a stream with timers.

An event takes effect in order of its time. The stream holds a job's events back until the watermark has passed them, so its
transitions are those of the batch fold, whatever the order and the batches they come in, and whatever restarts. A lease that
runs out is a transition of its own: its time is in the state, and an event-time timer looks at it when no event does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ledgerloom.functions.storage import shared_folder
from ledgerloom.functions.tables import read
from ledgerloom.streaming.state import available

OUT = "job_id long, at long, event string, status string, attempts int, run_after long, worker string, error string"
IN = ["at", "seq", "event", "worker", "max_attempts"]
STATE = "status string, attempts int, max_attempts int, run_after long, locked_at long, worker string, ended_at long"
SECOND = 1_000_000


class Rules:
    """Times in microseconds: `lease` of a claim (a minute at least), `base` and `most` of the waits, `keep` of what is done."""

    def __init__(self, lease: int = 900, base: int = 15, most: int = 3600, keep: int = 7 * 86400):
        self.lease, self.base, self.most, self.keep = max(60, lease) * SECOND, base, most, keep * SECOND

    def deadline(self, s: tuple | None) -> int | None:
        """When a state changes without an event: the end of a lease, or of the time that a finished job is kept."""
        if s is None:
            return None
        status, _, _, _, locked, _, ended = s
        return locked + self.lease if status == "running" else ended + self.keep if ended is not None else None

    def settle(self, s: tuple | None, now: int) -> tuple[tuple | None, list[tuple]]:
        """The state at a time, and the transitions until then. A job whose lease ran out waits again, or fails at its last attempt."""
        out = []
        while (end := self.deadline(s)) is not None and end < now:
            status, attempts, most, run_after, _, worker, _ = s
            if status != "running":
                s = None
            elif attempts >= most:
                s = ("failed", attempts, most, run_after, None, "", end)
                out.append((end, "lease_end", "failed", attempts, run_after, worker, "stale_worker_timeout"))
            else:
                s = ("retry_wait", attempts, most, end, None, "", None)
                out.append((end, "lease_end", "retry_wait", attempts, end, worker, "stale_worker_requeued"))
        return s, out

    def apply(self, s: tuple | None, at: int, event: str, worker: str | None, max_attempts: int | None) -> tuple[tuple | None, list[tuple]]:
        """The state after an event, and its transitions. Events that a state doesn't allow change nothing and give none: a job is enqueued once, claimed when it is due, and ended while it runs."""
        s, out = self.settle(s, at)
        if s is None:
            if event == "enqueued":
                s = ("queued", 0, max(1, min(max_attempts or 3, 10)), at, None, "", None)
                out.append((at, event, "queued", 0, at, "", ""))
            return s, out
        status, attempts, most, run_after, locked, holder, ended = s
        if event == "claimed" and status in ("queued", "retry_wait") and run_after <= at:
            s = ("running", attempts + 1, most, run_after, at, worker or "", None)
        elif event == "completed" and status == "running":
            s = ("completed", attempts, most, run_after, None, "", at)
        elif event == "failed" and status == "running" and attempts < most:
            s = ("retry_wait", attempts, most, at + min(self.most, self.base * 2 ** min(attempts - 1, 30)) * SECOND, None, "", None)
        elif event == "failed" and status == "running":
            s = ("failed", attempts, most, run_after, None, "", at)
        else:
            return s, out
        out.append((at, event, s[0], s[1], s[3], worker or holder, "" if event != "failed" else "reported"))
        return s, out


def _columns(events: DataFrame) -> list:
    own = set(events.columns)
    return ["job_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "event", *[F.col(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in (("worker", "string"), ("max_attempts", "int"))]]


def job_fold(events: DataFrame, rules: Rules | None = None, until: int | None = None) -> DataFrame:
    """events (job_id, ts, seq, event[, worker, max_attempts]) -> transitions (OUT), jobs settled at `until` (microseconds) in the end.

    Each task goes through the sorted events of its jobs and holds one state.
    """
    rules = rules or Rules()
    rows = events.select(*_columns(events)).repartition("job_id").sortWithinPartitions("job_id", "at", "seq")

    def run(frames):
        import pandas as pd

        names = [c.split()[0] for c in OUT.split(", ")]
        job, s = None, None
        for f in frames:
            out = []
            for j, at, event, worker, most in zip(f["job_id"].tolist(), f["at"].tolist(), f["event"], f["worker"], f["max_attempts"].astype("object")):
                if j != job:
                    if job is not None and until is not None:
                        out += [(job, *x) for x in rules.settle(s, until)[1]]
                    job, s = j, None
                s, more = rules.apply(s, at, event, worker, None if pd.isna(most) else int(most))
                out += [(j, *x) for x in more]
            yield pd.DataFrame(out, columns=names)
        if job is not None and until is not None:
            yield pd.DataFrame([(job, *x) for x in rules.settle(s, until)[1]], columns=names)

    return rows.mapInPandas(run, OUT)


class _Jobs(StatefulProcessor):
    """State: a job, and its events that the watermark hasn't passed.

    A job has a timer at its first waiting event and one at its deadline, not one for each event. A timer takes all events
    that the watermark has passed, so that a job's events are read and sorted once a batch, however many they are.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)
        self.waiting = handle.getListState("waiting", "at long, seq long, event string, worker string, max_attempts int")

    def handleInputRows(self, key, rows, timerValues):
        new = [tuple(r[c] for c in IN) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(r[0] for r in new) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row

        # events that come later are behind the watermark, so all up to it can be taken
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        s = tuple(self.job.get()) if self.job.exists() else None
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        out, rest = [], [w for w in waiting if w[0] > now]
        for at, _, event, worker, most in waiting[: len(waiting) - len(rest)]:
            s, more = self.rules.apply(s, at, event, worker, most)
            out += more
        s, more = self.rules.settle(s, now)
        out += more
        if rest:
            if len(rest) < len(waiting):
                self.waiting.put(rest)
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        elif waiting:
            self.waiting.clear()
        if s is None:
            if self.job.exists():
                self.job.clear()
        else:
            self.job.update(s)
            if (end := self.rules.deadline(s)) is not None:
                self.handle.registerTimer(end // 1000 + 1)
        names = [c.split()[0] for c in OUT.split(", ")]
        return iter([Row(**dict(zip(names, (key[0], *x)))) for x in out])

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Timers and several states for a key need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_stream(events: DataFrame, rules: Rules | None = None, late: str = "1 hour") -> DataFrame:
    """Streaming form of job_fold; ts is a timestamp. Events later than `late` behind the newest are dropped, and a job is settled up to the watermark."""
    state_store(events.sparkSession)
    cols = _columns(events)
    keyed = events.withWatermark("ts", late).select("ts", *cols).groupBy("job_id")
    return keyed.transformWithState(_Jobs(rules or Rules()), OUT, "append", "eventTime")


# queries


def _job_events(e: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for x in ("view", "enqueued", "signup", "enqueued", "click", "claimed", "purchase", "completed", "error", "failed")])
    return e.select(F.col("user_id").cast("long").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"), kind[F.col("event_type")].alias("event"), F.concat(F.lit("w"), F.col("event_id") % 5).alias("worker"), F.lit(4).alias("max_attempts"))


RULES = Rules(lease=7200, keep=86400)


def ss2_job_fold(spark, d):
    """Jobs are users: what they view or sign up is enqueued, clicks claim, purchases complete, errors fail."""
    return job_fold(_job_events(read(spark, d, "events")), RULES)


def ss2_job_stream(spark, d):
    """The same through the stream: transitions of all events that the watermark passes."""
    out, at = shared_folder(spark, "jobs"), shared_folder(spark, "jobs-state")
    stream = job_stream(_job_events(available(spark, f"{d}/events.parquet")), RULES)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(OUT).parquet(out)


QUERIES = {f.__name__: f for f in (ss2_job_fold, ss2_job_stream)}
#: A fold with timers is no SQL; the tests compare with a plain loop.
SQL: dict[str, str] = {}
