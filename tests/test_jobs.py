import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs
from ledgerloom.streaming.state import available

SCHEMA = "job_id long, ts timestamp, seq long, event string, worker string, max_attempts int"
START = datetime.datetime(2024, 1, 1)
BASE = int(START.replace(tzinfo=datetime.timezone.utc).timestamp()) * jobs.SECOND
RULES = jobs.Rules(lease=900, keep=30_000)


def plain(events, until):
    """A loop over seconds-free times, written on its own: {job: [(at, status, attempts)]}."""
    out = {}
    for job in sorted({e[0] for e in events}):
        s = None  # [status, attempts, most, run_after, locked, ended]
        log = out.setdefault(job, [])

        def pass_time(t):
            nonlocal s
            while s:
                if s[0] == "running" and s[4] + 900 * jobs.SECOND < t:
                    end = s[4] + 900 * jobs.SECOND
                    s = ["failed", s[1], s[2], s[3], None, end] if s[1] >= s[2] else ["retry_wait", s[1], s[2], end, None, None]
                    log.append((end, s[0], s[1]))
                elif s[5] is not None and s[5] + 30_000 * jobs.SECOND < t:
                    s = None
                else:
                    return

        for _, ts, seq, event, worker, most in sorted((e for e in events if e[0] == job), key=lambda e: (e[1], e[2])):
            t = int(ts.replace(tzinfo=datetime.timezone.utc).timestamp() * jobs.SECOND + 0.5)
            pass_time(t)
            if s is None and event == "enqueued":
                s = ["queued", 0, most, t, None, None]
            elif s and event == "claimed" and s[0] in ("queued", "retry_wait") and s[3] <= t:
                s = ["running", s[1] + 1, s[2], s[3], t, None]
            elif s and event == "completed" and s[0] == "running":
                s = ["completed", s[1], s[2], s[3], None, t]
            elif s and event == "failed" and s[0] == "running":
                s = ["failed", s[1], s[2], s[3], None, t] if s[1] >= s[2] else ["retry_wait", s[1], s[2], t + min(3600, 15 * 2 ** (s[1] - 1)) * jobs.SECOND, None, None]
            else:
                continue
            log.append((t, s[0], s[1]))
        pass_time(until)
    return {j: x for j, x in out.items() if x}


def some_events(n=600, job_ids=12, hours=30):
    rnd = random.Random(7)
    return [(rnd.randrange(job_ids), START + datetime.timedelta(seconds=rnd.randrange(hours * 3600)), i, rnd.choice(["enqueued", "claimed", "claimed", "completed", "failed", "failed"]), f"w{i % 3}", 3) for i in range(n)]


def by_job(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.job_id, r.at)):
        out.setdefault(r.job_id, []).append((r.at, r.status, r.attempts))
    return out


def test_batch_fold(spark):
    events = some_events()
    until = BASE + 40 * 3600 * jobs.SECOND
    got = jobs.job_fold(spark.createDataFrame(events, SCHEMA).repartition(3), RULES, until).collect()
    assert by_job(got) == plain(events, until)
    assert {r.error for r in got} >= {"stale_worker_timeout", "stale_worker_requeued"} and {r.status for r in got} == {"queued", "running", "retry_wait", "failed", "completed"}
    assert jobs.job_fold(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_waits_grow(spark):
    s, _ = RULES.apply(None, 0, "enqueued", None, 10)
    waits, now = [], 0
    for _ in range(9):
        s, _ = RULES.apply(s, now, "claimed", "w", None)
        s, out = RULES.apply(s, now, "failed", "w", None)
        waits.append((out[0][4] - now) // jobs.SECOND)
        now = out[0][4]
    assert waits == [15, 30, 60, 120, 240, 480, 960, 1920, 3600]


def test_stream_equals_the_fold_over_restarts(spark, tmp_path):
    events = sorted(some_events(300), key=lambda e: e[1])
    late = random.Random(3)
    parts = [events[i : i + 100] for i in range(0, 300, 100)]
    for i in range(2):  # some events come one batch late
        moved = [e for e in parts[i] if e[1] > max(x[1] for x in parts[i]) - datetime.timedelta(minutes=50) and late.random() < 0.5]
        parts[i] = [e for e in parts[i] if e not in moved]
        parts[i + 1] = parts[i + 1] + moved
    end = START + datetime.timedelta(hours=60)
    parts.append([(99, end, 10_000, "enqueued", "w", 3)])
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.job_stream(available(spark, f"{tmp_path}/in"), RULES)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("append").start()
        q.awaitTermination()
    got = by_job(spark.read.schema(jobs.OUT).parquet(f"{tmp_path}/out").collect())
    got.pop(99, None)
    assert got == plain(events, BASE + 59 * 3600 * jobs.SECOND)


def test_query_stream(spark):
    d = "/root/testdata/sf0.001"
    fold = {tuple(r) for r in jobs.ss2_job_fold(spark, d).collect()}
    passed = spark.read.parquet(f"{d}/events.parquet").agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0] - 3600 * jobs.SECOND
    got = {tuple(r) for r in jobs.ss2_job_stream(spark, d).collect()}
    assert got and {r for r in fold if r[1] < passed - jobs.SECOND} <= got


class _Held:
    """A state and its handle in memory, with the number of reads."""

    def __init__(self):
        self.states, self.timers, self.reads = {}, set(), 0

    def getValueState(self, name, schema):
        return self.states.setdefault(name, _Cell(self))

    getListState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


class _Cell:
    def __init__(self, held):
        self.held, self.value = held, None

    def exists(self):
        return self.value is not None

    def get(self):
        self.held.reads += 1
        return iter(self.value) if isinstance(self.value, list) else self.value

    def appendValue(self, v):
        self.value = (self.value or []) + [v]

    def appendList(self, v):
        self.value = (self.value or []) + v

    def put(self, v):
        self.value = v

    update = put

    def clear(self):
        self.value = None


def test_stream_reads_a_jobs_events_once_a_batch():
    class Now:
        getExpiryTimeInMs = getCurrentWatermarkInMs = None

        def __init__(self, ms):
            self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms

    events = [(0, *e[1:]) for e in some_events(2000, hours=90)]
    rows = [{"at": BASE + int((e[1] - START).total_seconds()) * jobs.SECOND, "seq": e[2], "event": e[3], "worker": e[4], "max_attempts": e[5]} for e in events]
    held, p, got = _Held(), jobs._Jobs(RULES), []
    p.init(held)
    p.handleInputRows((0,), iter(rows), Now(0))
    # two batches, the watermark at a third and behind the end
    for mark in (BASE // 1000 + 30 * 3_600_000, BASE // 1000 + 100 * 3_600_000):
        while due := sorted(t for t in held.timers if t <= mark):
            held.timers.discard(due[0])
            got += list(p.handleExpiredTimer((0,), Now(mark), Now(due[0])))
    assert by_job(got) == plain(events, BASE + 100 * 3600 * jobs.SECOND)
    assert held.reads <= 20
