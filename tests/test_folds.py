"""Operators that SQL can't express, against plain versions: packing, reviews, tasks, tables, manifests."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import facts, hybrid, lexical, packing, ranking
from ledgerloom.sources import rows as sources
from ledgerloom.streaming import progress


def test_paragraph_groups(spark):
    rnd = random.Random(1)
    texts = [None, "", "  \n ", "one", "a" * 500] + ["\n".join(" " * rnd.randint(0, 2) + "x" * rnd.randint(0, 120) for _ in range(rnd.randint(1, 30))) for _ in range(40)]

    def plain(text):
        out, now, n = [], [], 0
        for p in (x.strip() for x in (text or "").splitlines()):
            if not p:
                continue
            if now and n + len(p) > 200:
                out.append("\n".join(now))
                now, n = [], 0
            now.append(p)
            n += len(p)
        return out + (["\n".join(now)] if now else [])

    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.g for r in df.select("i", packing.paragraph_groups(F.col("text"), 200).alias("g")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_table_rows(spark):
    rnd = random.Random(3)
    tables = []
    for _ in range(30):
        cells = [(r * 12.0 + rnd.random() * 3, c * 20.0 + rnd.random(), rnd.choice([0.0, 6.0, 10.0]), rnd.choice(["a", " b ", "", "c d"])) for r in range(rnd.randint(0, 4)) for c in range(rnd.randint(1, 4))]
        rnd.shuffle(cells)
        tables.append(cells)

    def plain(cells):
        cells = sorted((y, x, max(h, 1.0), t.strip()) for y, x, h, t in cells if t.strip())
        out = []
        for c in cells:
            if out and abs(c[0] - sum(k[0] for k in out[-1]) / len(out[-1])) <= 0.65 * max(c[2], max(k[2] for k in out[-1])):
                out[-1].append(c)
            else:
                out.append([c])
        return "\n".join(" | ".join(k[3] for k in sorted(row, key=lambda k: k[1])) for row in out)

    df = spark.createDataFrame(list(enumerate(tables)), "i int, cells array<struct<y:double,x:double,h:double,text:string>>")
    got = {r.i: r.t for r in df.select("i", packing.table_text(F.col("cells")).alias("t")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(tables)}


def test_reviews(spark):
    rnd = random.Random(5)
    cand = [(i, f"name {i}", rnd.choice([None, "2020-01-01"])) for i in range(60)]
    log = [(rnd.randrange(60), at, rnd.choice(["confirm", "confirm", "reject", "noise"]), rnd.choice([None, f"new {at}"]), rnd.choice([None, None, "2021-02-03"])) for at in range(200)]
    rnd.shuffle(log)
    want = {i: ["pending", d, s, 0] for i, d, s in cand}
    for i, _, action, display, start in sorted(log, key=lambda x: x[1]):
        w = want[i]
        if action == "confirm" and w[0] == "pending":
            w[1], w[2] = display or w[1], start or w[2]
            if w[2]:
                w[0] = "confirmed"
            else:
                w[3] += 1
        elif action == "reject" and w[0] == "pending":
            w[0] = "rejected"
        elif (action, w[0]) not in (("confirm", "confirmed"), ("reject", "rejected")):
            w[3] += 1
    df = facts.reviewed(spark.createDataFrame(cand, "candidate_id int, display string, effective_start string"), spark.createDataFrame(log, "candidate_id int, at int, action string, new_display string, new_start string"))
    got = {r.candidate_id: [r.status, r.display, r.effective_start, r.refused] for r in df.collect()}
    assert got == want
    assert df.where("(status = 'confirmed') <> (fact_id is not null)").count() == 0


def test_tasks(spark):
    rnd = random.Random(7)
    drafts = [(i, i % 35, 100 + i, rnd.choice([None, 60])) for i in range(50)]
    log = [(rnd.randrange(50), at, rnd.choice(["confirm", "complete", "cancel", "x"])) for at in range(160)]
    want = {}
    for i, key, due, every in drafts[:35]:
        status, run, path = "waiting_confirmation", None, ["draft", "waiting_confirmation"]
        for _, at, action in sorted((x for x in log if x[0] == i), key=lambda x: x[1]):
            if action == "confirm" and status == "waiting_confirmation":
                status, run = "active", max(due, at)
            elif action == "cancel" and status not in ("completed", "cancelled"):
                status, run = "cancelled", None
            elif action == "complete" and status == "active" and not every:
                status = "completed"
            else:
                continue
            path.append(status)
        want[i] = (status, run, path)
    df = progress.tasks(spark.createDataFrame(drafts, "task_id int, key int, due_at int, interval_seconds int"), spark.createDataFrame(log, "task_id int, at int, action string"))
    assert {r.task_id: (r.status, r.next_run, r.transitions) for r in df.collect()} == want


def test_bm25_forms_agree(spark, monkeypatch):
    """The form that sends the queries, and the one that joins postings by term."""
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) if i % 9 else None, [f"t{i % 3}"], str(i % 2)) for i in range(300)], "doc_id long, text string, tags array<string>, scope string")
    queries = spark.createDataFrame([(i, " ".join(rnd.sample(words, 5)), [[], ["t1"], None, ["t0", "t2"]][i % 4], str(i % 3)) for i in range(20)], "query_id long, text string, tags array<string>, scope string")
    for drop in ((), ("tags",), ("scope",), ("tags", "scope")):
        q = queries.drop(*drop)
        a = sorted(map(tuple, lexical.bm25(docs, q, 4).collect()))
        monkeypatch.setattr(lexical, "MAX_PAIRS", 0)
        b = sorted(map(tuple, lexical.bm25(docs, q, 4).select("query_id", "doc_id", "score", "rank").collect()))
        monkeypatch.undo()
        assert a == b and a
    assert lexical.bm25(docs.limit(0), queries, 3).count() == 0 and lexical.bm25(docs, queries.limit(0), 3).count() == 0


def test_fuzzy_names(spark):
    names = ["alpha", "alphabet", "al", "a", "beta", "betamax one", "max", "", "xx alpha"]
    terms = ["alpha", "alphabet soup", "ax", "a", "betamax one two", "none"]
    want = set()
    for t in terms:
        hits = sorted((n for n in names if n and (t in n or n in t)), key=lambda n: (-len(n), n))[:3]
        want |= {(t, n, i) for i, n in enumerate(hits, 1)}
    df = ranking.fuzzy(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in terms], "term string"))
    assert {(r.term, r.name, r["rank"]) for r in df.collect()} == want


def test_ladder_and_manifest(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    out = {r.query_id: r for r in hybrid.ladder({"a": leg([(1, 7, 0.5, 1)]), "b": leg([(1, 9, 0.4, 1), (2, 8, 0.4, 1)])}, q, 5).collect()}
    assert [(out[i].mode, out[i].degraded, len(out[i].attempts), [h.doc_id for h in out[i].hits]) for i in (1, 2, 3)] == [("a", False, 1, [7]), ("b", True, 2, [8]), ("no_results", True, 2, [])]
    rows = spark.createDataFrame([(1, 0.5)], "i int, recall double")
    assert sources.manifest_errors({k: 1 for k in sources.MANIFEST}, rows, ["recall"]) == []
    assert len(sources.manifest_errors({}, rows.limit(0), ["recall", "mrr"])) == len(sources.MANIFEST) + 3


def test_experiment_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "approved", "b"), (2, "draft", "a"), (3, "approved", "a")], "i int, status string, external_id string")
    sources.export_cases(rows, f"{tmp_path}/cases")
    assert sorted(r.i for r in spark.read.json(f"{tmp_path}/cases").collect()) == [1, 3]
    sources.write_experiment(f"{tmp_path}/run", {"commit": "x"}, rows, rows.groupBy("status").count())
    assert spark.read.json(f"{tmp_path}/run/records").count() == 3 and spark.read.option("header", "true").csv(f"{tmp_path}/run/comparison").count() == 2
    assert spark.read.text(f"{tmp_path}/run/manifest").first().value == '{"commit": "x"}'
