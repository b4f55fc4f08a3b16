import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from ledgerloom.operators import levels, ranking, records
from ledgerloom.operators.chunking import LEVELS, split_text
from ledgerloom.operators.prefix import running_before


def plain_merge(hits, tree, threshold=2, times=2):
    """One query's hits in order, merged as lists."""
    replaced = steps = 0
    for _ in range(times):
        n = Counter(tree.get(c) for c, *_ in hits if tree.get(c))
        out, slot, before = [], {}, replaced
        for c, pos, score, merged in hits:
            p = tree.get(c)
            if not p or n[p] < threshold or p not in tree:
                out.append([c, pos, score, merged])
            else:
                replaced += 1
                if p in slot:
                    out[slot[p]][2] = max(out[slot[p]][2], score)
                else:
                    slot[p] = len(out)
                    out.append([p, pos, score, n[p]])
        hits, steps = out, steps + (replaced > before)
    return sorted(map(tuple, hits)), (replaced, steps, len(hits))


def test_merge_against_lists(spark):
    rnd = random.Random(4)
    tree = {f"c{i}": f"b{i // 3}" for i in range(60)} | {f"b{i}": f"a{i // 3}" for i in range(20) if i % 7} | {f"a{i}": "" for i in range(7) if i != 2} | {"lone": None}
    hits = {}
    for q in range(25):
        ids = rnd.sample([*tree, "unknown"], rnd.randint(0, 30))
        hits[q] = [(c, i + 1, float(rnd.randint(1, 9)), 0) for i, c in enumerate(ids)]
    frame = spark.createDataFrame([(q, *h[:3]) for q, hs in hits.items() for h in hs], "query_id long, chunk_id string, pos int, score double")
    t = spark.createDataFrame(list(tree.items()), "chunk_id string, parent_id string")
    out, summary = levels.merge_levels(frame, t)
    got = defaultdict(list)
    for r in out.collect():
        got[r.query_id].append((r.chunk_id, r.pos, r.score, r.merged))
    told = {r.query_id: (r.replaced, r.steps, r.left) for r in summary.collect()}
    for q, hs in hits.items():
        want, numbers = plain_merge(hs, tree)
        assert sorted(got[q]) == want and (not hs or told[q] == numbers)
    assert any(n[1] == 2 for n in told.values())


def test_production_path(spark):
    hits = spark.createDataFrame([(1, "c1", 1, 9.0), (1, "c2", 2, 8.0), (1, "c4", 3, 7.0), (1, "x", 4, 1.0)], "query_id long, chunk_id string, pos int, score double")
    tree = spark.createDataFrame([("c1", "b1"), ("c2", "b1"), ("c4", "b2"), ("b1", "a1"), ("b2", "a1"), ("a1", "")], "chunk_id string, parent_id string")
    out = levels.production(hits, tree, F.when(F.col("chunk_id") == "b1", 3.0), 5, 2.0).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.rerank_score, r.merged) for r in out] == [("c4", 7.0, None, 0), ("b1", 9.0, 3.0, 2)]
    assert levels.production(hits.limit(0), tree, F.lit(None).cast("double"), 5, 2.0).count() == 0


def test_ingestion_keeps_all_text_and_order(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9)))
    text = lambda n: "\n".join(rnd.choice(["", "## Part " + word(), " ".join(word() for _ in range(rnd.randint(1, 90)))]) for _ in range(n))
    pages = [(d, f"f{d}", p, rnd.choice([None, "", " \n ", text(3), text(60), "x" * 5000])) for d in range(6) for p in range(5)]
    got = levels.ingested(spark.createDataFrame(pages, "doc_id long, filename string, page int, text string")).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d, rows in by_doc.items():
        rows.sort(key=lambda r: r.chunk_idx)
        assert [r.chunk_idx for r in rows] == list(range(len(rows))) and [r.page for r in rows] == sorted(r.page for r in rows)
        ids = {r.chunk_id: r for r in rows}
        assert len(ids) == len(rows)
        for r in rows:
            assert len(r.text) <= LEVELS[r.chunk_level - 1][0] and r.text == r.text.strip()
            assert (r.parent_chunk_id == "") == (r.chunk_level == 1)
            if r.parent_chunk_id:
                assert ids[r.parent_chunk_id].chunk_level == r.chunk_level - 1 and r.text in ids[r.parent_chunk_id].text and ids[r.root_chunk_id].chunk_level == 1
        for p in range(5):
            own = [r for r in rows if r.page == p]
            for level in (1, 2, 3):
                numbers = [int(r.chunk_id.rsplit("::", 1)[1]) for r in own if r.chunk_level == level]
                assert numbers == list(range(len(numbers)))
    whole = [r.text for r in got if r.chunk_level == 1 and r.text.startswith("xxx")]
    assert whole[:3] == [t for t in split_text("x" * 5000, *LEVELS[0])][:3] or not whole


def test_running_totals_of_a_hot_owner(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "pos long, owner string, v int").repartition(5)
    want, total = {}, Counter()
    for i, o, v in rows:
        want[i] = total[o]
        total[o] += v
    for bins in (1, 2, 13):
        assert {r.pos: r.before for r in running_before(df, "owner", "pos", F.col("v"), bins=bins).collect()} == want
        assert {r.pos: r.before for r in running_before(df, "owner", "pos", F.col("v"), below=300, bins=bins).collect()} == {i: b for i, b in want.items() if b < 300}
    assert running_before(df.limit(0), "owner", "pos", F.col("v")).count() == 0
    same = df.withColumn("pos", F.lit(1)).limit(1)
    assert running_before(same, "owner", "pos", F.col("v")).first().before == 0
    parts = spark.createDataFrame([("a", 1, "x" * 5), ("a", 2, None), ("a", 3, "y" * 5), ("a", 4, "z")], "owner string, pos int, text string")
    assert [(r.pos, r.text) for r in ranking.budget(parts, "owner", "pos", 8).orderBy("pos").collect()] == [(1, "xxxxx"), (2, None), (3, "yyy")]


def test_fact_candidates_of_notes(spark):
    note = "2024-5-6 复查\n过敏史：青霉素\n当前用药: 二甲双胍；诊断：2型糖尿病。手术史:阑尾切除\n疫苗：流感\n血压 138/92 mmhg，空腹血糖：7.8 MMOL/L 血糖6"
    rows = [("1", 3, note), ("2", None, "用药：x"), ("3", 1, None), ("4", 1, "2024/13/45 血压：120／80")]
    got = records.fact_candidates(spark.createDataFrame(rows, "chunk_id string, page int, text string")).collect()
    of = lambda c: [(r.resource_type, r.display, r.value, r.confidence) for r in got if r.chunk_id == c]
    assert of("1") == [
        ("AllergyIntolerance", "青霉素", {}, 0.58), ("MedicationStatement", "二甲双胍", {}, 0.58), ("Condition", "2型糖尿病", {}, 0.58), ("Procedure", "阑尾切除", {}, 0.58), ("Immunization", "流感", {}, 0.58),
        ("Observation", "血压", {"systolic": "138", "diastolic": "92", "unit": "mmhg"}, 0.72), ("Observation", "血糖", {"value": "7.8", "unit": "MMOL/L"}, 0.72), ("Observation", "血糖", {"value": "6.0", "unit": "mmol/L"}, 0.72),
    ]
    assert of("2") == [] and of("3") == [] and len(of("4")) == 1
    assert {(r.chunk_id, str(r.effective_start), r.time_precision) for r in got} == {("1", "2024-05-06", "day"), ("4", "None", "approximate")}


def test_hits_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    kind = "query_id long, chunk_id string, pos int, score double"
    rows = spark.createDataFrame([(1, "c1", 1, 9.0), (1, "c2", 2, 8.0), (2, "c4", 1, 7.0), (2, None, 2, 1.0)], kind).mapInPandas(counted, kind)
    tree = spark.createDataFrame([("c1", "b1"), ("c2", "b1"), ("c4", "b2"), ("b1", "a1"), ("b2", "a1"), ("a1", "")], "chunk_id string, parent_id string")
    out, summary = levels.merge_levels(rows, tree.union(tree))  # rows of the tree that are there twice count once
    assert sorted((r.chunk_id or "", r.merged) for r in out.collect()) == [("", 0), ("b1", 2), ("c4", 0)] and summary.count() == 2
    assert seen.value == 4
