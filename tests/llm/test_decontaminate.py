import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as dc

W = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return W.findall((t or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            g = b[i : i + 10]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    vocab = ["the", "Of", "é", "Éa", "x1", "and", "to"] + [f"w{i}" for i in range(30)]
    say = lambda n: rnd.choice([" ", "\n", ", ", "--"]).join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 18, 30, 30])] + [(10, None), (11, "!!"), (12, ""), (13, None)]
    items.append((14, items[8][1]))
    for drop in (0, 5):  # with short items, and with long ones only
        some = items[drop:]
        docs = [(0, None), (1, ""), (2, "?"), (3, items[7][1]), (3, items[7][1].upper()), (4, " ".join(x[1] or "" for x in items) * 3)]
        for i in range(5, 80):
            t = say(rnd.randint(0, 60))
            if rnd.random() < 0.5:
                b = (rnd.choice(items)[1] or "").split(" ")
                a = rnd.randint(0, len(b))
                t += " " + " ".join(b[a : a + rnd.randint(1, 25)]) + " " + say(rnd.randint(0, 20))
            docs.append((i, t))
        docs.append((None, items[8][1]))
        path = f"{tmp_path}/{drop}"
        spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(some, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        got = sorted((tuple(r) for r in dc.op10_decontaminate(spark, path).collect()), key=str)
        assert got == sorted(((d, *brute(t, some)) for d, t in docs), key=str)


def test_shuffled_lookups_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before, {item.upper()}; after", 5), (2, "clean text", 6), (None, None, 7)], "doc_id long, text string, n_words int").withColumn("id", F.col("n_words")).withColumn("item", F.lit("x")).withColumn("w", F.lit(1))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = dc.contamination(docs, items, max_broadcast=0)
    assert out.columns[:6] == docs.columns and "_n_words" in out.columns
    assert {(r.doc_id, r._n_words, r.n_hit) for r in out.collect()} == {(1, 13, 11), (2, 2, 0), (None, 0, 0)}
    assert {r.doc_id for r in dc.decontaminate(docs, items).collect()} == {2, None}
    assert {r.text for r in dc.decontaminate(docs, items, remove="spans").collect()} == {"Before, ; after", "clean text", None}
    assert dc.decontaminate(docs, items).columns == docs.columns == dc.decontaminate(docs, items, remove="spans").columns
    assert dc.contamination(docs.limit(0), items).count() == 0 and dc.decontaminate(docs, items.limit(0)).count() == 3


def test_removed_spans_against_plain_version(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(rnd.choice("abcdefg") for _ in range(10))) for i in range(4)] + [(9, "x y")]
    docs = []
    for i in range(60):
        parts = [rnd.choice([t for _, t in items] + ["a b, c", "--", "d", "Z"]) for _ in range(rnd.randint(0, 6))]
        docs.append((i, rnd.choice(["", "(", "x. "]) + rnd.choice([" ", ", ", "\n"]).join(parts) + rnd.choice(["", ".", " end"])))

    def plain(t):
        found, w = list(re.finditer("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)), words(t)
        hit = set()
        for _, b in items:
            g = words(b)
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
        out, at = "", 0
        for k, m in enumerate(found):
            if not (k in hit and k - 1 in hit):
                out += t[at : m.start()]
            if k not in hit:
                out += m[0]
            at = m.end()
        return out + t[at:]

    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dict(map(tuple, dc.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), remove="spans").collect()))
    assert got == {d: plain(t) for d, t in docs}
