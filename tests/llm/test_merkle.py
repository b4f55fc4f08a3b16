import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle as own

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes):
    """Root of a list of digests, and for each the joined siblings and places level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for p, i in zip(paths, at):
            run = runs[i // 8]
            p.append((i % 8, "".join(x for j, x in enumerate(run) if j != i % 8)))
        nodes, at = [sha("".join(r)) for r in runs], [i // 8 for i in at]
    return nodes[0], paths


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        langs[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = climbed([leaf(r) for r in langs[g]])
    root, tops = climbed([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops):
        for r, p in zip(langs[g], trees[g][1]):
            p = p + top
            low = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if low else leaf(r)
            for place, s in p:
                h = sha(s[: 64 * place] + h + s[64 * place :])
            out.append((r[0], leaf(r), trees[g][0], root, sha("".join(s for _, s in p)), h, h == root))
    return out


def rows_of(n, langs, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), rnd.choice(langs), rnd.choice([None, 5, -7]), rnd.choice([None, "", "Abc é", "xyz", "W" * 5000])) for i in range(n)]


def check(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in own.op13_merkle(spark, str(tmp_path)).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_against_a_plain_tree(spark, tmp_path):
    rows = rows_of(700, ["en", "fr", None, "", "é", "z"]) + [(i, None, f"l{i}", None, "One") for i in range(1000, 1012)]
    rows += [rows[5]] * 90 + [(None, None, None, None, None), (None, "x", "en", 1, "y"), (7, "x", "en", 1, "y"), (8, None, "en", None, "")]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_sizes(spark, tmp_path, n):
    check(spark, tmp_path, rows_of(n, ["en"], n))


@pytest.mark.parametrize("deep", [1, 2])
def test_blocks_feed_further_traversals(spark, deep):
    rows = rows_of(600, ["en", "en", "en", "fr", None, *(f"l{i}" for i in range(80))])
    low = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    out = own.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), own.FIELDS, claims={"text": low}, deep=deep)
    assert sorted((*r, r.folded_root == r.root) for r in out.collect()) == sorted(plain(rows))


def test_many_rows_of_one_group(spark, tmp_path):
    check(spark, tmp_path, [(i, None, "en", i, f"Text {i}") for i in range(9000)])


def test_proofs_fold_to_the_root(spark):
    df = spark.createDataFrame(rows_of(300, ["en", "fr", None]), SCHEMA)
    out = own.manifest(df, own.FIELDS, proofs=True).withColumn("f", own.fold(F.col("leaf"), F.col("at"), F.col("siblings"))).collect()
    assert len(out) == 300 and all(r.f == r.root == r.folded_root and sha("".join(r.siblings)) == r.proof_sha256 for r in out)


def test_shape_of_input(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "en", 1, "T", "x", 2)], SCHEMA + ", leaf string, idx int")
    assert own.manifest(df, own.FIELDS).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
    assert own.manifest(df, own.FIELDS).first().root == leaf((1, "a", "en", 1, "T"))
    assert own.manifest(df.limit(0), own.FIELDS).count() == 0


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cols = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    want = con.execute(f"SELECT {cols} FROM ({own.SQL['op13_merkle']})").fetchall()
    got = [tuple(r) for r in own.op13_merkle(spark, sf).collect()]
    assert sorted(got) == sorted(want) and {r[6] for r in got} == {True, False}
