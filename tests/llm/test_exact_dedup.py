import hashlib
import random

import pytest

from ledgerloom.llm import exact_dedup


@pytest.mark.parametrize("bits", [exact_dedup.BITMAP_BITS, 1 << 26])
def test_groups(spark, bits):
    rnd = random.Random(1)
    texts = [None, "", "", "a", "A", "a ", "hot"] + ["hot"] * 300 + [str(rnd.randrange(400)) for _ in range(600)] + ["é" * 100_000] * 2
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, kept string, bits1 string")
    out = exact_dedup.exact_groups(df, max_bits=bits)
    assert out.columns[:4] == df.columns and {"keep_id", "group_size", "_kept", "text_sha256"} <= set(out.columns)
    rows = out.collect()
    groups: dict[str, list[int]] = {}
    for d, t in docs:
        groups.setdefault(t or "", []).append(d)
    assert len(rows) == len(docs)
    for r in rows:
        g = groups[r.text or ""]
        assert (r.keep_id, r.group_size, r._kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256((r.text or "").encode()).hexdigest())
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == len(groups)


def test_small_filter_is_still_right(spark):
    """With about as many repeated texts as bits, most rows are grouped exactly."""
    df = spark.range(70_000).selectExpr("id as doc_id", "cast(id % 39000 as string) as text")
    assert exact_dedup.exact_dedup(df, max_bits=exact_dedup.BITMAP_BITS).count() == 39_000


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "b"), (2, "b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert got == [("1", 1, True), ("2", 2, True), ("2", 2, True), ("None", 1, False)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0
