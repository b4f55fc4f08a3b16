"""Exact deduplication by two passes of Bloom filtering, with DataFrame functions only.

Pass one counts, for each of two hash functions, how many rows fall on each of
2**48 slots; slots are numbers that are counted, not memory. Slots that at least two rows share go into a Bloom filter as
bitmaps, whose size follows the number of such slots and not that of all rows. Pass two probes both bitmaps: a row of which either bit is unset
has no copy and passes straight through; only the others are shuffled and
grouped by the SHA-256 of their text, which decides exactly.

The bitmaps are broadcast. Their size is bounded by `max_bits` (2**29 bits:
64 MB for each hash function), whatever the input; beyond some tens of millions of repeated texts
more rows without copies reach the exact grouping, which stays right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, written

#: Bits of one bitmap row, as the bitmap functions of Spark define it.
BITMAP_BITS = 32768
SLOTS = 1 << 48
MAX_BITS = 1 << 29
#: Copies of a group's answer, so that the rows of a hot text meet it in several tasks.
SALTS = 16


def _slot(digest: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(seed)), F.lit(SLOTS).cast("bigint"))


def _bitmap(shared: DataFrame, seed: int, bits: int) -> DataFrame:
    """(bucket, bits): the shared slots of a hash function. At most bits / BITMAP_BITS rows of 4 KB."""
    at = F.col("slot") % bits + 1  # bitmap_bucket_number is for positive numbers that start from 1
    return shared.where(F.col("seed") == seed).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def _bit(bits: Column, slot: Column) -> Column:
    at = F.bitmap_bit_position(slot + 1)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """All rows and columns of `df`, with `keep_id`, `group_size`, `kept` and `text_sha256` added.

    Texts are equal when they are identical; null counts as empty. Of equal texts
    the row with the largest id stays (`keep_id`); repeated rows with that same id
    are all marked as kept, and null ids lose against any other. An empty table gives
    an empty result. Texts are hashed whole, however long. Added columns whose names `df` has get underscores in front.
    """
    keep, size, kept, sha, hot, b1, b2, bits1, bits2, key = fresh(df, "keep_id", "group_size", "kept", "text_sha256", "maybe", "bucket1", "bucket2", "bits1", "bits2", "key")
    salt, of = fresh(df, "salt", "salt_of")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    slots = df.select(digest.alias(sha)).select(F.explode(F.array(*[F.struct(F.lit(i).alias("seed"), _slot(F.col(sha), i).alias("slot")) for i in (1, 2)])).alias("s"))
    shared = written(slots.groupBy("s.seed", "s.slot").agg(F.count("*").alias("n")).where("n > 1").select("seed", "slot"))
    bits, most = BITMAP_BITS, shared.groupBy("seed").count().agg(F.max("count")).first()[0] or 0
    while bits < min(max_bits, 16 * most):
        bits *= 2
    one, two = F.broadcast(_bitmap(shared, 1, bits).toDF(b1, bits1)), F.broadcast(_bitmap(shared, 2, bits).toDF(b2, bits2))
    s1, s2 = _slot(F.col(sha), 1) % bits, _slot(F.col(sha), 2) % bits
    rows = df.withColumn(sha, digest)
    probed = (
        rows.join(one, F.bitmap_bucket_number(s1 + 1) == F.col(b1), "left")
        .join(two, F.bitmap_bucket_number(s2 + 1) == F.col(b2), "left")
        .withColumn(hot, _bit(F.col(bits1), s1) & _bit(F.col(bits2), s2))
        .select(*rows.columns, hot)
    )
    once = probed.where(~F.col(hot)).select(*df.columns, F.col(id_col).alias(keep), F.lit(1).cast("bigint").alias(size), F.lit(True).alias(kept), sha)
    again = probed.where(F.col(hot)).drop(hot)
    # partial aggregation leaves one row for a text and task, so a hot text is no hot task; on the way back its rows are salted
    groups = again.groupBy(F.col(sha).alias(key)).agg(F.max(id_col).alias(keep), F.count("*").alias(size))
    groups = groups.withColumn(of, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = again.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    back = again.join(groups.hint("merge"), (F.col(sha) == F.col(key)) & (F.col(salt) == F.col(of))).select(*df.columns, keep, size, F.col(id_col).eqNullSafe(F.col(keep)).alias(kept), sha)
    return once.unionByName(back)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """`df` without the rows whose text another row with a larger id has too."""
    kept = fresh(df, "kept")[0]
    return exact_groups(df, id_col, text_col, max_bits).where(F.col(kept)).select(*df.columns)


def op4_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
