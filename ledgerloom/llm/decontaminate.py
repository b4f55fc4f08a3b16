"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of n normalised words form a hash set. Whole training
texts are scanned in two steps. A window of L words covers a block of g = (L + 1) // 2 words that
starts at a multiple of g, wherever it occurs, so a document needs to look up
only its aligned blocks in the set of all blocks of the windows. Documents with
such a block are candidates; all their windows are looked up and compared word by word.

Sets are broadcast only if their rows, words included, sum up to at most `max_broadcast` bytes;
beyond that the lookups are shuffled joins. Documents are shuffled only if the
candidates' ids are too many to broadcast by Spark's own threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ascii_lower, fresh, let, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
#: Bytes of a set up to which it is broadcast.
MAX_BROADCAST = 32_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _grams(words_: Column, size: int | Column, step: int | Column = 1) -> Column:
    """Runs of `size` words, at every `step`-th word; none where there are fewer words."""

    def runs(w):
        last = F.size(w) - size
        starts = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / step).cast("int")), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(w, i + 1, size).alias("w")))

    return let(words_, runs)


def benchmark_windows(items: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, w, h): the distinct windows of each item; an item of fewer than n words, but not none, is one window."""
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    grams = w.select("item", F.explode(_grams(F.col("all"), F.least(F.size("all"), F.lit(n)))).alias("g"))
    return grams.select("item", F.col("g.w").alias("w")).distinct().withColumn("h", F.xxhash64(F.size("w"), F.col("w")))


def _small(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df.hint("merge")


def contamination(docs: DataFrame, items: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All rows and columns of `docs`, with these added: n_words, n_hit (words inside any occurrence of a window), items
    (sorted ids, as strings, of the items with occurring windows) and hits (array of (at, size) of the occurrences).

    Null texts have no words and null item texts no windows; a null item id is the empty string.
    Every row is judged alone, also where ids repeat or are null. Without items or documents nothing
    is hit. Added columns whose names `docs` has get underscores in front.
    """
    n_words, n_hit, found, hits, rid, all_words, cid = fresh(docs, "n_words", "n_hit", "items", "hits", "rid", "words", "cid")
    windows = written(benchmark_windows(items, n, item_col, text_col))
    sizes = sorted(r[0] for r in windows.select(F.size("w")).distinct().collect())  # n numbers at most
    size = windows.agg(F.sum(F.lit(64) + F.octet_length("item") + F.octet_length(F.array_join("w", "        ")))).first()[0] or 0
    none = F.array().cast("array<struct<at:int,size:int>>")
    counted = docs.withColumn(all_words, words(F.col(text_col)))
    clean = [F.size(all_words).cast("bigint").alias(n_words), F.lit(0).cast("bigint").alias(n_hit), F.array().cast("array<string>").alias(found), none.alias(hits)]
    if not sizes:
        return counted.select(*docs.columns, *clean)

    half = (F.size("w") + 1) / 2
    blocks = windows.select(F.floor(half).cast("int").alias("g"), "w").select("g", F.explode(_grams(F.col("w"), F.col("g"))).alias("b"))
    blocks = written(blocks.select(F.xxhash64("g", "b.w").alias("h")).distinct())
    aligned = lambda g: F.transform(_grams(F.col(all_words), g, g), lambda x: F.xxhash64(F.lit(g), x["w"]))
    hashed = [aligned(g) for g in sorted({(s + 1) // 2 for s in sizes})]
    looked = counted.select(F.col(id_col).alias(cid), F.explode(F.concat(*hashed)).alias("h"))
    cand = written(looked.join(_small(blocks, 24 * blocks.count(), max_broadcast), "h", "left_semi").select(cid).distinct())

    # null ids meet each other: their rows are all looked at
    same = F.col(id_col).eqNullSafe(F.col(cid))
    rows = written(docs.join(cand, same, "left_semi").withColumn(rid, F.monotonically_increasing_id()))
    rest = counted.join(cand, same, "left_anti").select(*docs.columns, *clean)
    looked = reduce(DataFrame.unionByName, [rows.select(F.col(rid).alias("r"), F.explode(_grams(words(F.col(text_col)), s)).alias("g")) for s in sizes])
    looked = looked.select("r", F.col("g.at").alias("at"), F.col("g.w").alias("dw"), F.xxhash64(F.size("g.w"), F.col("g.w")).alias("dh"))
    met = looked.join(_small(windows, size, max_broadcast), (F.col("dh") == F.col("h")) & (F.col("dw") == F.col("w")))
    by_row = met.groupBy(F.col("r").alias(rid)).agg(F.sort_array(F.collect_set("item")).alias(found), F.sort_array(F.collect_set(F.struct("at", F.size("dw").alias("size")))).alias(hits))
    # sorted occurrences: each adds the words after the end of those before
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(
        hits,
        start,
        lambda a, s: F.struct(F.greatest(a["end"], s["at"] + s["size"]).alias("end"), (a["n"] + F.greatest(s["at"] + s["size"] - F.greatest(a["end"], s["at"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )
    out = rows.join(by_row, rid, "left")
    return rest.unionByName(
        out.select(
            *docs.columns,
            F.size(words(F.col(text_col))).cast("bigint").alias(n_words),
            F.when(F.col(hits).isNull(), F.lit(0)).otherwise(covered).cast("bigint").alias(n_hit),
            F.coalesce(F.col(found), F.array().cast("array<string>")).alias(found),
            F.coalesce(F.col(hits), none).alias(hits),
        )
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """`docs` without benchmark passages: hit documents go (remove="documents"), or the hit words, with what stands between them (remove="spans")."""
    n_hit, hits = fresh(docs, "n_hit", "hits")
    out = contamination(docs, items, **options)
    if remove == "documents":
        return out.where(F.col(n_hit) == 0).select(*docs.columns)
    text = F.col(options.get("text_col", "text"))
    # hits that meet or overlap are one span, from the last back to the first; all spans and pieces are walked once
    span = lambda a, z: F.struct(a.alias("from"), z.alias("to"))
    ended = lambda s: s["at"] + s["size"]
    none = F.array().cast("array<struct<from:int,to:int>>")
    last = F.struct(none.alias("done"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"))
    close = lambda acc: F.when(acc["from"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(span(acc["from"], acc["to"]))))
    join = lambda acc, s: F.when(s["at"] <= acc["to"], F.struct(acc["done"].alias("done"), acc["from"].alias("from"), F.greatest(acc["to"], ended(s)).alias("to"))).otherwise(F.struct(close(acc).alias("done"), s["at"].alias("from"), ended(s).alias("to")))
    spans = F.aggregate(F.col(hits), last, join, close)
    pieces = F.zip_with(F.split(text, WORD_ANY_CASE, -1), F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0)), lambda g, w: F.struct(g.alias("g"), F.coalesce(w, F.lit("")).alias("w")))

    def kept(ps, ss):
        whole = lambda a, z: F.array_join(F.transform(F.slice(ps, a + 1, F.greatest(z - a, F.lit(0))), lambda p: F.concat(p["g"], p["w"])), "")
        # before each span: the words since the one before, and the gap in front of the span's first word
        parts = F.transform(ss, lambda s, i: F.concat(whole(F.coalesce(F.get(ss, i - 1)["to"], F.lit(0)), s["from"]), F.get(ps, s["from"])["g"]))
        return F.concat(F.array_join(parts, ""), whole(F.get(ss, F.size(ss) - 1)["to"], F.size(ps)))

    cleaned = let(pieces, lambda ps: let(spans, lambda ss: kept(ps, ss)))
    return out.withColumn(options.get("text_col", "text"), F.when(F.col(n_hit) > 0, cleaned).otherwise(text)).select(*docs.columns)


#: The same words before lower-casing.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def op10_decontaminate(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "op10_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM benchmark),
        win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w[i : i + {N - 1}] AS g FROM b, unnest(range(1, greatest(len(w) - {N - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT len(g) AS s FROM win),
        occ AS (SELECT doc_id, i, s, w[i : i + s - 1] AS g FROM d, sizes, unnest(range(1, len(w) - s + 2)) AS t(i)),
        met AS (SELECT doc_id, i, s, item FROM occ JOIN win USING (g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM met, unnest(range(i, i + s)) AS t(p) GROUP BY doc_id),
        its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """
}
QUERIES = {"op10_decontaminate": op10_decontaminate}
