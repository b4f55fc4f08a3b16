"""Chunks of three levels: pages to chunks as they are ingested, hits merged upwards, and the production path over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.storage import saved
from ledgerloom.functions.tables import read, small, small_batches
from ledgerloom.functions.text import words
from ledgerloom.operators import retrieval
from ledgerloom.operators.chunking import HEADING_WORDS, LEVELS, blocks, split_text
from ledgerloom.operators.lexical import bm25, ranked
from ledgerloom.operators.packing import paragraph_groups

CHUNK = "doc_id long, filename string, page int, chunk_id string, parent_chunk_id string, root_chunk_id string, chunk_level int, n int, section_path string, chunk_kind string, paragraph_group_idx int, text string"


def ingested(pages: DataFrame, levels=LEVELS, heading_words: list[str] = HEADING_WORDS) -> DataFrame:
    """pages (doc_id, filename, page, text[, scope]), distinct by document, page and scope -> chunks of three levels.

    A page is cut into blocks of one kind, a block into groups of paragraphs up to the first level's size, and a group into chunks level by
    level. Ids count a page's chunks of a level; chunk_idx counts the chunks of a document over its pages. Blank pages give none.
    """
    scope = F.col("scope") if "scope" in pages.columns else F.lit("").alias("scope")
    keyed = pages.select(F.struct("doc_id", "filename", F.col("page").cast("int").alias("page"), scope).alias("doc_id"), "text")
    groups = blocks(keyed, heading_words).select("doc_id.*", "block", "kind", "path", F.posexplode(paragraph_groups(F.col("text"), levels[0][0])).alias("g", "text"))
    small_batches(pages.sparkSession)
    rows = groups.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "filename", "scope", "block", "g")

    def cut(frames):
        import pandas as pd

        names = [c.split()[0] for c in CHUNK.split(", ")]
        page, count, n = None, [0, 0, 0], 0
        for f in frames:
            out = []

            def walk(part, level, parent, root, row):
                nonlocal n
                for piece in split_text(part, *levels[level]):
                    piece = piece.strip()
                    if not piece:
                        continue
                    id_ = f"{row.filename}::p{row.page}{'::' + row.scope if row.scope else ''}::l{level + 1}::{count[level]}"
                    out.append((row.doc_id, row.filename, row.page, id_, parent, root or id_, level + 1, n, row.path, row.kind, row.g, piece))
                    count[level] += 1
                    n += 1
                    if level + 1 < len(levels):
                        walk(piece, level + 1, id_, root or id_, row)

            for row in f.itertuples(index=False):
                if (row.doc_id, row.filename, row.page, row.scope) != page:
                    page, n = (row.doc_id, row.filename, row.page, row.scope), 0
                    count[:] = [0, 0, 0]
                walk(row.text, 0, "", "", row)
            yield pd.DataFrame(out, columns=names)

    chunks = rows.mapInPandas(cut, CHUNK)
    sizes = chunks.groupBy("doc_id", "page").agg((F.max("n") + 1).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one number for each page
    return chunks.join(sizes.select("doc_id", "page", before.alias("before")), ["doc_id", "page"]).withColumn("chunk_idx", F.col("n") + F.col("before")).drop("n", "before")


def merge_levels(hits: DataFrame, tree: DataFrame, threshold: int = 2, levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """hits (query_id, chunk_id, pos, score) -> (hits, summary) after merging upwards `levels` times.

    tree (chunk_id, parent_id) has all chunks that exist. `threshold` or more hits of a query with one parent that exists become the
    parent, at their first place with their greatest score; what came of a level merges again in the next one. `merged` is the number of hits
    that a hit was made of, 0 if it is an original one. The summary has for each query: chunks that were replaced, levels that merged any, and hits that are left.
    Hits are written once when this is called, and so are the chunks above them, which are looked up level by level.
    """
    hits = saved(hits.select("query_id", "chunk_id", "pos", "score"), "hits")
    up = _above(hits, tree.select(F.col("chunk_id").alias("_c"), F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id")), levels)
    now = hits.select("query_id", "chunk_id", "pos", "score", F.lit(0).cast("bigint").alias("merged")).join(up, F.col("chunk_id") == F.col("_c"), "left").drop("_c")
    steps = []
    for _ in range(levels):
        many = now.where("parent_id is not null").groupBy("query_id", F.col("parent_id").alias("p")).agg(F.count("*").alias("merged"), F.min("pos").alias("pos"), F.max("score").alias("score"))
        many = many.where(F.col("merged") >= threshold).join(up, F.col("p") == F.col("_c")).drop("_c")  # parents that exist
        steps.append(many.groupBy("query_id").agg(F.sum("merged").alias("n")))
        alone = now.join(many.select("query_id", F.col("p").alias("parent_id")), ["query_id", "parent_id"], "left_anti")
        now = alone.select("query_id", "chunk_id", "pos", "score", "merged", "parent_id").unionByName(many.select("query_id", F.col("p").alias("chunk_id"), "pos", "score", "merged", "parent_id"))
    out = now.drop("parent_id")
    done = None
    for s in steps:
        done = s if done is None else done.unionByName(s)
    done = done.groupBy("query_id").agg(F.sum("n").alias("replaced"), F.count("*").alias("steps"))
    left = out.groupBy("query_id").agg(F.count("*").alias("left")).join(done, "query_id", "left")
    return out, left.select("query_id", F.coalesce("replaced", F.lit(0)).alias("replaced"), F.coalesce("steps", F.lit(0)).alias("steps"), "left")


def _above(hits: DataFrame, up: DataFrame, levels: int) -> DataFrame:
    """Rows of up (_c, parent_id) for the hits and for `levels` levels above them."""
    asked, out = hits.select("chunk_id"), None
    for _ in range(levels + 1):
        some = saved(up.join(small(asked.where("chunk_id is not null").distinct()), F.col("_c") == F.col("chunk_id"), "left_semi"), "tree")
        asked, out = some.select(F.col("parent_id").alias("chunk_id")), some if out is None else out.unionByName(some)
    return out.distinct()


def production(recalled: DataFrame, tree: DataFrame, rerank: Column, k: int, least: float, threshold: int = 2) -> DataFrame:
    """Recall, merge, rerank, threshold: recalled (query_id, chunk_id, pos, score) merged upwards, ordered by `rerank` (a column of the merged hits; null: their own score), cut to k, and then those with a score below `least` go."""
    merged, _ = merge_levels(recalled, tree, threshold)
    scored = merged.withColumn("rerank_score", rerank)
    top = ranked(scored, k, F.desc(F.coalesce("rerank_score", "score", F.lit(0.0))), F.asc("pos"))
    return top.where(retrieval.meets_min_score(F.coalesce("rerank_score", "score"), least))


# queries


def _chunks(spark, d):
    """Leaves of 60 words, three of them in a chunk of the second level, and three of those in one of the first."""
    w = read(spark, d, "documents").select("doc_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    leaves = w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / 60).cast("int")), lambda i: F.slice("w", i * 60 + 1, 60))).alias("n", "words")).where("size(words) > 0")
    leaves = leaves.select((F.col("doc_id") * 1_000_000 + F.col("n")).alias("doc_id"), "words")
    # numbers of leaves, counted once: the tree follows from them
    sizes = saved(w.groupBy("doc_id").agg(F.max(F.ceil(F.size("w") / 60)).alias("leaves")).where("leaves > 0"), "sizes")
    id_ = lambda level, n: F.concat(F.lit(f"{level}-"), F.col("doc_id"), F.lit("-"), F.floor(n).cast("string"))
    numbered = lambda each: sizes.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("leaves") - 1) / each).cast("int"))).alias("n"))
    n = F.col("n")
    tree = numbered(1).select(id_("c", n).alias("chunk_id"), id_("b", n / 3).alias("parent_id")).union(numbered(3).select(id_("b", n), id_("a", n / 3)))
    # the parents of every fifth document's middle chunks are not there
    tree = tree.union(numbered(9).where("doc_id % 5 > 0").select(id_("a", n), F.lit("")))
    return leaves, tree


def _recalled(spark, d):
    leaves, tree = _chunks(spark, d)
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = bm25(leaves, q, 30)
    name = F.concat(F.lit("c-"), F.floor(F.col("doc_id") / 1_000_000), F.lit("-"), F.col("doc_id") % 1_000_000)
    return hits.select("query_id", name.alias("chunk_id"), F.col("rank").alias("pos"), "score"), tree


def wn3_levels(spark, d):
    hits, tree = _recalled(spark, d)
    return merge_levels(hits, tree)[0]


def wn3_level_summary(spark, d):
    hits, tree = _recalled(spark, d)
    return merge_levels(hits, tree)[1]


def rt7_levels(spark, d):
    """A rerank score for the merged hits of even places, below the scores of BM25."""
    hits, tree = _recalled(spark, d)
    rerank = F.when(F.col("pos") % 2 == 0, F.col("score") / (F.col("merged") + 2))
    return production(hits, tree, rerank, 8, 12.0).select("query_id", "chunk_id", "rank", "pos", "score", "rerank_score", "merged")


def ch5_ingest(spark, d):
    """Two pages a document, of a heading and two paragraphs."""
    p = read(spark, d, "part")
    text = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nPara "), F.col("p_brand"), F.lit("\n\n  Other "), F.col("p_type"), F.lit("\n"))
    pages = p.select(F.floor(F.col("p_partkey") / 2).cast("bigint").alias("doc_id"), F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 2), F.lit(".html")).alias("filename"), (F.col("p_partkey") % 2).cast("int").alias("page"), F.when(F.col("p_partkey") % 3 == 0, "s").otherwise("").alias("scope"), text.alias("text"))
    return ingested(pages, heading_words=["zzzz"])


QUERIES = {f.__name__: f for f in (wn3_levels, wn3_level_summary, rt7_levels, ch5_ingest)}
_LEVELS = f"""ch AS (SELECT doc_id, n, array_to_string(w[n * 60 + 1 : n * 60 + 60], ' ') AS text FROM (SELECT doc_id, {retrieval._W.format("coalesce(text, '')")} AS w FROM documents), unnest(range(0, len(w) // 60 + 1)) AS t(n)),
    lv AS (SELECT * FROM ch WHERE text <> ''), {retrieval.bm25_sql("s", "SELECT doc_id * 1000000 + n AS doc_id, text FROM lv", retrieval._Q, 30)},
    tree AS (SELECT 'c-' || doc_id || '-' || n AS id, 'b-' || doc_id || '-' || (n // 3) AS p FROM lv UNION SELECT 'b-' || doc_id || '-' || (n // 3), 'a-' || doc_id || '-' || (n // 9) FROM lv UNION SELECT 'a-' || doc_id || '-' || (n // 9), NULL FROM lv WHERE doc_id % 5 > 0),
    h0 AS (SELECT query_id, 'c-' || (doc_id // 1000000) || '-' || (doc_id % 1000000) AS chunk_id, rank AS pos, score, 0::BIGINT AS merged FROM s)"""
for _i in (0, 1):
    _LEVELS += f""", u{_i} AS (SELECT h.*, t.p FROM h{_i} h LEFT JOIN tree t ON t.id = h.chunk_id),
    m{_i} AS (SELECT query_id, p AS chunk_id, min(pos) AS pos, max(score) AS score, count(*) AS merged FROM u{_i} WHERE p IN (SELECT id FROM tree) GROUP BY ALL HAVING count(*) >= 2),
    h{_i + 1} AS (SELECT query_id, chunk_id, pos, score, merged FROM u{_i} WHERE NOT EXISTS (SELECT 1 FROM m{_i} m WHERE m.query_id = u{_i}.query_id AND m.chunk_id = u{_i}.p) UNION ALL SELECT * FROM m{_i})"""
SQL = {
    "wn3_levels": f"WITH {_LEVELS} SELECT * FROM h2",
    "wn3_level_summary": f"WITH {_LEVELS}, g AS (SELECT query_id, sum(merged) AS n FROM m0 GROUP BY 1 UNION ALL SELECT query_id, sum(merged) FROM m1 GROUP BY 1), z AS (SELECT query_id, sum(n)::BIGINT AS replaced, count(*) AS steps FROM g GROUP BY 1) SELECT query_id, coalesce(any_value(replaced), 0) AS replaced, coalesce(any_value(steps), 0) AS steps, count(*) AS left FROM h2 LEFT JOIN z USING (query_id) GROUP BY query_id",
    "rt7_levels": f"""WITH {_LEVELS}, r AS (SELECT *, CASE WHEN pos % 2 = 0 THEN score / (merged + 2) END AS rerank_score FROM h2),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank_score, score) DESC, pos) AS rank FROM r QUALIFY rank <= 8)
        SELECT query_id, chunk_id, rank, pos, score, rerank_score, merged FROM o WHERE coalesce(rerank_score, score) >= 12""",
    "ch5_ingest": """
        WITH p AS (SELECT p_partkey // 2 AS doc_id, 'f' || (p_partkey // 2) || '.html' AS filename, (p_partkey % 2)::INTEGER AS page, CASE WHEN p_partkey % 3 = 0 THEN '::s' ELSE '' END AS sc, p_name, ['# ' || p_name, 'Para ' || p_brand, 'Other ' || p_type] AS ts FROM part),
        c AS (SELECT *, filename || '::p' || page || sc AS base, min(page) OVER (PARTITION BY doc_id) AS first FROM p, unnest([0, 1, 2]) AS b(i), unnest([1, 2, 3]) AS l(v))
        SELECT doc_id, filename, page, base || '::l' || v || '::' || i AS chunk_id, CASE WHEN v > 1 THEN base || '::l' || (v - 1) || '::' || i ELSE '' END AS parent_chunk_id, base || '::l1::' || i AS root_chunk_id, v AS chunk_level,
            3 * i + v - 1 + CASE WHEN page > first THEN 9 ELSE 0 END AS chunk_idx, p_name AS section_path, CASE WHEN i = 0 THEN 'heading' ELSE 'paragraph' END AS chunk_kind, 0 AS paragraph_group_idx, ts[i + 1] AS text FROM c""",
}
