"""Evidence after retrieval: compression, conflicts, packing, history windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.functions.text import any_of, collapsed, let
from ledgerloom.operators import retrieval

# The polarity of a text is decided by these substrings.
NEGATIVE = ["不推荐", "不建议", "不能", "不宜", "禁忌", "避免", "慎用", "无效", "无证据", "增加风险", "升高风险", "not recommended", "contraindicated", "avoid", "ineffective"]
POSITIVE = ["推荐", "建议", "可以", "可用于", "适合", "应当", "有效", "降低风险", "改善", "recommended", "effective", "benefit"]
#: Characters that end a sentence; a full stop is not one of them.
SENTENCE_END = "。！？!?；;"


def compress(text: Column, query: Column, most: int = 900, sentences: int = 4, ends: str = SENTENCE_END) -> Column:
    """Collapsed text if it is short; else its sentences with the most query terms, ties to the earlier, in that order, cut at `most` characters."""
    raw = collapsed(F.coalesce(text, F.lit("")))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[一-鿿A-Za-z0-9]{2,}"), F.lit(0)), lambda t: F.lower(t)))
    parts = F.filter(F.transform(F.split(raw, rf"(?<=[{ends}])\s*"), lambda s: F.trim(s)), lambda s: s != "")
    scored = let(terms, lambda ts: F.transform(parts, lambda s, i: let(F.lower(s), lambda low: F.struct((-F.size(F.filter(ts, lambda t: F.contains(low, t)))).alias("score"), i.alias("i"), s.alias("s")))))
    best = F.array_join(F.transform(F.slice(F.array_sort(scored), 1, sentences), lambda x: x["s"]), " ")
    cut = F.when(F.length(best) > most, F.concat(F.rtrim(F.left(best, F.lit(most))), F.lit("..."))).otherwise(best)
    return F.when(F.length(raw) <= most, raw).otherwise(cut)


def polarity(text: Column, negative=NEGATIVE, positive=POSITIVE) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    no, yes = any_of(low, negative), any_of(low, positive)
    return F.when(no & yes, "mixed").when(no, "negative").when(yes, "positive").otherwise("neutral")


def conflicts(hits: DataFrame, most: int = 5, negative=NEGATIVE, positive=POSITIVE) -> DataFrame:
    """hits (query_id, topic, text, rank): topics with evidence on both sides, the first `most` of a query."""
    p = hits.withColumn("side", polarity(F.col("text"), negative, positive))
    groups = p.groupBy("query_id", "topic").agg(F.count_if(F.col("side").isin("positive", "mixed")).alias("n_for"), F.count_if(F.col("side").isin("negative", "mixed")).alias("n_against"), F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first", "topic")
    return groups.where("n_for > 0 and n_against > 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("first")


def packed(hits: DataFrame) -> DataFrame:
    """hits (query_id, source, rank, text): one context text for each query, sources in order of their best rank, marked as untrusted data."""
    by_source = hits.groupBy("query_id", "source").agg(F.min("rank").alias("first"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("parts"))
    piece = F.concat(F.lit("[source: "), F.col("source"), F.lit("]\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    out = by_source.select("query_id", F.struct("first", "source", piece.alias("t")).alias("s")).groupBy("query_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return out.select("query_id", F.concat(F.lit("<untrusted>\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), F.lit("\n</untrusted>")).alias("context"))


def groundedness(answer: Column, evidence: Column) -> Column:
    """Share of the answer's distinct tokens that the evidence has; tokens are case-sensitive runs of two or more."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[一-鿿A-Za-z0-9]{2,}"), F.lit(0)))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(tokens(answer), tokens(evidence))), F.size(tokens(answer))), F.lit(0.0)), 4)


def history(messages: DataFrame, most: int = 6) -> DataFrame:
    """The last `most` turns of each conversation."""
    return messages.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("back") <= most)


def topic_filter(text: Column, terms: list[str]) -> Column:
    """Any of the terms, without characters that are special to LIKE."""
    clean = [t for t in ("".join(c for c in x if c not in '%_"\\') for x in terms) if t]
    return any_of(text, clean)


def _hits(spark, d, k):
    docs = read(spark, d, "documents").select("doc_id", "source", F.col("text").alias("body"))
    return retrieval._bm25(spark, d, k).join(docs, "doc_id")


def rt14_compress(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _hits(spark, d, 3).join(q, "query_id").select("query_id", "doc_id", F.sha2(compress(F.col("body"), F.col("query"), ends="."), 256).alias("sha"))


def nd7_conflicts(spark, d):
    return conflicts(_hits(spark, d, 10).select("query_id", F.col("source").alias("topic"), F.col("body").alias("text"), "rank"), negative=["there", "zu "], positive=["tion", "und "])


def tx19_pack(spark, d):
    return packed(_hits(spark, d, 5).select("query_id", "source", "rank", F.col("body").alias("text"))).select("query_id", F.sha2("context", 256).alias("sha"))


def ev4_groundedness(spark, d):
    q = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _hits(spark, d, 3).join(q, "query_id").select("query_id", "doc_id", groundedness(F.col("query"), F.col("body")).alias("groundedness"))


def wn7_history(spark, d):
    return history(read(spark, d, "conversations")).groupBy("conv_id").agg(F.count("*").alias("kept"), F.min("turn").alias("first_turn"))


def j5_sessions(spark, d):
    m = read(spark, d, "conversations")
    sessions = m.select("conv_id").distinct().unionByName(spark.range(-2, 0).select(F.col("id").alias("conv_id")))
    return sessions.join(m.groupBy("conv_id").agg(F.count("*").alias("messages")), "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"))


def fl2_topic(spark, d):
    return read(spark, d, "documents").where(topic_filter(F.col("text"), ["an%a", "zu_", "%"])).select("doc_id")


QUERIES = {f.__name__: f for f in (rt14_compress, nd7_conflicts, tx19_pack, ev4_groundedness, wn7_history, j5_sessions, fl2_topic)}
_HITS = "WITH " + retrieval.bm25_sql("a", retrieval._D, retrieval._Q, 10)
_T = "list_distinct(regexp_extract_all({}, '[一-鿿A-Za-z0-9]{{2,}}'))"
SQL = {
    "rt14_compress": rf"""{_HITS},
        h AS (SELECT query_id, doc_id, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS raw, {_T.format("lower(b.text)")} AS terms FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 3),
        s AS (SELECT query_id, doc_id, i, trim(p[i]) AS s, len(list_filter(terms, lambda t: contains(lower(trim(p[i])), t))) AS n FROM (SELECT *, string_split(replace(raw, '.', '.' || chr(1)), chr(1)) AS p FROM h), unnest(range(1, len(p) + 1)) AS t(i) WHERE trim(p[i]) <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY n DESC, i) AS r FROM s QUALIFY r <= 4),
        b AS (SELECT query_id, doc_id, string_agg(s, ' ' ORDER BY r) AS best FROM r GROUP BY ALL)
        SELECT query_id, doc_id, sha256(CASE WHEN length(raw) <= 900 THEN raw WHEN length(best) > 900 THEN rtrim(left(best, 900)) || '...' ELSE best END) AS sha FROM h JOIN b USING (query_id, doc_id)""",
    "nd7_conflicts": f"""{_HITS},
        p AS (SELECT query_id, source AS topic, rank, contains(lower(text), 'there') OR contains(lower(text), 'zu ') AS no, contains(lower(text), 'tion') OR contains(lower(text), 'und ') AS yes FROM a JOIN documents USING (doc_id)),
        g AS (SELECT query_id, topic, count(*) FILTER (yes) AS n_for, count(*) FILTER (no) AS n_against, min(rank) AS first FROM p GROUP BY ALL HAVING count(*) FILTER (yes) > 0 AND count(*) FILTER (no) > 0)
        SELECT query_id, topic, n_for, n_against, row_number() OVER (PARTITION BY query_id ORDER BY first, topic) AS place FROM g QUALIFY place <= 5""",
    "tx19_pack": f"""{_HITS},
        s AS (SELECT query_id, d.source AS source, min(rank) AS first, '[source: ' || d.source || ']' || chr(10) || string_agg(text, chr(10) ORDER BY rank) AS t FROM a JOIN documents d USING (doc_id) WHERE rank <= 5 GROUP BY query_id, d.source)
        SELECT query_id, sha256('<untrusted>' || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY first, source) || chr(10) || '</untrusted>') AS sha FROM s GROUP BY s.query_id""",
    "ev4_groundedness": f"""{_HITS}, t AS (SELECT query_id, doc_id, {_T.format("b.text")} AS x, {_T.format("d.text")} AS y FROM a JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank <= 3)
        SELECT query_id, doc_id, round(coalesce(len(list_intersect(x, y)) / nullif(len(x), 0), 0), 4) AS groundedness FROM t""",
    "wn7_history": "SELECT conv_id, count(*) AS kept, min(turn) AS first_turn FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id",
    "j5_sessions": "SELECT s.conv_id, count(c.conv_id) AS messages FROM (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT * FROM (VALUES (-2), (-1))) s LEFT JOIN conversations c USING (conv_id) GROUP BY 1",
    "fl2_topic": "SELECT doc_id FROM documents WHERE contains(text, 'ana') OR contains(text, 'zu')",
}
