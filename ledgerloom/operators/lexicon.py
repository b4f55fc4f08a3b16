"""Texts against lexicons of any size: one pass over each text with an automaton, instead of one search for each term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small_batches
from ledgerloom.functions.text import words

#: Bytes of terms in one automaton; larger lexicons are searched for in several passes.
MAX_BYTES = 16_000_000


def matches(rows: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, term_col: str = "term") -> DataFrame:
    """(id, term, n): the terms of `lexicon` that stand in each text, anywhere, and how often (overlaps count). Equal to `contains` for each term.

    The distinct terms of a block go to all tasks, with MAX_BYTES as the bound of a block, and a task builds the automaton once. Null and empty terms match
    nothing; null texts have no matches. Rows that share an id count together.
    """
    terms = lexicon.select(F.col(term_col).alias("term")).where("term <> ''").distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    blocks = -(-size // MAX_BYTES)
    out = None
    for i in range(blocks):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i) if blocks > 1 else terms
        found = _block(rows, id_col, text_col, sorted(r[0] for r in some.collect()))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select(F.col(id_col), F.lit("").alias("term"), F.lit(0).cast("bigint").alias("n")).where("1 = 0")
    return out.groupBy(id_col, "term").agg(F.sum("n").alias("n"))


def _block(rows: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(terms)
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = dict(src.dtypes)["id"]

    def run(batches):
        from collections import Counter

        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(sent.value):
            automaton.add_word(t, i)
        automaton.make_automaton()
        for b in batches:
            at, code, n = [], [], []
            for row, text in enumerate(b.column(1)):
                for c, k in Counter(i for _, i in automaton.iter(text.as_py())).items():
                    at.append(row)
                    code.append(c)
                    n.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([sent.value[c] for c in code], pa.string()), pa.array(n, pa.int64())], names=["id", "term", "n"])

    return src.mapInArrow(run, f"id {kind}, term string, n long").withColumnRenamed("id", id_col)


def fl2_lexicon(spark, d):
    """All words of the benchmark passages in all documents."""
    lexicon = read(spark, d, "benchmark").select(F.explode(words(F.col("text"))).alias("term")).where("length(term) > 4")
    found = matches(read(spark, d, "documents"), "doc_id", "text", lexicon)
    return found.groupBy("doc_id").agg(F.count("*").alias("terms"), F.min("term").alias("first"), F.max("term").alias("last"))


QUERIES = {"fl2_lexicon": fl2_lexicon}
SQL = {
    "fl2_lexicon": r"""
        WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) WHERE length(term) > 4)
        SELECT doc_id, count(*) AS terms, min(term) AS first, max(term) AS last FROM documents JOIN t ON contains(text, term) GROUP BY doc_id"""
}
