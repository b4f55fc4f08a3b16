"""Paragraph packing, leaf chunks, table rows out of recognised cells, and arguments made safe for a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normalize import REDACTIONS, sanitize
from ledgerloom.functions.tables import read
from ledgerloom.functions.text import let
from ledgerloom.operators.chunking import three_levels

#: Argument names whose values are never logged.
SECRET_KEYS = ["api_key", "token", "password", "latitude", "longitude", "lat", "lng"]


def paragraph_groups(text: Column, size: int = 2400) -> Column:
    """array<string>: lines that aren't blank, trimmed, packed in order while their lengths sum up to at most `size`; a longer line stands alone."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    none = F.array().cast("array<string>")
    state = F.struct(none.alias("done"), none.alias("now"), F.lit(0).alias("n"))
    close = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], "\n")))).otherwise(a["done"])

    def step(a, s):
        full = (F.size(a["now"]) > 0) & (a["n"] + F.length(s) > size)
        return F.when(full, F.struct(close(a).alias("done"), F.array(s).alias("now"), F.length(s).alias("n"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(s)).alias("now"), (a["n"] + F.length(s)).alias("n")))

    return F.aggregate(lines, state, step, close)


def leaf_chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, filename, page, text): chunks of the lowest level alone."""
    return three_levels(docs).where("chunk_level = 3")


def table_text(cells: Column) -> Column:
    """Text of a table from cells array<struct<y double, x double, h double, text string>>: rows from the top, cells from the left, joined by bars.

    Cells are taken by their centre from the top; one joins the row before if its centre is within 0.65 of the greater height of the row's mean centre.
    """
    cell = "struct<y:double,x:double,h:double,text:string>"
    none = F.array().cast(f"array<{cell}>")
    state = F.struct(F.array().cast("array<string>").alias("rows"), none.alias("now"))
    written = lambda now: F.array_join(F.transform(F.array_sort(F.transform(now, lambda c, i: F.struct(c["x"].alias("x"), i.alias("i"), c["text"].alias("text")))), lambda c: c["text"]), " | ")
    close = lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["rows"], F.array(written(a["now"])))).otherwise(a["rows"])
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, c: s + c[f])

    def step(a, c):
        tallest = F.greatest(c["h"], F.array_max(F.transform(a["now"], lambda x: x["h"])))
        same = (F.size(a["now"]) > 0) & (F.abs(c["y"] - F.try_divide(total(a["now"], "y"), F.size(a["now"]))) <= tallest * 0.65)
        return F.when(F.coalesce(same, F.lit(False)), F.struct(a["rows"].alias("rows"), F.concat(a["now"], F.array(c)).alias("now"))).otherwise(F.struct(close(a).alias("rows"), F.array(c).alias("now")))

    kept = F.filter(F.transform(cells, lambda c: F.struct(c["y"].alias("y"), c["x"].alias("x"), F.greatest(c["h"], F.lit(1.0)).alias("h"), F.trim(c["text"]).alias("text"))), lambda c: F.coalesce(c["text"], F.lit("")) != "")
    return F.array_join(F.aggregate(F.array_sort(kept), state, step, close), "\n")


def clean_values(values: Column) -> Column:
    """A map of strings with every value sanitized; keys stay."""
    return F.transform_values(values, lambda k, v: F.when(v.isNotNull(), sanitize_light(v)))


def sanitize_light(c: Column) -> Column:
    """The sanitizer without Unicode composition, for values inside maps and arrays: invisible, control and private-use characters go."""
    from ledgerloom.functions.normalize import CONTROL, INVISIBLE, PRIVATE

    out = c
    for pattern in (INVISIBLE, CONTROL, PRIVATE):
        out = F.regexp_replace(out, pattern, "")
    return out


def audited(arguments: Column, most: int = 500) -> Column:
    """struct<arguments map, sha256>: secret values hidden, others redacted and cut at `most` characters; the digest is over the entries by key."""

    def safe(k, v):
        text = v
        for pattern, label in REDACTIONS:
            text = F.regexp_replace(text, pattern, label)
        return F.when(F.lower(k).isin(*SECRET_KEYS), F.lit("[REDACTED]")).otherwise(F.left(text, F.lit(most)))

    done = F.transform_values(arguments, safe)
    return let(done, lambda m: F.struct(m.alias("arguments"), F.sha2(F.to_json(F.array_sort(F.map_entries(m))), 256).alias("sha256")))


def like_term(c: Column) -> Column:
    """A term without the characters that are special to LIKE, trimmed first."""
    return F.translate(F.trim(F.coalesce(c, F.lit(""))), '\\"%_', "")


def ch4_paragraphs(spark, d):
    g = read(spark, d, "documents").select("doc_id", F.posexplode(paragraph_groups(F.col("text"), 300)).alias("i", "g"))
    return g.select("doc_id", F.col("i").cast("bigint").alias("i"), F.sha2("g", 256).alias("sha"))


def ch8_leaves(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id")).alias("filename"), F.lit(0).alias("page"), "text")
    return leaf_chunks(docs).groupBy("doc_id").agg(F.count("*").alias("leaves"), F.max(F.length("text")).alias("longest"))


def ch9_tables(spark, d):
    """Cells made of a conversation's turns: three in a row, 20 apart, with a little noise, out of order."""
    t, n = F.col("turn").cast("int"), F.length(F.coalesce("text", F.lit("")))
    row = F.floor(t / 3)
    cell = F.struct((row * 20.0 + n % 3).alias("y"), ((7 - t) % 3 * 10.0).alias("x"), F.lit(10.0).alias("h"), F.concat(F.col("role"), F.lit("-"), t).alias("text"))
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(cell).alias("cells"))
    return c.select("conv_id", table_text(F.col("cells")).alias("table"))


def tx2_clean_values(spark, d):
    n = F.col("event_id")
    e = read(spark, d, "events").select("event_id", F.create_map(F.lit("a"), F.concat(F.lit("x​"), F.col("event_type"), F.lit("\x07")), F.lit("b"), F.when(n % 2 == 0, F.lit("ok﻿"))).alias("m"))
    m = clean_values(F.col("m"))
    return e.select("event_id", F.try_element_at(m, F.lit("a")).alias("a"), F.try_element_at(m, F.lit("b")).alias("b"))


def tx13_audited(spark, d):
    n = F.col("doc_id")
    m = F.create_map(F.lit("text"), F.coalesce("text", F.lit("")), F.lit("Token"), n.cast("string"), F.lit("phone"), F.concat(F.lit("call 138"), F.lpad(n.cast("string"), 8, "0")))
    a = read(spark, d, "documents").select("doc_id", audited(m).alias("a"))
    at = lambda k: F.try_element_at("a.arguments", F.lit(k))
    return a.select("doc_id", F.sha2(at("text"), 256).alias("text"), at("Token").alias("token"), at("phone").alias("phone"))


def tx14_like_terms(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", like_term(F.concat(F.lit(" %"), F.col("p_name"), F.lit('_"\\x'))).alias("term"))


QUERIES = {f.__name__: f for f in (ch4_paragraphs, ch8_leaves, ch9_tables, tx2_clean_values, tx13_audited, tx14_like_terms)}
SQL = {
    "ch9_tables": """
        WITH c AS (SELECT conv_id, turn::INT AS t, turn::INT // 3 AS r, ((7 - turn::INT) % 3 * 10)::DOUBLE AS x, (turn::INT // 3) * 20 + length(coalesce(text, '')) % 3 AS y, role || '-' || turn AS s FROM conversations),
        g AS (SELECT conv_id, r, string_agg(s, ' | ' ORDER BY x, y, s) AS line FROM c GROUP BY ALL) SELECT conv_id, string_agg(line, chr(10) ORDER BY r) AS "table" FROM g GROUP BY conv_id""",
    "tx2_clean_values": "SELECT event_id, 'x' || event_type AS a, CASE WHEN event_id % 2 = 0 THEN 'ok' END AS b FROM events",
    "tx13_audited": r"SELECT doc_id, sha256(left(regexp_replace(coalesce(text, ''), '[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}', '[邮箱]', 'g'), 500)) AS text, '[REDACTED]' AS token, 'call [手机号]' AS phone FROM documents",
    "tx14_like_terms": "SELECT p_partkey, p_name || 'x' AS term FROM part",
}
