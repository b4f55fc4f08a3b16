"""Text normalization, redaction and extraction as column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read, small_batches
from ledgerloom.functions.text import collapsed, compact, let

# Zero-width, bidi and byte-order marks; control characters but tab, line feed and carriage return; private use.
INVISIBLE = "[\\u200b-\\u200d\\ufeff\\u200f\\u202a-\\u202e]"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
PRIVATE = "[\\ue000-\\uf8ff]"
# Patterns and labels of the redaction, in the order in which they apply.
REDACTIONS = [
    (r"(?<!\p{Nd})1[3-9]\p{Nd}{9}(?!\p{Nd})", "[手机号]"),
    (r"(?<!\p{Nd})\p{Nd}{17}[\p{Nd}Xx](?!\p{Nd})", "[身份证号]"),
    (r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}", "[邮箱]"),
]
EMAIL = REDACTIONS[2][0]


def unicode_form(c: Column, form: str) -> Column:
    """NFC or NFKC. ASCII texts are left alone: Python gets nulls for them."""
    small_batches(SparkSession.active())

    @F.pandas_udf("string")
    def normal(s):
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return F.coalesce(normal(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def sanitize(c: Column) -> Column:
    out = unicode_form(F.coalesce(c, F.lit("")), "NFC")
    for pattern in (INVISIBLE, CONTROL, PRIVATE):
        out = F.regexp_replace(out, pattern, "")
    return out


def canonical(c: Column, ignore: list[str] = ()) -> Column:
    """NFKC, without lines that match a pattern, collapsed."""
    out = unicode_form(F.coalesce(c, F.lit("")), "NFKC")
    if ignore:
        out = F.array_join(F.filter(F.split(out, "\n"), lambda s: ~F.exists(F.array(*[F.lit(p) for p in ignore]), lambda p: F.regexp_like(s, p))), "\n")
    return collapsed(out)


def normalization_version(ignore: list[str] = ()) -> Column:
    return F.concat(F.lit("nfkc_ws_v1"), F.concat(F.lit(":"), F.left(F.sha2(F.lit(";;".join(ignore)), 256), F.lit(12))) if ignore else F.lit(""))


def redact(c: Column) -> tuple[Column, Column]:
    """(text, count): each pattern is counted on what the patterns before it left."""
    text, count = F.coalesce(c, F.lit("")), F.lit(0)
    for pattern, label in REDACTIONS:
        count = count + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, label)
    return text, count


def mask_email(c: Column) -> Column:
    return F.concat(F.left(F.split_part(c, F.lit("@"), F.lit(1)), F.lit(2)), F.lit("***@"), F.split_part(c, F.lit("@"), F.lit(2)))


def rewrite_query(c: Column) -> Column:
    """Without numbering and option labels, and prefixed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b[a-e][.)]\s*", " ")
    out = F.regexp_replace(out, r"^\s*[0-9]+[.)]\s*", "")
    return F.concat(F.lit("Medical question: "), F.trim(F.regexp_replace(out, r"\s+", " ")))


def decompose(c: Column, most: int = 4) -> Column:
    """Stem and options of a question, each once whatever its case; without options the clauses of more than 8 characters, else the question itself; at most `most`."""
    once = lambda parts: F.filter(parts, lambda s, i: (s != "") & (F.array_position(F.transform(parts, lambda x: F.lower(x)), F.lower(s)) == i + 1))

    def of(text):
        stem = F.trim(F.get(F.split(text, r"(?iU)\b[a-e][.)]\s+", 2), F.lit(0)))
        options = F.regexp_extract_all(text, F.lit(r"(?iU)\b[a-e][.)]\s*(.+?)(?=\s+[a-e][.)]\s*|$)"), F.lit(1))
        clauses = F.filter(F.transform(F.split(text, r"(?iU),|;|\band\b|\bor\b"), lambda s: F.trim(s)), lambda s: F.length(s) > 8)
        return let(let(F.concat(F.array(stem), F.transform(options, lambda s: F.trim(s))), once), lambda u: F.slice(F.when(F.size(u) < 2, clauses).otherwise(u), 1, most))

    return let(let(collapsed(F.coalesce(c, F.lit(""))), of), lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(F.coalesce(c, F.lit("")))))


def choice(prediction: Column) -> Column:
    """Letter of a multiple-choice answer: a JSON field, else `answer is X`, else a letter in parentheses, else one at the start; else yes, no or maybe as A, B, C."""
    first = lambda p: F.nullif(F.upper(F.regexp_extract(prediction, p, 1)), F.lit(""))
    word = F.lower(F.regexp_extract(prediction, r"(?i)\b(yes|no|maybe)\b", 1))
    return F.coalesce(
        F.nullif(F.upper(F.get_json_object(F.regexp_extract(prediction, r"(?s)\{.*\}", 0), "$.answer")), F.lit("")),
        first(r"(?i)answer(?: is|:)\s*\(?([A-E])\b"),
        first(r"(?i)\(([A-E])\)"),
        first(r"(?i)^\s*([A-E])[.):]"),
        F.when(word == "yes", "A").when(word == "no", "B").when(word == "maybe", "C"),
    )


def _items(json: Column) -> Column:
    """array<variant>: the items of a JSON list; null where the whole text isn't one."""
    # the parser stops after the first value, so the text is checked as the only item of a list around it
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), json, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(whole) == 1, F.try_variant_get(F.get(whole, F.lit(0)), "$", "array<variant>"))


def json_in(c: Column) -> Column:
    """The outermost object of an answer with fences or words around it; null where that isn't JSON."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when((found != "") & (F.size(_items(F.concat(F.lit("["), found, F.lit("]")))) == 1), found)


def json_array_in(c: Column) -> Column:
    """array<string>: the objects in the outermost list of an answer, as JSON; null where there is no list."""
    items = _items(F.regexp_extract(c, r"(?s)\[.*\]", 0))
    return F.transform(F.filter(items, lambda v: F.schema_of_variant(v).startswith("OBJECT")), lambda v: F.to_json(v))


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "text")


def tx1_sanitize(spark, d):
    # characters that go, private ones, a letter to compose, and one that stays
    extra = F.get(F.array(*[F.lit(x) for x in ("\u200b\x07\u202e", "\ue123\ufeff\x7f", "e\u0301", "\u2060")]), (F.col("doc_id") % 4).cast("int"))
    return _docs(spark, d).select("doc_id", F.sha2(sanitize(F.concat(extra, F.coalesce("text", F.lit("")))), 256).alias("clean_sha"))


def tx3_canonical(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(canonical(F.col("text"), ["^Licensed"]), 256).alias("fingerprint"), normalization_version(["^Licensed"]).alias("version"))


def tx10_compact(spark, d):
    return _docs(spark, d).select("doc_id", compact(F.col("text")).alias("preview"))


def tx11_redact(spark, d):
    numbers = F.when(F.col("doc_id") % 3 == 0, "call 13812345678, id 11010119900307123x, no 138123456789; ").otherwise("")
    text, count = redact(F.concat(numbers, F.coalesce("text", F.lit(""))))
    return _docs(spark, d).select("doc_id", F.sha2(text, 256).alias("sha"), count.cast("bigint").alias("redactions"))


def tx12_mask_email(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_extract("text", EMAIL, 0).alias("email")).where("email <> ''").select("doc_id", mask_email(F.col("email")).alias("masked"))


def tx15_rewrite(spark, d):
    return read(spark, d, "benchmark").select("item_id", rewrite_query(F.concat(F.lit("3. A) "), F.col("text"))).alias("query"))


def tx16_decompose(spark, d):
    asked = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Which  is it a. "), "role", F.lit(" B) Other one C. "), F.upper("role"), F.lit(" d) none"))).otherwise(F.translate("text", ".)", ";;"))  # stops would be options
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(decompose(asked), "|").alias("parts"))


def tx17_choice(spark, d):
    e = read(spark, d, "events")
    letter = F.chr(F.lit(65) + F.col("event_id") % 5)
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("The answer is "), letter, F.lit("."))).when(F.col("event_type") == "view", F.concat(F.lit('x {"answer": "'), F.lower(letter), F.lit('"} y')))
    said = said.when(F.col("event_type") == "error", F.lit("Maybe so")).when(F.col("event_type") == "signup", F.concat(F.lit("see ("), letter, F.lit(")"))).otherwise(F.concat(letter, F.lit(") because")))
    return e.select("event_id", choice(said).alias("choice"))


def tx18_json(spark, d):
    kind, id_ = F.col("event_type"), F.col("event_id").cast("string")
    said = F.when(kind == "click", F.concat(F.lit('so ```json\n{"answer": '), id_, F.lit("}\n``` ends"))).when(kind == "view", F.concat(F.lit('```\n[{"a":'), id_, F.lit('},3,{"b":[1]}]\n```')))
    said = said.when(kind == "error", F.lit('[1, {"a": }]')).otherwise(F.lit("none {"))
    return read(spark, d, "events").select("event_id", json_in(said).alias("object"), F.array_join(json_array_in(said), "|").alias("items"))


QUERIES = {f.__name__: f for f in (tx1_sanitize, tx3_canonical, tx10_compact, tx11_redact, tx12_mask_email, tx15_rewrite, tx16_decompose, tx17_choice, tx18_json)}
_EMAIL_SQL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
SQL = {
    "tx1_sanitize": "SELECT doc_id, sha256(CASE doc_id % 4 WHEN 2 THEN chr(233) WHEN 3 THEN chr(8288) ELSE '' END || nfc_normalize(coalesce(text, ''))) AS clean_sha FROM documents",
    "tx3_canonical": r"SELECT doc_id, sha256(trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT starts_with(s, 'Licensed')), chr(10)), '\s+', ' ', 'g'))) AS fingerprint, 'nfkc_ws_v1:' || left(sha256('^Licensed'), 12) AS version FROM documents",
    "tx10_compact": r"WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, left(t, 90) || CASE WHEN length(t) > 90 THEN '...' ELSE '' END AS preview FROM f",
    "tx11_redact": f"SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'call [手机号], id [身份证号], no 138123456789; ' ELSE '' END || regexp_replace(coalesce(text, ''), '{_EMAIL_SQL}', '[邮箱]', 'g')) AS sha, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL_SQL}')) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS redactions FROM documents",
    "tx12_mask_email": f"WITH e AS (SELECT doc_id, regexp_extract(text, '{_EMAIL_SQL}') AS email FROM documents) SELECT doc_id, left(split_part(email, '@', 1), 2) || '***@' || split_part(email, '@', 2) AS masked FROM e WHERE email <> ''",
    "tx15_rewrite": r"SELECT item_id, 'Medical question: ' || trim(regexp_replace(regexp_replace(regexp_replace('3. A) ' || text, '(?i)\b[a-e][.)]\s*', ' ', 'g'), '^\s*[0-9]+[.)]\s*', ''), '\s+', ' ', 'g')) AS query FROM benchmark",
    "tx16_decompose": r"WITH p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(translate(coalesce(text, ''), '.)', ';;'), '\s+', ' ', 'g')), '(?i),|;|\band\b|\bor\b'), lambda s: trim(s)), lambda s: length(s) > 8) AS p FROM conversations) SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'Which is it|' || role || '|Other one|none' WHEN len(p) = 0 THEN translate(coalesce(text, ''), '.)', ';;') ELSE array_to_string(p[1:4], '|') END AS parts FROM p",
    "tx17_choice": "SELECT event_id, CASE WHEN event_type = 'error' THEN 'C' ELSE chr((65 + event_id % 5)::INT) END AS choice FROM events",
    "tx18_json": """SELECT event_id, CASE WHEN event_type = 'click' THEN '{"answer": ' || event_id || '}' END AS object, CASE WHEN event_type = 'view' THEN '{"a":' || event_id || '}|{"b":[1]}' END AS items FROM events""",
}
