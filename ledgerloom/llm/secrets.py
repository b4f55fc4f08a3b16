"""Secret scanning with DataFrame functions only: base patterns, and sliding-window entropy over candidate strings.

Spans come from one pass of a pattern over a text: `split` gives the pieces between
matches and `regexp_extract_all` the matches, so the start of a match is the sum of
the lengths of all before it. Offsets count code points; ends are exclusive.

Entropy: candidates are runs of at least WINDOW characters of the base64 and url
alphabets, without what base spans cover. A window moves over each one with the counts of its characters as state: the
entering and the leaving character change only their own counts, so sum(c * log2(c)) is kept up to date in two steps, and
the entropy is log2(w) minus that sum over w. The threshold depends on the character class
of the candidate. The span reaches from the first window over the threshold to the end
of the last one. Candidates on the allow-list are left out.

Everything is one projection: no shuffle, whatever the keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, let

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of at least 16; shorter ones of `[0-9a-f]+` would be dropped anyway and can't overlap these.
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character from which a window counts, by class of the candidate: only digits, hexadecimal, none of the digits, and anything else.
LIMITS = {"digits": 2.9, "hex": 3.0, "letters": 3.8, "mixed": 3.6}
#: Candidates without digits are words, unless a small letter stands before a capital at least once in so many characters.
CHANGE, CASE = 7, r"(?<=[a-z])(?=[A-Z])"
#: Candidates that are no secrets: UUIDs, one character or pair of characters repeated, date and number lists, paths. Repeated groups are
#: possessive: Java's others recurse, and a long candidate would overflow the stack.
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.{1,2})\1+.?$",
    r"^[0-9]{1,4}(?:[/_=-][0-9]{1,4})++$",
    r"^/?(?:[A-Za-z]++/)++[A-Za-z]*+[0-9]{0,4}$",
]
BLOCK = 256
KINDS = ["assign", "access", "hex", "entropy"]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def _prefix_sums(lengths: Column) -> Column:
    """Sum of all before each element, by blocks, so that a text with very many matches costs n * BLOCK steps and not n * n."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    return let(
        blocks,
        lambda sums: F.transform(
            lengths,
            lambda _, i: _total(F.slice(sums, F.lit(1), F.floor(i / BLOCK).cast("int"))) + _total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
        ),
    )


def matches(text: Column, pattern: str) -> Column:
    """array<struct<at bigint, hit string>>: leftmost non-overlapping matches with their start in code points."""
    before = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(hits, before, lambda h, n: F.struct(h.alias("hit"), n.alias("gap")))  # the last gap has no match
    none = F.array().cast("array<struct<at:bigint,hit:string>>")
    found = let(
        F.filter(pairs, lambda p: p["hit"].isNotNull()),
        lambda ps: let(
            F.transform(ps, lambda p: p["gap"] + F.length(p["hit"])),
            lambda lengths: F.zip_with(ps, _prefix_sums(lengths), lambda p, s: F.struct((s + p["gap"]).alias("at"), p["hit"].alias("hit"))),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["at"].alias("start"), F.lit(kind).alias("kind"), (m["at"] + F.length(m["hit"])).alias("end")))


def _hot(s: Column) -> Column:
    """(first, last): starts of the first and last window of `s` whose entropy reaches the limit of its class, or nulls."""
    limit = F.when(s.rlike("^[0-9]+$"), F.lit(LIMITS["digits"])).when(s.rlike("^[0-9a-fA-F]+$"), F.lit(LIMITS["hex"])).when(~s.rlike("[0-9]"), F.lit(LIMITS["letters"])).otherwise(F.lit(LIMITS["mixed"]))
    return let(limit, lambda least: let(F.transform(F.split(s, ""), lambda c: F.ascii(c)), lambda codes: _scan(codes, least)))  # bound once: it reads the whole candidate


#: The counts of a window are a string with a character for each code from that of "+" to that of "z": ZERO, and the next ones for higher counts.
FIRST, LAST, ZERO = ord("+"), ord("z"), ord("A")


def _scan(codes: Column, limit: Column) -> Column:
    """One fold over the characters. The state holds the counts of the window's characters and sum(c * log2(c)) of them."""
    part = lambda k: k * F.log2(F.greatest(k, F.lit(1)))
    none = F.lit(chr(ZERO) * (LAST - FIRST + 1))
    state = F.struct(none.alias("counts"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    count = lambda counts, c: F.ascii(F.substring(counts, c - (FIRST - 1), F.lit(1))) - ZERO
    put = lambda counts, c, n: F.overlay(counts, F.char(n + ZERO), c - (FIRST - 1), 1)

    def step(acc, i):
        enters, leaves = F.get(codes, i), F.when(i >= WINDOW, F.get(codes, F.greatest(i - WINDOW, F.lit(0))))
        without = F.when(leaves.isNull(), F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))).otherwise(
            let(count(acc["counts"], leaves), lambda n: F.struct(put(acc["counts"], leaves, n - 1).alias("counts"), (acc["sum"] - part(n) + part(n - 1)).alias("sum")))
        )
        window = let(without, lambda w: let(count(w["counts"], enters), lambda n: F.struct(put(w["counts"], enters, n + 1).alias("counts"), (w["sum"] - part(n) + part(n + 1)).alias("sum"))))
        at = i - WINDOW + 1
        hot = lambda total: (at >= 0) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit - 1e-9)
        return let(
            window,
            lambda w: F.struct(w["counts"].alias("counts"), w["sum"].alias("sum"), F.coalesce(acc["first"], F.when(hot(w["sum"]), at)).alias("first"), F.when(hot(w["sum"]), at).otherwise(acc["last"]).alias("last")),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), state, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _left_by(base: Column, at: Column, hit: Column) -> Column:
    """array<struct<at, hit>>: what the base spans leave of a candidate, in pieces of at least WINDOW characters."""
    piece = lambda a, z: F.struct(a.alias("at"), F.substring(hit, (a - at + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")).alias("hit"))
    end = at + F.length(hit)
    touching = F.filter(base, lambda b: (b["start"] < end) & (at < b["end"]))
    state = F.struct(at.alias("at"), F.array().cast("array<struct<at:bigint,hit:string>>").alias("out"))
    cut = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], F.array(piece(acc["at"], b["start"]))).alias("out"))
    pieces = F.aggregate(touching, state, cut, lambda acc: F.concat(acc["out"], F.array(piece(acc["at"], end))))
    return F.filter(pieces, lambda p: F.length(p["hit"]) >= WINDOW)


def _entropy_spans(text: Column, base: Column) -> Column:
    found = matches(text, CANDIDATE)
    words = lambda s: ~s.rlike("[0-9]") & ((F.size(F.split(s, CASE)) - 1) * CHANGE < F.length(s))
    allowed = lambda s: reduce(lambda a, b: a | b, [words(s), *[s.rlike(p) for p in ALLOW]])
    free = F.filter(F.flatten(F.transform(found, lambda m: _left_by(base, m["at"], m["hit"]))), lambda m: ~allowed(m["hit"]))
    hot = F.transform(free, lambda m: F.struct(m["at"].alias("at"), _hot(m["hit"]).alias("w")))
    return F.transform(
        F.filter(hot, lambda m: m["w"]["first"].isNotNull()),
        lambda m: F.struct((m["at"] + m["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (m["at"] + m["w"]["last"] + WINDOW).alias("end")),
    )


def secret_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with `base_spans` and `all_spans`, each array<struct<start, kind, end>> sorted by start and then kind (0 assign, 1 access, 2 hex, 3 entropy).

    Null and empty texts have no spans; very long candidates take time in proportion to their length. Every row is judged alone, so repeated
    rows and ties don't matter; an empty table gives an empty result. Columns that `df`
    has already under these names stay, and the added ones get underscores in front.
    """
    base_name, all_name = fresh(df, "base_spans", "all_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = lambda pattern, ok: F.filter(matches(text, pattern), ok)
    assign = kept(ASSIGN, lambda m: F.length(F.regexp_extract(m["hit"], ASSIGN, 2)) >= 12)
    access = kept(ACCESS, lambda m: F.length(m["hit"]) >= 18)
    base = F.array_sort(F.concat(_spans(assign, 0), _spans(access, 1), _spans(matches(text, HEX), 2)))
    # the second step reads the first one's column, so the patterns are not evaluated again
    out = df.withColumn(base_name, base)
    return out.withColumn(all_name, F.array_sort(F.concat(F.col(base_name), _entropy_spans(text, F.col(base_name)))))


def _joined(spans: Column) -> Column:
    kind = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat(kind(s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`df` with all spans of its texts replaced by `mark`; overlapping spans get one mark. Null texts stay null."""
    base_name, all_name = fresh(df, "base_spans", "all_spans")
    text = F.col(text_col)
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        out = F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(gap, F.lit(mark))).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(F.col(all_name), state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return secret_spans(df, text_col).withColumn(text_col, F.when(F.size(all_name) > 0, done).otherwise(text)).drop(base_name, all_name)


def op6_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint")
    return secret_spans(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans")
    )


SQL: dict[str, str] = {}
QUERIES = {"op6_secrets": op6_secrets}
