"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated values become numbers of a finite domain, a keyed Feistel network
permutes the domain, and the result is written in the format of the value:
separators, length and check digits stay valid (an octet of an address can change its length). The network works on a pair (a, b) with
a < m and b < n by modular addition, so it is a permutation of m * n values of any m
and n. Equal values get equal pseudonyms whatever their separators, in all documents
that use the key, and `reveal` turns pseudonyms back.

Kinds: card (13 to 19 digits with a valid Luhn digit, also beside other numbers), phone (ten digits of the
North American plan, after +1 or in three separated groups), ip (four octets), date (2000-01-31, 31.01.2000, 31/01/2000 of the years 1900
to 2099), ssn (ranges that are given out), email (letters and digits of the local part, by position).
Candidates that don't validate stay as they are.

Everything is one projection: no shuffle, whatever the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, let

PATTERNS = {
    # a domain has at most 126 labels before the last one: the bound also keeps Java's recursion flat
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])(?<![0-9][ .-])(?:1[ .-])?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[ .-][0-9])",
}
# A run of digits as long as it goes, possessive because Java's greedy loop is recursive; it ends before a value of another kind.
PATTERNS["card"] = r"(?<![0-9])[0-9](?:(?:[ -](?!%s))?[0-9]){12,}+" % "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "date", "ssn", "phone"))
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = list(PATTERNS)
ROUNDS = 8
#: Setting of the session that holds the query's key.
KEY_CONF = "spark.ledgerloom.pii.key"
#: The 73,049 days of the years 1900 to 2099 are in 229 * 319 numbers.
DAYS, N_DAYS = (229, 319), 73049
#: A card's pseudonym is permuted on, at most so often, until it is found again where the card was found.
WALK = 64


def _number(digest: Column) -> Column:
    """Below 2**52, from the first hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, tweak: str, reveal: bool = False) -> Column:
    """struct<a, b>: a keyed permutation of the pairs a < m, b < n (bigint), or its inverse."""
    f = lambda r, x: _number(F.sha2(F.concat_ws(":", F.lit(key), F.lit(tweak), r.cast("string"), x.cast("string")), 256))
    pair = lambda x, y, p, q: F.struct(x.alias("a"), y.alias("b"), p.alias("m"), q.alias("n"))
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS)) if not reveal else F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1))
    ahead = lambda s, r: pair(s["b"], F.pmod(s["a"] + f(r, s["b"]), s["m"]), s["n"], s["m"])
    back = lambda s, r: pair(F.pmod(s["b"] - f(r, s["a"]), s["n"]), s["a"], s["n"], s["m"])
    long = lambda c: c.cast("bigint")
    return F.aggregate(rounds, pair(long(a), long(b), long(m), long(n)), back if reveal else ahead)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(s: Column, digits: Column) -> Column:
    """`s` with its digits replaced, in order, by those of `digits`."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: let(F.substring(s, i, F.lit(1)), lambda c: F.when(c.between("0", "9"), F.substring(digits, F.length(_digits(F.substring(s, F.lit(1), i))), F.lit(1))).otherwise(c)),
        ),
        "",
    )


def _luhn(body: Column) -> Column:
    """Check digit for the digits `body`, as a number."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 0, doubled(d)).otherwise(d)))
    return (10 - F.aggregate(digits, F.lit(0), lambda x, y: x + y) % 10) % 10


def _pad(n: Column, width: Column | int) -> Column:
    text = n.cast("string")
    return F.concat(F.repeat(F.lit("0"), (width if isinstance(width, Column) else F.lit(width)) - F.length(text)), text)


def _valid(d: Column) -> Column:
    """Whether 13 to 19 digits end in their Luhn digit."""
    size = F.length(d)
    return size.between(13, 19) & (F.substring(d, size, F.lit(1)).cast("int") == _luhn(F.substring(d, F.lit(1), size - 1)))


def _permuted(d: Column, key: str, reveal: bool) -> Column:
    """Another valid card number of the same length."""
    size = F.length(d) - 1
    half = F.floor((size + 1) / 2).cast("int")
    split = size - half
    high, low = (F.pow(F.lit(10.0), x).cast("bigint") for x in (split, half))
    out = feistel(F.substring(d, F.lit(1), split), F.substring(d, split + 1, half), high, low, key, "card", reveal)
    return let(let(out, lambda o: F.concat(_pad(o["a"], split), _pad(o["b"], half))), lambda b: F.concat(b, _luhn(b).cast("string")))


def _card(hit: Column, key: str, reveal: bool) -> Column:
    """The cards in a run of digit groups, from left to right.

    A card starts and ends with a group; of the places where one can be, the first valid one is taken, by end and then the
    greatest length, and the search goes on behind it. A pseudonym beside other digits could make an
    earlier place valid, so it is permuted on until none is: then `reveal` finds it at the same place. Earlier places
    have no digits behind the card, so cards that follow don't matter.
    """
    groups = F.transform(F.regexp_extract_all(hit, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))
    ends = F.aggregate(groups, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.get(a, F.size(a) - 1) + n)))

    def change(d, at):
        # (start, length) of each place in the order of preference; a card has at most 19 groups
        begins = lambda i: F.slice(at, F.greatest(i - 18, F.lit(1)), F.least(i, F.lit(19)))
        places = F.flatten(F.transform(at, lambda e, i: F.filter(F.transform(begins(i), lambda s: F.struct(s.alias("s"), (e - s).alias("n"))), lambda p: p["n"].between(13, 19))))
        return let(F.transform(places, lambda p, i: F.struct(p["s"].alias("s"), p["n"].alias("n"), i.alias("i"))), lambda ps: replaced(d, at, ps))

    def replaced(d, at, places):
        read = lambda digits, p: F.substring(digits, p["s"] + 1, p["n"])

        def step(acc, p):
            def walked(digits):
                # of the places before this one, 19 groups back are enough; each has at most seven lengths
                near = F.filter(F.slice(places, F.greatest(p["i"] - 132, F.lit(1)), F.least(p["i"], F.lit(133))), lambda q: (q["s"] >= acc["end"]) & (q["s"] + q["n"] > p["s"]))
                base = F.greatest(p["s"] - 18, F.lit(0))
                put = lambda x: F.concat(F.substring(digits, base + 1, p["s"] - base), x)
                again = lambda x: F.exists(near, lambda q: _valid(F.substring(put(x), q["s"] - base + 1, q["n"])))
                state = lambda x: let(x, lambda v: F.struct(v.alias("x"), again(v).alias("more")))
                new = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state(_permuted(read(digits, p), key, reveal)), lambda w, _: F.when(w["more"], state(_permuted(w["x"], key, reveal))).otherwise(w), lambda w: w["x"])
                return F.concat(F.substring(digits, F.lit(1), p["s"]), new, F.substring(digits, p["s"] + p["n"] + 1, F.length(digits)))

            took = (p["s"] >= acc["end"]) & _valid(read(acc["d"], p))
            return F.when(took, F.struct(walked(acc["d"]).alias("d"), (p["s"] + p["n"]).alias("end"))).otherwise(acc)

        return F.aggregate(places, F.struct(d.alias("d"), F.lit(0).alias("end")), step, lambda acc: F.when(acc["end"] > 0, separated(acc["d"], at)).otherwise(hit))

    def separated(d, at):
        between = F.regexp_extract_all(hit, F.lit("[^0-9]"), F.lit(0))
        return let(between, lambda b: F.array_join(F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda s, i: F.concat(F.substring(d, s + 1, F.get(at, i + 1) - s), F.coalesce(F.get(b, i), F.lit("")))), ""))

    return let(_digits(hit), lambda d: let(ends, lambda at: change(d, at)))


def _phone(hit: Column, key: str, reveal: bool) -> Column:
    """Area and exchange codes start with 2 to 9: 800 * 800 * 10000 numbers are 80000 * 80000."""

    def change(given):
        return let(F.when(F.length(given) == 10, F.concat(F.lit("1"), given)).otherwise(given), lambda d: numbered(given, d))

    def numbered(given, d):
        part = lambda at, n: F.substring(d, at, n).cast("bigint")
        at = ((part(2, 3) - 200) * 800 + part(5, 3) - 200) * 10000 + part(8, 4)
        out = let(at, lambda i: feistel(F.floor(i / 80000), i % 80000, F.lit(80000), F.lit(80000), key, "phone", reveal))
        write = lambda i: F.concat(F.lit("1"), _pad(F.floor(i / 8000000) + 200, 3), _pad(F.floor(i / 10000) % 800 + 200, 3), _pad(i % 10000, 4))
        ok = (F.length(d) == 11) & (part(2, 3) >= 200) & (part(5, 3) >= 200)
        return F.when(ok, let(let(out, lambda o: o["a"] * 80000 + o["b"]), lambda i: _refill(hit, F.right(write(i), F.length(given))))).otherwise(hit)

    return let(_digits(hit), change)


def _ip(hit: Column, key: str, reveal: bool) -> Column:
    def change(p):
        octet = lambda i: F.get(p, i).cast("bigint")
        out = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), key, "ip", reveal)
        new = let(out, lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.floor(o["a"] / 256), o["a"] % 256, F.floor(o["b"] / 256), o["b"] % 256)]))
        return F.when(F.forall(p, lambda x: x.cast("int") < 256), new).otherwise(hit)

    return let(F.split(hit, r"\."), change)


def _date(hit: Column, key: str, reveal: bool) -> Column:
    first = F.lit("1900-01-01").cast("date")

    def change(d):
        day = F.datediff(d, first)
        moved = lambda i: let(feistel(F.floor(i / DAYS[1]), i % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date", reveal), lambda o: (o["a"] * DAYS[1] + o["b"]).cast("int"))
        # two numbers are no days: at most two more steps lead out of them
        days = F.aggregate(F.sequence(F.lit(1), F.lit(DAYS[0] * DAYS[1] - N_DAYS)), moved(day), lambda i, _: F.when(i >= N_DAYS, moved(i)).otherwise(i))
        new = let(F.date_add(first, days), lambda x: F.when(hit.contains("-"), F.date_format(x, "yyyy-MM-dd")).when(hit.contains("."), F.date_format(x, "dd.MM.yyyy")).otherwise(F.date_format(x, "dd/MM/yyyy")))
        return F.when(F.year(d).between(1900, 2099), new).otherwise(hit)

    iso = F.when(hit.contains("-"), hit).otherwise(F.concat_ws("-", F.substring(hit, 7, 4), F.substring(hit, 4, 2), F.substring(hit, 1, 2)))
    return let(iso.try_cast("date"), change)


def _ssn(hit: Column, key: str, reveal: bool) -> Column:
    """Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999: pairs of 898 and 99 * 9999 values."""

    def change(d):
        area, group, serial = (F.substring(d, a, n).cast("bigint") for a, n in ((1, 3), (4, 2), (6, 4)))
        out = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", reveal)
        write = lambda o: F.concat(_pad(F.when(o["a"] >= 665, o["a"] + 2).otherwise(o["a"] + 1), 3), _pad(F.floor(o["b"] / 9999) + 1, 2), _pad(o["b"] % 9999 + 1, 4))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(ok, let(out, lambda o: _refill(hit, write(o)))).otherwise(hit)

    return let(_digits(hit), change)


def _email(hit: Column, key: str, reveal: bool) -> Column:
    """Each letter and digit of the local part moves within its class by a keyed amount for its place, the local part's length and the domain; case stays."""
    small, large, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def change(p):
        local, domain = F.get(p, 0), F.lower(F.get(p, 1))

        # the classes form a chain: each place's amount depends on the plain characters before it, so equal local parts stay equal and others differ
        def step(acc, c):
            amount = _number(F.sha2(F.concat_ws(":", F.lit(key), F.lit("email"), F.length(local).cast("string"), domain, F.lower(acc["plain"])), 256))
            moved = c
            for alphabet in (small, large, digit):
                at = F.instr(F.lit(alphabet), c)
                to = F.pmod((at - 1).cast("bigint") + (-amount if reveal else amount), F.lit(len(alphabet)).cast("bigint")).cast("int")
                moved = F.when(at > 0, F.substring(F.lit(alphabet), to + 1, F.lit(1))).otherwise(moved)
            return let(moved, lambda x: F.struct(F.concat(acc["out"], x).alias("out"), F.concat(acc["plain"], x if reveal else c).alias("plain")))

        start = F.struct(F.lit("").alias("out"), F.lit("").alias("plain"))
        return F.concat(F.aggregate(F.split(local, ""), start, step, lambda acc: acc["out"]), F.lit("@"), F.get(p, 1))

    return let(F.split(hit, "@"), change)


def _kind(hit: Column) -> Column:
    """Index of the first kind whose pattern the whole match fits, in the order of the alternatives; what fits no other is a card."""
    return reduce(lambda w, k: w.when(hit.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(KINDS.index(k))), KINDS[1:-1], F.when(hit.rlike(f"^(?:{PATTERNS['email']})$"), F.lit(0))).otherwise(F.lit(KINDS.index("card")))


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", reveal: bool = False, found_col: str = "pii") -> DataFrame:
    """`df` with personal data in its texts replaced, and `pii` array<struct<kind, changed>> with an entry for each candidate in order.

    kind is an index into KINDS; changed tells whether the candidate validated. Null texts stay
    null with no candidates; empty texts stay empty. Each row is judged alone, so repeated rows, ties
    and hot keys don't matter. If `df` has a column of that name, the added one gets underscores in
    front. With reveal=True and the same key, pseudonyms turn back into the values.
    """
    pii, parts = fresh(df, found_col, "pii_parts")
    text = F.col(text_col)
    new = lambda h, k: reduce(lambda w, x: w.when(k == KINDS.index(x[0]), x[1](h, key, reveal)), [("ip", _ip), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card)], F.when(k == 0, _email(h, key, reveal)))
    hits = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda h: let(_kind(h), lambda k: F.struct(h.alias("old"), k.alias("kind"), F.coalesce(new(h, k), h).alias("new"))))
    none = F.array().cast("array<struct<gap:string,hit:struct<old:string,kind:int,new:string>>>")
    pairs = F.zip_with(F.split(text, ANY, -1), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    out = df.withColumn(parts, F.when(text.rlike(ANY), pairs).otherwise(none))
    written = F.array_join(F.transform(F.col(parts), lambda p: F.concat(p["gap"], F.coalesce(p["hit"]["new"], F.lit("")))), "")
    listed = F.transform(F.filter(F.col(parts), lambda p: p["hit"].isNotNull()), lambda p: F.struct(p["hit"]["kind"].alias("kind"), (p["hit"]["old"] != p["hit"]["new"]).alias("changed")))
    return out.withColumn(pii, listed).withColumn(text_col, F.when(F.size(parts) > 0, written).otherwise(text)).drop(parts)


def op5_pii(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymize(docs, key=spark.conf.get(KEY_CONF, "pipeline-key-1"))
    n = lambda k: F.size(F.filter("pii", lambda p: (p["kind"] == KINDS.index(k)) & p["changed"])).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *[n(k) for k in KINDS], F.size("pii").cast("bigint").alias("n_candidates"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "text")


SQL: dict[str, str] = {}
QUERIES = {"op5_pii": op5_pii}
