"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once, also where `body` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and numbers."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def collapsed(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column, most: int = 90) -> Column:
    """Preview: collapsed, cut, and dotted where it was longer."""
    flat = collapsed(F.coalesce(c, F.lit("")))
    return F.concat(F.left(flat, F.lit(most)), F.when(F.length(flat) > most, F.lit("...")).otherwise(F.lit("")))


def any_of(c: Column, terms) -> Column:
    """Whether a text contains one of a short list of terms."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def found_in(c: Column, terms) -> Column:
    """The terms that a text contains, in the list's order."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(c, t))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of parts joined by the unit separator; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
