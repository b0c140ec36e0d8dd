"""String expressions: literal search, trigram similarity, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the least similarity at which a title counts as found.
LEAST_SIMILARITY = 0.15


def contains(column: Column, keyword: str) -> Column:
    """Case-insensitive literal containment; null holds nothing."""
    return F.coalesce(F.contains(F.upper(column), F.lit(keyword.upper())), F.lit(False))


def trigrams(column: Column) -> Column:
    """The set of trigrams of the lower-cased words, each padded with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, grams)))


def similarity_of(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where neither text has any."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return similarity_of(trigrams(a), trigrams(b))


def stripped(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+|[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$", "")


def cleaned(column: Column, longest: int | None = None) -> Column:
    """Stripped text cut to `longest` characters; null becomes empty."""
    out = F.coalesce(stripped(column), F.lit(""))
    return F.substring(out, 1, longest) if longest else out


def filled(column: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(column, F.lit(""))
