"""Token sets and their comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Distinct lower-cased words of a text, split at white space; none for a null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def word_tokens(text: Column, least: int = 3) -> Column:
    """All lower-cased runs of at least ``least`` word characters (Unicode), in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"(?U)\b(\w{{{least},}})\b"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def mentions(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the lower-cased text, as substrings."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + F.contains(lower, F.lit(w)).cast("int")
    return total


def mentions_any(text: Column, words: list[str]) -> Column:
    return mentions(text, words) > 0
