"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.shared import cut, shared_folder

__all__ = ["content_key", "cut", "join_split", "narrow", "shared_folder"]


def content_key(text: Column) -> Column:
    """16 bytes that stand for a text; a null counts as an empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def narrow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def join_split(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join whose skewed left partitions adaptive execution can split.

    It splits only where both inputs come straight from a shuffle of their own.  A
    right side that was just aggregated by the same keys has none, so a redundant
    key (one bit of the others' hash) asks for one; that side is small after aggregation.
    """
    again = F.xxhash64(*on).bitwiseAND(F.lit(1))
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [*on, "_again"], how).drop("_again")
