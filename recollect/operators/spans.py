"""Recall of items at set places of spans of memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens


def span_recall(items: DataFrame, spans: list[int], k: int = 5, words: int = 8) -> DataFrame:
    """(span, place, asked, recalled, recall): how often an item is among the ``k`` found for its own last words within its span.

    ``items`` are (position, text).  Positions are cut into bands of ``span``; the items at the first place, a quarter, half
    and three quarters of the way and at the last place of a band are asked for by their last ``words`` tokens.  Only items of the
    same band compete, and the band is part of the join's key, so there is no join by range.
    """
    at = F.array(*[F.struct(F.lit(s).cast("long").alias("span"), F.array(*[F.lit(p).cast("long") for p in sorted({0, s // 4, s // 2, 3 * s // 4, s - 1})]).alias("places")) for s in spans])
    rows = items.select("position", tokens(F.col("text")).alias("words"), F.explode(at).alias("s")).select("position", "words", "s.span", "s.places")
    rows = rows.withColumns({"band": F.floor(F.col("position") / F.col("span")), "place": F.col("position") % F.col("span")})
    asked = rows.where(F.array_contains("places", F.col("place"))).select("span", "band", "place", F.col("position").alias("wanted"), F.explode(F.slice("words", -F.least(F.lit(words), F.greatest(F.size("words"), F.lit(1))), F.lit(words))).alias("word"))
    held = rows.select("span", "band", "position", F.explode("words").alias("word"))
    shared = held.join(asked, ["span", "band", "word"]).groupBy("span", "band", "place", "wanted", "position").agg(F.count(F.lit(1)).alias("n"))
    best = shared.withColumn("_r", F.row_number().over(Window.partitionBy("span", "band", "wanted").orderBy(F.desc("n"), "position"))).where(F.col("_r") <= k)
    found = best.groupBy("span", "place", "wanted").agg(F.max((F.col("position") == F.col("wanted")).cast("long")).alias("hit"))
    return found.groupBy("span", "place").agg(F.count(F.lit(1)).alias("asked"), F.sum("hit").alias("recalled")).withColumn("recall", F.col("recalled") / F.col("asked"))
