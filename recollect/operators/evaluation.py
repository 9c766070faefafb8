"""Answer metrics and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answer_normalise(text: Column) -> Column:
    """Lower case without articles and punctuation, blanks squeezed."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\b(a|an|the)\b", " ")
    bare = F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def exact_match(prediction: Column, truth: Column) -> Column:
    return answer_normalise(prediction) == answer_normalise(truth)


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of distinct normalised words; 0 if either side has none."""
    p, t = (F.filter(F.array_distinct(F.split(answer_normalise(x), " ")), lambda w: w != "") for x in (prediction, truth))
    both = F.size(F.array_intersect(p, t))
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(p) + F.size(t)))


def latency_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    c = F.col(value)
    return rows.groupBy(*group).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"),
        F.percentile(c, 0.5).alias("p50"), F.percentile(c, 0.95).alias("p95"), F.percentile(c, 0.99).alias("p99"),
    )


def forgetting_slope(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares slope of y over x."""
    return rows.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.count(F.lit(1)).alias("n"))


def contains_match(prediction: Column, truth: Column) -> Column:
    """Whether one normalised text holds the other; an empty one matches nothing."""
    p, t = answer_normalise(prediction), answer_normalise(truth)
    return (p != "") & (t != "") & (F.contains(p, t) | F.contains(t, p))


def multiset_f1(prediction: Column, truth: Column) -> Column:
    """F1 of normalised words, repeated ones counted as often as both have them."""
    words = [F.filter(F.split(answer_normalise(x), " "), lambda w: w != "") for x in (prediction, truth)]

    def score(s: Column) -> Column:
        p, t = s["p"], s["t"]
        both = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, w: a + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(t, lambda x: x == w))))
        return F.when(both == 0, F.lit(0.0)).otherwise(2 * both / (F.size(p) + F.size(t)))

    # within an array of one, so that the words are made once and not again for each word
    return F.element_at(F.transform(F.array(F.struct(words[0].alias("p"), words[1].alias("t"))), score), 1)


def score_by_category(rows: DataFrame) -> DataFrame:
    """Mean F1, exact matches and count of (prediction, truth) by category, and over all."""
    scored = rows.select("category", token_f1(F.col("prediction"), F.col("truth")).alias("f1"), exact_match(F.col("prediction"), F.col("truth")).cast("int").alias("em"))
    return scored.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg("f1").alias("f1"), F.avg("em").alias("em")).withColumn("category", F.coalesce("category", F.lit("all")))


def composite_score(accuracy: Column, p95_ms: Column, ratio: Column, slope: Column, multi_hop: Column) -> Column:
    """0 to 100 out of accuracy, latency, compression, forgetting and multi-hop accuracy."""
    latency = F.when(p95_ms <= 1000, 100.0).when(p95_ms <= 5000, 80 - (p95_ms - 1000) / 100).when(p95_ms <= 10000, 40 - (p95_ms - 5000) / 200).otherwise(F.greatest(F.lit(0.0), 20 - (p95_ms - 10000) / 1000))
    forgetting = F.greatest(F.lit(0.0), 100 + slope * 100)
    return F.round(0.3 * accuracy * 100 + 0.2 * latency + 0.15 * F.least(F.lit(100.0), ratio * 10) + 0.15 * forgetting + 0.2 * multi_hop * 100, 2)


def aggregate_runs(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, deviation (0 for one run), least and most over runs."""
    c = F.col(value)
    return rows.groupBy(*by).agg(F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))


def compare_systems(a: DataFrame, b: DataFrame, by: str, value: str, tie: float = 1.0) -> DataFrame:
    """(by, score_a, score_b, delta, winner): a missing score is 0, a delta below ``tie`` is a tie."""
    both = a.select(by, F.col(value).alias("score_a")).join(b.select(by, F.col(value).alias("score_b")), by, "full")
    both = both.select(by, F.coalesce("score_a", F.lit(0.0)).alias("score_a"), F.coalesce("score_b", F.lit(0.0)).alias("score_b")).withColumn("delta", F.col("score_a") - F.col("score_b"))
    return both.withColumn("winner", F.when(F.abs("delta") < tie, "tie").when(F.col("delta") > 0, "a").otherwise("b"))


def wins_ties(rows: DataFrame, by: str) -> DataFrame:
    """How often score_a is above, below or equal to score_b, and their means."""
    return rows.groupBy(by).agg(F.count_if(F.col("score_a") > F.col("score_b")).alias("a_better"), F.count_if(F.col("score_b") > F.col("score_a")).alias("b_better"), F.count_if(F.col("score_a") == F.col("score_b")).alias("ties"), F.avg("score_a").alias("mean_a"), F.avg("score_b").alias("mean_b"))


def retrieval_by_age(rows: DataFrame, bucket: Column, success: str) -> DataFrame:
    """Share of successes by age bucket."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.avg(F.col(success).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def session_recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted sessions among those found; null if none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(found, wanted)) / F.size(wanted))


def verdict(text: Column) -> Column:
    """struct(correct, reason) out of a judge's text with ``VERDICT:`` and ``REASON:`` lines."""
    return F.struct(F.contains(F.upper(F.coalesce(text, F.lit(""))), F.lit("VERDICT: CORRECT")).alias("correct"), F.trim(F.regexp_extract(text, r"(?i)REASON:\s*([^\n]*)", 1)).alias("reason"))
