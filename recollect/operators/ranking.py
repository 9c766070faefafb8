"""Re-ranking of candidate rows (query_id, memory_id, score, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens


def top(rows: DataFrame, score: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The best k of every query (and of every further group), with their rank."""
    order = Window.partitionBy("query_id", *(by or [])).orderBy(F.desc(score), "memory_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def per_tier_cap(rows: DataFrame, tier: str, each: int = 5, overall: int = 10) -> DataFrame:
    """At most ``each`` of every tier, then ``overall`` of every query."""
    return top(top(rows, "score", each, [tier]).drop("rank"), "score", overall)


def dedupe_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every (query, key)."""
    line = Window.partitionBy("query_id", key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(line)).where("_rank = 1").drop("_rank")


def diversity_bonus(rows: DataFrame, kind: str, bonus: float = 0.1) -> DataFrame:
    """The best row of every kind gains a bonus."""
    line = Window.partitionBy("query_id", kind).orderBy(F.desc("score"), "memory_id")
    return rows.withColumn("score", F.col("score") + F.when(F.row_number().over(line) == 1, bonus).otherwise(0.0))


def mmr_rerank(candidates: DataFrame, balance: float = 0.7, most: int = 50) -> DataFrame:
    """Maximal marginal relevance: (query_id, memory_id, score, rank).

    Picks by balance * score - (1 - balance) * the greatest token Jaccard to what is
    picked.  Only the best ``most`` candidates of a query take part, cut before the
    grouping, so a group is bounded.
    """

    def pick(group):
        left = {r.memory_id: (r.score, frozenset(r.words)) for r in group.sort_values(["score", "memory_id"], ascending=[False, True]).itertuples()}
        near, out = dict.fromkeys(left, 0.0), []
        while left:
            best = max(left, key=lambda m: (balance * left[m][0] - (1 - balance) * near[m], -m))
            value, words = left.pop(best)
            out.append((group["query_id"].iloc[0], best, value - (1 - balance) * near[best], len(out) + 1))
            for m, (_, other) in left.items():
                if words and other:
                    near[m] = max(near[m], len(words & other) / len(words | other))
        return type(group)(out, columns=["query_id", "memory_id", "score", "rank"])

    some = top(candidates, "score", most).select("query_id", "memory_id", F.col("score").cast("double").alias("score"), tokens(F.col("text")).alias("words"))
    return some.groupBy("query_id").applyInPandas(pick, "query_id long, memory_id long, score double, rank int")
