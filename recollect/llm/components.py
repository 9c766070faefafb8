"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is one of its nodes.

    Every round maps each node to the least of itself and its neighbours, follows
    that map once more, and contracts the edges.  At least every node that is not
    a local minimum goes, so the edges shrink by a constant factor a round.  Loops
    and repeated edges are harmless; no edges give no rows.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    total = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        again = step.select(F.col("node").alias("up"), F.col("up").alias("far"))
        step = cut(step.join(again, "up").select("node", F.col("far").alias("up")))
        ups = [step.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab"]
        left = left.join(ups[0], "a").join(ups[1], "b").where("up_a <> up_b")
        left = cut(left.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        if total is None:
            total = step.select("node", F.col("up").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), F.col("up"))
            total = total.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return total
