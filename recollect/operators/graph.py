"""Traversals of an edge table (source, relation, target) as a bounded number of joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens
from recollect.operators.shared import cut


def reach(edges: DataFrame, seeds: DataFrame, hops: int, undirected: bool = True) -> DataFrame:
    """(seed, node, hop) for every node within ``hops`` of a seed, with its least hop.

    ``seeds`` has (seed).  Visited nodes leave the frontier by an anti-join, so a hop
    is one join and one distinct.
    """
    step = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    if undirected:
        step = step.union(step.select("there", "here"))
    step = step.distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    seen = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        found = frontier.join(step, F.col("node") == F.col("here")).select("seed", F.col("there").alias("node")).distinct()
        frontier = cut(found.join(seen, ["seed", "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree) over both ends."""
    ends = edges.select(F.col("source").alias("node")).unionAll(edges.select(F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def match(edges: DataFrame, source: str | None = None, relation: str | None = None, target: str | None = None, entity: str | None = None) -> DataFrame:
    """Edges by any subset of source, relation, target, or with an entity on either side."""
    for name, value in (("source", source), ("relation", relation), ("target", target)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    if entity is not None:
        edges = edges.where((F.col("source") == entity) | (F.col("target") == entity))
    return edges


def related(edges: DataFrame, seeds: DataFrame, hops: int, most: int = 10) -> DataFrame:
    """(seed, node, hop): entities within ``hops`` on either side, of each hop the first ``most`` new ones by name; the seed is left out."""
    step = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    step = step.union(step.select("there", "here")).distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    seen = frontier.withColumn("hop", F.lit(0))
    first = Window.partitionBy("seed").orderBy("node")
    for hop in range(1, hops + 1):
        found = frontier.join(step, F.col("node") == F.col("here")).select("seed", F.col("there").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
        frontier = cut(found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).drop("_r"))
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return seen.where("hop > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, edge columns) of all edges that touch an entity fewer than ``hops`` steps from the seed."""
    near = reach(edges, seeds, hops - 1).select("seed", "node")
    ends = edges.select("*", F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return near.join(ends, "node").drop("node").distinct()


def shortest_path(edges: DataFrame, pairs: DataFrame, hops: int = 3) -> DataFrame:
    """(start, end, length, path): a shortest undirected path of at most ``hops`` edges; of equals the first by its nodes.

    Both ends grow towards each other, and an edge between what they have reached closes a path, so a hub in the
    middle is looked up and not spread out.  Each node is kept once an end, with its first path.
    """
    step = edges.select(F.col("source").alias("here"), F.col("target").alias("there"))
    step = cut(step.union(step.select("there", "here")).distinct())

    def grown(end: str, levels: int, path) -> DataFrame:
        """(end, node, path) of all nodes within some hops of each end."""
        frontier = pairs.select(end).distinct().select(end, F.col(end).alias("node"), F.array(end).alias("path"))
        seen = frontier
        for _ in range(levels):
            found = frontier.join(step, F.col("node") == F.col("here")).select(end, F.col("there").alias("node"), path(F.col("path"), F.col("there")).alias("path"))
            frontier = cut(found.groupBy(end, "node").agg(F.min("path").alias("path")).join(seen.select(end, "node"), [end, "node"], "left_anti"))
            seen = seen.unionByName(frontier)
        return seen

    pairs = pairs.distinct()
    same = pairs.where(F.col("start") == F.col("end")).select("start", "end", F.array("start").alias("path"))
    if hops < 1:
        return same.select("start", "end", F.lit(0).alias("length"), "path")
    out = grown("start", hops // 2, F.array_append).withColumnsRenamed({"node": "here", "path": "_out"})
    back = grown("end", (hops - 1) // 2, lambda path, there: F.array_prepend(path, there)).withColumnsRenamed({"node": "there", "path": "_back"})
    met = pairs.join(out, "start").join(back, "end").join(step, ["here", "there"])
    found = same.unionByName(met.select("start", "end", F.concat("_out", "_back").alias("path")))
    first = found.groupBy("start", "end").agg(F.min(F.struct((F.size("path") - 1).alias("length"), "path")).alias("f"))
    return first.select("start", "end", "f.length", "f.path")


def beam(edges: DataFrame, asked: DataFrame, seeds: DataFrame, hops: int = 3, width: int = 5, least: float = 0.1) -> DataFrame:
    """(query_id, path, score): chains of edges from the seeds of a question, the best ``width`` of each hop kept.

    An edge scores its shared words / (question's words + 1), .3 more if its relation suits the question, .5 less
    if it leads back; a path scores .8 of what it was and .2 of the edge.  ``edges`` has (edge_id, source, relation,
    target), ``asked`` (query_id, q), ``seeds`` (query_id, node).
    """
    low = F.lower("q")
    # Relations that suit a question.
    suits = (
        ((F.contains(low, F.lit("where")) | F.contains(low, F.lit("location"))) & F.col("relation").isin("lives_in", "located_in", "works_at"))
        | (F.contains(low, F.lit("who")) & F.col("relation").isin("knows", "friend_of", "married_to"))
        | (F.contains(low, F.lit("what")) & F.contains(low, F.lit("like")) & F.col("relation").isin("likes", "has_preference"))
    )
    words = tokens(F.concat_ws(" ", "source", F.replace("relation", F.lit("_"), F.lit(" ")), "target"))
    step = edges.select("edge_id", F.col("source").alias("node"), "relation", F.col("target").alias("there"), words.alias("said"))
    paths = seeds.select("query_id", "node", F.array().cast("array<long>").alias("path"), F.array("node").alias("visited"), F.lit(1.0).alias("score"))
    kept = []
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path")
    for _ in range(hops):
        grown = paths.join(asked, "query_id").join(step, "node")
        worth = F.size(F.array_intersect(tokens(F.col("q")), "said")) / (F.size(tokens(F.col("q"))) + 1) + F.when(suits, 0.3).otherwise(0.0) - F.when(F.array_contains("visited", F.col("there")), 0.5).otherwise(0.0)
        grown = grown.withColumn("_worth", worth).where(F.col("_worth") >= least)
        grown = grown.select("query_id", F.col("there").alias("node"), F.array_append("path", F.col("edge_id")).alias("path"), F.array_append("visited", F.col("there")).alias("visited"), (0.8 * F.col("score") + 0.2 * F.col("_worth")).alias("score"))
        paths = cut(grown.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).drop("_r"))
        kept.append(paths)
    found = reduce(DataFrame.unionByName, kept)
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width).select("query_id", "path", "score")


def similar_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity, score): 1 for equal names, .8 where one holds the other as whole words.

    Names compare in lower case with blanks for underscores; both cases are equi-joins on the name or on its first word.
    """
    def shaped(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(F.col(column), F.lower(F.trim(F.replace(column, F.lit("_"), F.lit(" ")))).alias("_n")).distinct()

    a, b = shaped(names, "name"), shaped(entities, "entity")
    same = a.join(b, "_n").select("name", "entity", F.lit(1.0).alias("score"))

    def held(small: DataFrame, large: DataFrame) -> DataFrame:
        words = large.withColumn("_w", F.explode(F.array_distinct(F.split("_n", " ")))).withColumnRenamed("_n", "_m")
        both = small.withColumn("_w", F.element_at(F.split("_n", " "), 1)).join(words, "_w").where("_n <> _m")
        return both.where(F.contains(F.concat(F.lit(" "), "_m", F.lit(" ")), F.concat(F.lit(" "), "_n", F.lit(" ")))).select("name", "entity", F.lit(0.8).alias("score"))

    return same.unionByName(held(a, b).distinct()).unionByName(held(b, a).distinct()).groupBy("name", "entity").agg(F.max("score").alias("score"))
