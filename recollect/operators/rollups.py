"""One row for each entity, relation, triplet and fact out of many mentions of it.

``order`` are the columns that tell which mention is the first (of equal ones that of the least values); all sums are partial before they are
shuffled, and what is kept of a group is bounded by its distinct properties or sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.shared import spread


def entity_name(name: Column) -> Column:
    """A name in lower case, trimmed, blanks for underscores."""
    return F.lower(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))


def entity_rollup(mentions: DataFrame, order: list[str]) -> DataFrame:
    """(name, spelling, kind, mentions) of mentions (name, kind): the first spelling and the first kind of every name.  Null names are left out."""
    first = F.struct(*order, "name", "kind")
    rows = mentions.where("name is not null").groupBy(entity_name(F.col("name")).alias("_n"))
    return rows.agg(F.min_by("name", first).alias("spelling"), F.min_by("kind", first).alias("kind"), F.count(F.lit(1)).alias("mentions")).withColumnRenamed("_n", "name")


#: Mentions of a relation from which on they are merged in parts before they meet.
MANY = 1_000_000


def relation_rollup(relations: DataFrame, order: list[str]) -> DataFrame:
    """(source, relation, target, confidence, properties, n): the highest confidence of a relation and its properties, the last value of each.

    ``properties`` is a map; its entries are merged one by one, so a relation with very many mentions is no large group.  Mentions meet
    once, by a hash of their relation, which they are sorted by first (names that begin alike make long comparisons).  Relations
    of over ``MANY`` mentions (a few at most) are merged task by task before.
    """
    hashed = relations.withColumn("_h", F.xxhash64("source", "relation", "target"))
    many = F.broadcast(hashed.groupBy("_h").count().where(F.col("count") > MANY).select("_h"))
    return _merged(spread(hashed.join(many, "_h", "left_anti"), "_h"), order).unionByName(_merged(hashed.join(many, "_h", "left_semi"), order))


def _merged(relations: DataFrame, order: list[str]) -> DataFrame:
    """One row for each relation; nothing is shuffled if its mentions are in one task."""
    keys = ["_h", "source", "relation", "target"]
    entries = relations.select(*keys, "confidence", F.struct(*order).alias("_o"), F.posexplode_outer("properties").alias("_i", "key", "value"))
    # a mention without properties is one entry without a key
    once = F.sum((F.coalesce("_i", F.lit(0)) == 0).cast("long")).alias("n")
    last = entries.groupBy(*keys, "key").agg(F.max_by("value", F.struct("_o", "value")).alias("value"), F.max("confidence").alias("confidence"), once)
    # the rows of a relation are its distinct properties
    line = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("key"))
    group = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pairs = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value"))).over(group)
    rows = last.select(*keys[1:], F.row_number().over(line).alias("_r"), F.max("confidence").over(group).alias("confidence"), F.map_from_entries(pairs).alias("properties"), F.sum("n").over(group).alias("n"))
    return rows.where("_r = 1").drop("_r")


def triplet_rollup(triplets: DataFrame, order: list[str], provenance: list[str]) -> DataFrame:
    """(source, relation, target, provenance columns, n): a triplet with where its first mention came from."""
    first = F.min_by(F.struct(*provenance), F.struct(F.struct(*order).alias("o"), F.struct(*provenance).alias("p"))).alias("_p")
    return triplets.groupBy("source", "relation", "target").agg(first, F.count(F.lit(1)).alias("n")).select("source", "relation", "target", "_p.*", "n")


def merge_facts(facts: DataFrame, order: list[str]) -> DataFrame:
    """One fact of every lower-cased (subject, predicate, object), out of (fact_id, subject, predicate, object, confidence, evidence, sources).

    The first id; the first confidence and .1 more for each further one, 1 at most; all evidence; the
    distinct sources (an array of texts) in alphabetic order.
    """
    key = ["subject", "predicate", "object"]
    rows = facts.withColumns({c: F.lower(F.col(c).cast("string")) for c in key}).withColumn("_o", F.struct(*order))
    heads = rows.groupBy(*key).agg(F.min_by("fact_id", "_o").alias("fact_id"), F.min_by("confidence", "_o").alias("_c"), F.sum("evidence").alias("evidence"), F.count(F.lit(1)).alias("_n"))
    told = rows.select(*key, F.explode("sources").alias("source")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("source")).alias("sources"))
    joined = heads.join(told, [heads[c].eqNullSafe(told[c]) for c in key], "left")
    confidence = F.least(F.lit(1.0), F.col("_c") + 0.1 * (F.col("_n") - 1))
    return joined.select(*[heads[c] for c in key], "fact_id", confidence.alias("confidence"), "evidence", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def graph_stats(triplets: DataFrame) -> DataFrame:
    """(part, kind, n): entities and relations by kind, current triplets, and their totals (kind ``all``).

    ``triplets`` are (source, source_kind, relation, target, target_kind, is_current).
    """
    ends = triplets.select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_kind").alias("kind")), F.struct(F.col("target").alias("name"), F.col("target_kind").alias("kind")))).alias("e")).select("e.*").distinct()
    counted = lambda rows, part: rows.rollup("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.coalesce("kind", F.lit("all")).alias("kind"), "n")
    relations = triplets.select(F.col("relation").alias("kind"), "is_current")
    return counted(ends, "entity").unionByName(counted(relations, "relation")).unionByName(counted(relations.where("is_current"), "current"))
