"""Small operators over tables of facts, items and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens


def facts_about(facts: DataFrame, subject: str, kind: str | None = None, current: bool = True) -> DataFrame:
    """Facts of a subject, in any letters, of one type if given; only those that hold unless told otherwise."""
    rows = facts.where(F.lower("subject") == subject.lower())
    rows = rows if kind is None else rows.where(F.col("fact_type") == kind)
    return rows.where("is_current") if current else rows


def valid_at(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that hold at a time; an open end holds for ever."""
    return facts.where(F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(F.col("valid_until") >= at, F.lit(True)))


def triplets_of(triplets: DataFrame, entity: str, relation: str | None = None, direction: str = "both") -> DataFrame:
    """Current triplets that leave an entity (``out``), reach it (``in``) or either."""
    rows = triplets.where("is_current")
    rows = rows if relation is None else rows.where(F.col("relation") == relation)
    out = rows.where(F.col("source") == entity).withColumn("direction", F.lit("out"))
    back = rows.where(F.col("target") == entity).withColumn("direction", F.lit("in"))
    return {"out": out, "in": back}[direction] if direction != "both" else out.unionByName(back)


def invalidate(triplets: DataFrame, by: DataFrame) -> DataFrame:
    """Triplets with ``is_current`` and ``invalidated_by`` after the changes (triplet_id, by)."""
    changes = by.groupBy("triplet_id").agg(F.min("by").alias("invalidated_by"))
    joined = triplets.join(changes, "triplet_id", "left")
    return joined.withColumn("is_current", F.col("is_current") & F.col("invalidated_by").isNull())


def merge_sets(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both sets, each lower-cased key once; of equal keys the first set's least ``fact_id``."""
    both = first.withColumn("_set", F.lit(0)).unionByName(second.withColumn("_set", F.lit(1)))
    names = [F.lower(F.col(k).cast("string")) for k in key]
    line = Window.partitionBy(*names).orderBy("_set", "fact_id")
    return both.withColumn("_r", F.row_number().over(line)).where("_r = 1").drop("_r", "_set")


def flatten_metadata(rows: DataFrame, column: str) -> DataFrame:
    """A struct's fields as columns ``a.b``: scalars as they are, lists of scalars as comma texts; other fields drop."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def fields(kind: StructType, path: str, label: str):
        for f in kind.fields:
            here, name = f"{path}.`{f.name}`", f"{label}{f.name}"
            if isinstance(f.dataType, StructType):
                yield from fields(f.dataType, here, f"{name}.")
            elif isinstance(f.dataType, ArrayType):
                if not isinstance(f.dataType.elementType, (StructType, ArrayType, MapType)):
                    yield F.concat_ws(",", F.col(here).cast("array<string>")).alias(name)
            elif not isinstance(f.dataType, MapType):
                yield F.col(here).alias(name)

    rest = [c for c in rows.columns if c != column]
    return rows.select(*rest, *fields(rows.schema[column].dataType, f"`{column}`", ""))


def vector_update(vectors: DataFrame, patch: DataFrame, key: str = "vec_id") -> DataFrame:
    """Upsert of vectors: each given column replaces the old value, a null keeps it; new ids are added."""
    old, new = vectors.alias("o"), patch.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in vectors.columns if c != key])


def embed_text(summary: Column, content: Column, most: int = 8000) -> Column:
    """Summary, a blank line and content, cut."""
    return F.substring(F.concat_ws("\n\n", F.when(summary != "", summary), content), 1, most)


def sentence_union(old: Column, new: Column) -> Column:
    """The sentences of both texts, each once and in order of the alphabet."""
    def parts(t: Column) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), "[.!?]"), lambda s: F.trim(s)), lambda s: s != "")

    return F.concat(F.array_join(F.array_sort(F.array_union(parts(old), parts(new))), ". "), F.lit("."))


def new_words(candidate: Column, existing: Column) -> Column:
    """Words of a text that another lacks, without stop words; three of them add to it."""
    # Words that add nothing.
    stop = ["the", "a", "an", "is", "are", "was", "were", "and", "or", "but"]
    return F.array_except(F.array_except(tokens(candidate), tokens(existing)), F.lit(stop))


def decide(pairs: DataFrame, candidates: DataFrame, most: int = 5) -> DataFrame:
    """(id, action, target) of every candidate, from its ``most`` nearest (id, other, similarity, fresh, contradicts).

    Nothing over .1 alike: ADD.  Else, in this order: one over .95 alike, NOOP; a (newer) contradiction
    of one, DELETE it; three new words or more beside the nearest, UPDATE that; else ADD.
    """
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    near = pairs.where("similarity > 0.1").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    first = lambda when: F.min(F.when(when, F.struct("_r", "other")))["other"]
    found = near.groupBy("id").agg(first(F.col("similarity") > 0.95).alias("_same"), first(F.col("contradicts")).alias("_against"), first((F.col("_r") == 1) & (F.col("fresh") >= 3)).alias("_more"))
    action = F.when(F.col("_same").isNotNull(), "NOOP").when(F.col("_against").isNotNull(), "DELETE").when(F.col("_more").isNotNull(), "UPDATE").otherwise("ADD")
    return candidates.select("id").join(found, "id", "left").select("id", action.alias("action"), F.coalesce("_same", "_against", "_more").alias("target"))


def apply_decisions(memories: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next version of ``memories`` (memory_id, text) after decisions (id, action, target) about candidates (id, memory_id, text).

    DELETE takes its target away, and the candidate comes in its place as ADD's do; UPDATE gives its target the
    sentences of both, of all candidates if there are several.  A target that is also deleted in the same batch
    stays deleted.  NOOP changes nothing.
    """
    both = candidates.join(decisions, "id")
    gone = both.where("action = 'DELETE'").select(F.col("target").alias("memory_id")).distinct()
    added = both.where("action in ('ADD', 'DELETE')").select("memory_id", "text")
    more = both.where("action = 'UPDATE'").groupBy(F.col("target").alias("memory_id")).agg(F.array_join(F.array_sort(F.collect_list("text")), ". ").alias("_more"))
    kept = memories.join(gone, "memory_id", "left_anti").join(more, "memory_id", "left")
    kept = kept.select("memory_id", F.when(F.col("_more").isNotNull(), sentence_union(F.col("text"), F.col("_more"))).otherwise(F.col("text")).alias("text"))
    return kept.unionByName(added)


def feedback_boost(candidates: DataFrame, learned: DataFrame, rates: DataFrame) -> DataFrame:
    """``boost`` of each (query_key, unit): its learned score, else the unit's use rate, else 1."""
    both = candidates.join(learned.select("query_key", "unit", F.col("score").alias("_score")), ["query_key", "unit"], "left").join(rates.select("unit", F.col("rate").alias("_rate")), "unit", "left")
    return both.withColumn("boost", F.coalesce("_score", "_rate", F.lit(1.0))).drop("_score", "_rate")
