"""A log of what happened to memories, out of two versions of their table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The names of the events that two versions can tell.
CREATED, ACCESSED, UPDATED, DELETED = "memory_created", "memory_accessed", "memory_updated", "memory_deleted"
STM_PROMOTED, EPISODIC_PROMOTED, MERGED, COLLECTED = "stm_promoted", "episodic_promoted", "memory_merged", "memory_garbage_collected"
DECAYED, WEAK = "decay_updated", "strength_below_threshold"
STARTED, COMPLETED = "consolidation_started", "consolidation_completed"

LOG = "event string, at timestamp_ntz, memory_id long, memory_type string, old double, new double, source string"
_WATCHED = ("id", "updated_at", "strength", "access_count", "is_active", "is_consolidated", "merged_into")


def change_log(before: DataFrame, after: DataFrame, source: str, weak: float = 0.1) -> DataFrame:
    """One row for each event between two versions of a table of memories.

    Both have ``id`` (unique), ``memory_type``, ``updated_at``, ``strength``,
    ``access_count``, ``is_active``, ``is_consolidated``, ``merged_into`` and any others; one
    full outer join by id compares them, the others by a digest.  A memory may have several events.
    Those of the whole run stand around them: ``consolidation_started`` and
    ``consolidation_completed`` (with the number of events) at the first and last time.
    Rows (event, at, memory_id, memory_type, old, new, source); null values are equal to each other.
    """
    others = sorted(set(before.columns) & set(after.columns) - set(_WATCHED))

    def side(rows: DataFrame, name: str) -> DataFrame:
        watched = [F.col(c).alias(f"{name}_{c}") for c in _WATCHED if c != "id"]
        return rows.select("id", F.lit(True).alias(f"in_{name}"), F.col("memory_type").alias(f"{name}_memory_type"), F.xxhash64(*(F.struct(F.col(c).isNull(), F.col(c)) for c in others)).alias(f"{name}_digest"), *watched)

    both = side(before, "old").join(side(after, "new"), "id", "full_outer")
    old, new = (lambda c: F.col(f"old_{c}")), (lambda c: F.col(f"new_{c}"))
    stays = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()

    def event(name: str, when: Column, a: Column | None = None, b: Column | None = None) -> Column:
        value = lambda x: F.lit(None).cast("double") if x is None else x.cast("double")
        return F.when(when, F.struct(F.lit(name).alias("event"), value(a).alias("old"), value(b).alias("new")))

    collected = stays & old("is_active") & ~new("is_active")
    consolidated = stays & ~old("is_consolidated") & new("is_consolidated")
    events = F.array_compact(
        F.array(
            event(CREATED, F.col("in_old").isNull(), None, new("strength")),
            event(DELETED, F.col("in_new").isNull(), old("strength")),
            event(COLLECTED, collected & (new("strength") < weak)),
            event(DELETED, collected & ~(new("strength") < weak), old("strength")),
            event(ACCESSED, stays & (new("access_count") > old("access_count")), old("access_count"), new("access_count")),
            event(DECAYED, stays & (new("strength") < old("strength")), old("strength"), new("strength")),
            event(WEAK, stays & (old("strength") >= weak) & (new("strength") < weak), old("strength"), new("strength")),
            event(STM_PROMOTED, consolidated & (old("memory_type") == "short_term")),
            event(EPISODIC_PROMOTED, consolidated & (old("memory_type") != "short_term")),
            event(MERGED, stays & old("merged_into").isNull() & new("merged_into").isNotNull(), None, new("merged_into")),
            event(UPDATED, stays & (old("digest") != new("digest"))),
        )
    )
    kind = F.coalesce(new("memory_type"), old("memory_type"))
    rows = both.select("id", kind.alias("memory_type"), F.coalesce(new("updated_at"), old("updated_at")).alias("at"), F.explode(events).alias("e"))
    rows = rows.select("e.event", "at", F.col("id").alias("memory_id"), "memory_type", "e.old", "e.new")
    run = rows.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 0")
    ends = run.select(F.explode(F.array(F.struct(F.lit(STARTED).alias("event"), F.col("first").alias("at"), F.lit(None).cast("double").alias("new")), F.struct(F.lit(COMPLETED).alias("event"), F.col("last").alias("at"), F.col("n").cast("double").alias("new")))).alias("e"))
    ends = ends.select("e.event", "e.at", F.lit(None).cast("long").alias("memory_id"), F.lit(None).cast("string").alias("memory_type"), F.lit(None).cast("double").alias("old"), "e.new")
    return rows.unionByName(ends).withColumn("source", F.lit(source))


def publish(log: DataFrame, folder: str, version: int) -> None:
    """Write the log of a version below a folder; a repeated run writes the same place anew."""
    log.write.mode("overwrite").parquet(f"{folder}/version={version}")


def log_stream(log: DataFrame, folder: str) -> DataFrame:
    """The published log as a stream; its time can carry a watermark."""
    stream = log.sparkSession.readStream.schema(log.schema).option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumn("at", F.col("at").cast("timestamp"))


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(event, start, n) of every window that the watermark has closed."""
    counted = stream.withWatermark("at", late).groupBy("event", F.window("at", width).alias("w")).count()
    return counted.select("event", F.col("w.start").alias("start"), F.col("count").alias("n"))
