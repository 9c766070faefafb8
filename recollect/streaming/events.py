"""Structured Streaming forms of the memory operators over a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.shared import shared_folder
from recollect.operators.tables import upsert_by_key


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet", at: str | None = "ts") -> DataFrame:
    """The rows of a table below a folder, one file or a folder of parts, as a stream; its time is cast so that it can carry a watermark."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    # as a pattern the path may be a file too, which a stream's path may not
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{files[:-1]}[{files[-1]}]")
    return stream if at is None else stream.withColumn(at, F.col(at).cast("timestamp"))


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one of the session."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now into Parquet (append mode) and read the result."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def dedupe(stream: DataFrame, keys: list[str], within: str) -> DataFrame:
    """One row of every key within the watermark's delay."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, kind: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts of each kind in tumbling (or sliding) windows; a window comes out when the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(kind, F.window("ts", width, slide).alias("w")).count().select(kind, F.col("w.start").alias("start"), F.col("count").alias("n"))


def sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    return stream.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def latest(stream: DataFrame, keys: list[str], version: str, folder: str) -> DataFrame:
    """The row with the largest version of every key.

    The engine's state holds one row a key; a batch writes the keys that it changed
    to a folder of its own (``change=N``, written anew if the batch runs again), and the reader
    merges those.  Nothing that stays as it was is written twice, and a restart, with or without
    new rows, reads the same table.
    """
    spark = stream.sparkSession
    row = F.struct(*stream.columns)
    newest = stream.groupBy(*keys).agg(F.max_by(row, version).alias("_row")).select("_row.*")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/change={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/changes/change=none")  # there is a table without any batch too
    query = newest.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    return upsert_by_key(changes, changes.limit(0), keys, version)
