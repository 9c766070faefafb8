"""The folder that driver and executors share, cutting lineage there, and dealing rows to tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only on one machine (master ``local``) a folder of its own is set where it is unset."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or (have.get() if have.isDefined() else None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="recollect-")
    if not have.isDefined():
        context.setCheckpointDir(folder)
    return folder


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to as many tasks as a shuffle has partitions, by keys.

    For much work on narrow rows: a file of a few MB is read by one task, however many rows it has.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(rows: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
