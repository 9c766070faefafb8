"""Filters, updates and upserts over memory tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_spec(spec: dict[str, Any]) -> Column:
    """A filter from a dict: a scalar means equal, a list means in, a dict holds operators."""
    operators = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v), "$nin": lambda c, v: ~c.isin(v)}
    out = F.lit(True)
    for name, value in spec.items():
        column = F.col(name)
        tests = value if isinstance(value, dict) else {"$in" if isinstance(value, list) else "$eq": value}
        for op, v in tests.items():
            out = out & operators[op](column, v)
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def query_by_type(rows: DataFrame, kind: str, limit: int, offset: int = 0) -> DataFrame:
    return page(rows.where((F.col("memory_type") == kind) & F.col("is_active")), [F.desc("created_at"), F.asc("id")], limit, offset)


def query_by_time_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    return rows.where(F.col("created_at").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def query_by_strength(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.where(F.col("strength").between(low, high))


def query_unconsolidated(rows: DataFrame, least_importance: float, limit: int) -> DataFrame:
    """Oldest active rows that are not consolidated; importance is tested before the limit."""
    wanted = rows.where(~F.col("is_consolidated") & F.col("is_active") & (F.col("importance") >= least_importance))
    return page(wanted, [F.asc("created_at"), F.asc("id")], limit)


def time_filter(rows: DataFrame, as_of: str, lookback_days: int) -> DataFrame:
    """Rows with a time in the last days before ``as_of``; rows without one drop."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return rows.where((F.col("created_at") >= now - F.expr(f"INTERVAL '{lookback_days}' DAY")) & (F.col("created_at") <= now))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the largest version of every key; of equal versions the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


def read_many(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def delete_many(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def update_fields(rows: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with the patch's non-null values of known fields."""
    known = patch.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(known, key, "left")
    return joined.withColumns({f: F.coalesce(f"_new_{f}", f) for f in fields}).drop(*[f"_new_{f}" for f in fields])


def touch(rows: DataFrame, accesses: DataFrame, key: str = "id") -> DataFrame:
    """Access counts and last access of rows, from a log of accesses (key, ts)."""
    seen = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("_times"), F.max("ts").alias("_last"))
    joined = rows.join(seen, key, "left")
    counted = F.col("access_count") + F.coalesce("_times", F.lit(0))
    return joined.withColumns({"access_count": counted, "last_accessed_at": F.greatest("last_accessed_at", "_last")}).drop("_times", "_last")


def keep_last(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of every group."""
    return first_rows(rows, group, [c.desc() for c in order], n)


def first_rows(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def evict_oldest(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Rows of every group without its ``n`` oldest, numbered anew from 0 as ``seq``."""
    line = Window.partitionBy(*group).orderBy(*order)
    kept = rows.withColumn("_r", F.row_number().over(line)).where(F.col("_r") > n)
    return kept.withColumn("seq", (F.col("_r") - n - 1).cast("long")).drop("_r")
