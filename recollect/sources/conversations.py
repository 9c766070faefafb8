"""Readers that turn conversation files into a table of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TURN = "array<struct<speaker: string, text: string>>"


def read_sessions_json(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, session, seq, speaker, text, said_on) from files with ``session_N`` keys.

    ``conversation`` holds ``session_N`` (a list of turns) and ``session_N_date_time``;
    sessions are numbered, so the tenth follows the ninth.  Other keys are left aside.
    """
    raw = spark.read.option("multiLine", True).schema("sample_id string, conversation map<string, string>").json(path)
    entry = raw.select("sample_id", "conversation", F.explode("conversation").alias("key", "value"))
    number = F.regexp_extract("key", r"^session_(\d+)$", 1)
    sessions = entry.where(F.col("key").rlike(r"^session_\d+$"))
    turns = sessions.select("sample_id", number.cast("int").alias("session"), F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))).alias("said_on"), F.posexplode(F.from_json("value", _TURN)).alias("seq", "turn"))
    return turns.select("sample_id", "session", "seq", "turn.speaker", "turn.text", "said_on")


def read_haystack_json(spark: SparkSession, path: str, question_type: str | None = None, limit: int | None = None) -> DataFrame:
    """(question_id, session_id, session, seq, speaker, text, said_on) from questions with parallel session lists."""
    schema = "question_id string, question_type string, question string, answer string, haystack_sessions array<array<struct<role: string, content: string>>>, haystack_dates array<string>, haystack_session_ids array<string>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    if question_type is not None:
        raw = raw.where(F.col("question_type") == question_type)
    if limit is not None:
        raw = raw.orderBy("question_id").limit(limit)
    zipped = F.arrays_zip(F.col("haystack_sessions").alias("turns"), F.col("haystack_dates").alias("said_on"), F.col("haystack_session_ids").alias("session_id"))
    sessions = raw.select("question_id", F.posexplode(zipped).alias("session", "s"))
    turns = sessions.select("question_id", "session", "s.session_id", "s.said_on", F.posexplode("s.turns").alias("seq", "turn"))
    return turns.select("question_id", "session_id", "session", "seq", F.col("turn.role").alias("speaker"), F.col("turn.content").alias("text"), "said_on")


def tag_index(memories: DataFrame, key: str = "id") -> DataFrame:
    """One row of every (memory, tag)."""
    return memories.select(key, F.explode("tags").alias("tag")).distinct()


def pack_json(memories: DataFrame, columns: list[str], into: str = "data") -> DataFrame:
    """The columns as one JSON text."""
    rest = [c for c in memories.columns if c not in columns]
    return memories.select(*rest, F.to_json(F.struct(*columns)).alias(into))


def hash_embedding(text: Column, dims: int = 768, words: int = 100) -> Column:
    """Sparse unit vector of a text as an array of (bucket, weight), in order of bucket.

    The i-th of the first words of three characters or more adds 1 / (i + 1) at the
    bucket of its md5; the vector then has length one.  A text without words gives none.
    """
    found = F.slice(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)), 1, words)
    parts = F.transform(found, lambda w, i: F.struct((F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % dims).alias("bucket"), (1.0 / (i + 1)).alias("weight")))
    none = F.array().cast("array<struct<bucket: bigint, weight: double>>")
    start = F.struct(F.lit(-1).cast("long").alias("bucket"), F.lit(0.0).alias("weight"), none.alias("done"), F.lit(0.0).alias("squares"))

    def add(have: Column, p: Column) -> Column:
        # sorted by bucket, so a bucket is full when another one comes
        full = F.when(have["bucket"] >= 0, F.array_append(have["done"], F.struct(have["bucket"].alias("bucket"), have["weight"].alias("weight")))).otherwise(have["done"])
        more = F.struct(have["bucket"].alias("bucket"), (have["weight"] + p["weight"]).alias("weight"), have["done"].alias("done"), have["squares"].alias("squares"))
        fresh = F.struct(p["bucket"].alias("bucket"), p["weight"].alias("weight"), full.alias("done"), (have["squares"] + have["weight"] * have["weight"]).alias("squares"))
        return F.when(have["bucket"] == p["bucket"], more).otherwise(fresh)

    def unit(have: Column) -> Column:
        every = F.array_append(have["done"], F.struct(have["bucket"].alias("bucket"), have["weight"].alias("weight")))
        norm = F.sqrt(have["squares"] + have["weight"] * have["weight"])
        return F.when(have["bucket"] < 0, have["done"]).otherwise(F.transform(every, lambda p: F.struct(p["bucket"].alias("bucket"), (p["weight"] / norm).alias("weight"))))

    return F.aggregate(F.array_sort(parts), start, add, unit)
