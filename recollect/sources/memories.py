"""The stored form of memories, with nested parts as JSON text, and its typed reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMPORTANCE = "score double, novelty double, causal double, emotional double, frequency double"
METADATA = "user_id long, scope string, source string, tags array<string>"
#: What a memory of each type has besides.
TYPES = {
    "short_term": "items array<struct<role: string, content: string>>, max_items long, session_id string, current_task_id string",
    "episodic": "episodes array<struct<event_type: string, description: string, success: boolean>>, narrative string, lessons_learned array<string>",
    "semantic": "facts array<struct<subject: string, predicate: string, object: string, confidence: double>>, knowledge_domain string, overall_confidence double",
    "long_term": "derived_from array<long>, episode_count long",
}
_BAD = "_corrupt"


def pack_memories(memories: DataFrame) -> DataFrame:
    """Memories with ``importance``, ``metadata`` and a column for each type packed into JSON text, flags as 0 and 1.

    Only the memory's own type is packed; nulls inside are left out.
    """
    data = F.coalesce(*[F.when(F.col("memory_type") == t, F.to_json(t)) for t in TYPES], F.lit("{}"))
    nested = ["importance", "metadata", *TYPES]
    flags = [c for c, kind in memories.dtypes if kind == "boolean"]
    rest = [F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in memories.columns if c not in nested]
    return memories.select(*rest, F.to_json("importance").alias("importance_json"), F.to_json("metadata").alias("metadata_json"), data.alias("type_data_json"))


def read_memories(rows: DataFrame) -> DataFrame:
    """The typed form of stored memories: importance, metadata and a column for each type, null for other types.

    ``corrupt`` lists the JSON columns of a row that cannot be read; their typed columns are null there, and the row stays.
    A null or empty JSON text is an empty object.  Flags become boolean.  Other columns stay as they are.
    """
    def parsed(column: str, schema: str):
        text = F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.lit("{}")).otherwise(F.col(column))
        return F.from_json(text, f"{schema}, {_BAD} string", {"columnNameOfCorruptRecord": _BAD, "mode": "PERMISSIVE"})

    def typed(name: str, schema: str):
        fields = [p.split(" ")[0] for p in _fields(schema)]
        return F.when(F.col(f"{name}.{_BAD}").isNull(), F.struct(*[F.col(f"{name}.{f}").alias(f) for f in fields]))

    schemas = {"importance": ("importance_json", IMPORTANCE), "metadata": ("metadata_json", METADATA)} | {t: ("type_data_json", s) for t, s in TYPES.items()}
    out = rows.withColumns({name: parsed(column, schema) for name, (column, schema) in schemas.items()})
    own = lambda t: F.col("memory_type") == t
    bad = [F.when(F.col(f"importance.{_BAD}").isNotNull(), "importance_json"), F.when(F.col(f"metadata.{_BAD}").isNotNull(), "metadata_json"), *[F.when(own(t) & F.col(f"{t}.{_BAD}").isNotNull(), "type_data_json") for t in TYPES]]
    out = out.withColumn("corrupt", F.array_compact(F.array(*bad)))
    values = {name: typed(name, schema) if name not in TYPES else F.when(own(name), typed(name, schema)) for name, (_, schema) in schemas.items()}
    flags = [c for c in ("has_embedding", "is_active", "is_consolidated") if c in rows.columns]
    out = out.withColumns({c: F.col(c).cast("boolean") for c in flags} | values)
    return out.drop("importance_json", "metadata_json", "type_data_json")


def _fields(schema: str) -> list[str]:
    """The top fields of a schema text."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]
