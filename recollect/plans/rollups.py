"""Registered rollups of a graph of suppliers and parts out of line items, and of facts about orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import rollups
from recollect.plans.catalog import _ORDERS, _add, _history, _read

ORDER = ["l_orderkey", "l_linenumber"]
_TRIPLETS = """(SELECT 'Supplier_' || l_suppkey AS source, CASE l_returnflag WHEN 'R' THEN 'took_back' ELSE 'delivers' END AS relation, 'Part ' || l_partkey AS target, l_discount AS confidence, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_shipdate, l_linestatus = 'O' AS is_current FROM lineitem)"""


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, relation, target, confidence, properties, is_current, ...) of every line item."""
    rows, text = _read(spark, sf_dir, "lineitem"), lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    properties = F.create_map(F.lit("status"), F.col("l_linestatus"), F.concat(F.lit("flag_"), "l_returnflag"), F.col("l_linenumber").cast("string"))
    return rows.select(
        text("Supplier_", "l_suppkey").alias("source"), F.when(F.col("l_returnflag") == "R", "took_back").otherwise("delivers").alias("relation"), text("Part ", "l_partkey").alias("target"), F.col("l_discount").alias("confidence"), properties.alias("properties"),
        (F.col("l_linestatus") == "O").alias("is_current"), "l_orderkey", "l_linenumber", "l_shipdate", F.lit("supplier").alias("source_kind"), F.when(F.col("l_linenumber") % 2 == 0, "part").otherwise("article").alias("target_kind"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = triplets(spark, sf_dir)
    other = F.when(F.col("l_linenumber") % 3 == 0, F.upper(F.replace("target", F.lit(" "), F.lit("_")))).otherwise(F.col("target"))
    return t.select(F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_kind").alias("kind"), F.lit(0).alias("side")), F.struct(other.alias("name"), F.col("target_kind").alias("kind"), F.lit(1).alias("side")))).alias("m"), *ORDER).select("m.*", *ORDER)


_add(
    "entity_rollup",
    f"""WITH m AS (SELECT source AS name, 'supplier' AS kind, 0 AS side, l_orderkey AS o, l_linenumber AS l FROM {_TRIPLETS} UNION ALL SELECT CASE WHEN l_linenumber % 3 = 0 THEN upper(replace(target, ' ', '_')) ELSE target END, CASE WHEN l_linenumber % 2 = 0 THEN 'part' ELSE 'article' END, 1, l_orderkey, l_linenumber FROM {_TRIPLETS})
  SELECT lower(trim(replace(name, '_', ' '))) AS name, arg_min(name, (o, l, side, name, kind)) AS spelling, arg_min(kind, (o, l, side, name, kind)) AS kind, count(*) AS mentions FROM m GROUP BY 1""",
    lambda spark, d: rollups.entity_rollup(mentions(spark, d), [*ORDER, "side"]),
)
_add(
    "relation_rollup",
    f"""WITH t AS {_TRIPLETS}, e AS (SELECT source, relation, target, 'status' AS k, l_linestatus AS v, l_orderkey AS o, l_linenumber AS l FROM t UNION ALL SELECT source, relation, target, 'flag_' || l_returnflag, CAST(l_linenumber AS VARCHAR), l_orderkey, l_linenumber FROM t),
  p AS (SELECT source, relation, target, string_agg(k || '=' || v, ';' ORDER BY k) AS properties FROM (SELECT source, relation, target, k, arg_max(v, (o, l, v)) AS v FROM e GROUP BY ALL) GROUP BY ALL),
  h AS (SELECT source, relation, target, max(confidence) AS confidence, count(*) AS n FROM t GROUP BY ALL) SELECT source, relation, target, confidence, properties, n FROM h JOIN p USING (source, relation, target)""",
    lambda spark, d: rollups.relation_rollup(triplets(spark, d), ORDER).withColumn("properties", F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")),
)
_add(
    "triplet_rollup",
    f"SELECT source, relation, target, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_shipdate, (l_orderkey, l_linenumber, l_shipdate)) AS l_shipdate, count(*) AS n FROM {_TRIPLETS} GROUP BY source, relation, target",
    lambda spark, d: rollups.triplet_rollup(triplets(spark, d), ORDER, ["l_orderkey", "l_shipdate"]),
)
_add(
    "graph_stats",
    f"""WITH t AS {_TRIPLETS}, e AS (SELECT source AS name, 'supplier' AS kind FROM t UNION SELECT target, CASE WHEN l_linenumber % 2 = 0 THEN 'part' ELSE 'article' END FROM t)
  SELECT 'entity' AS part, coalesce(kind, 'all') AS kind, count(*) AS n FROM e GROUP BY ROLLUP (kind) UNION ALL SELECT 'relation', coalesce(relation, 'all'), count(*) FROM t GROUP BY ROLLUP (relation) UNION ALL SELECT 'current', coalesce(relation, 'all'), count(*) FROM t WHERE is_current GROUP BY ROLLUP (relation)""",
    lambda spark, d: rollups.graph_stats(triplets(spark, d)),
)
_add(
    "merge_facts",
    f"""WITH f AS (SELECT *, fact_id % 3 + 1 AS evidence, 'clerk ' || fact_id % 5 AS clerk, 'desk ' || fact_id % 2 AS desk FROM {_ORDERS}), s AS (SELECT subject, object, string_agg(s, '|' ORDER BY s) AS sources FROM (SELECT subject, lower(object) AS object, clerk AS s FROM f UNION SELECT subject, lower(object), desk FROM f) GROUP BY ALL),
  h AS (SELECT subject, lower(object) AS object, arg_min(fact_id, (dated, fact_id)) AS fact_id, CAST(sum(evidence) AS BIGINT) AS evidence, round(least(1.0, 0.5 + 0.1 * (count(*) - 1)), 6) AS confidence FROM f GROUP BY subject, lower(object))
  SELECT CAST(subject AS VARCHAR) AS subject, 'status' AS predicate, object, fact_id, evidence, confidence, sources FROM h JOIN s USING (subject, object)""",
    lambda spark, d: rollups.merge_facts(
        _history(spark, d).withColumns({"predicate": F.lit("status"), "confidence": F.lit(0.5), "evidence": F.col("fact_id") % 3 + 1, "sources": F.array(F.concat(F.lit("clerk "), (F.col("fact_id") % 5).cast("string")), F.concat(F.lit("desk "), (F.col("fact_id") % 2).cast("string")))}), ["dated", "fact_id"]
    ).withColumns({"confidence": F.round("confidence", 6), "sources": F.array_join("sources", "|")}),
)
