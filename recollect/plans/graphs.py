"""Registered traversals of the graph of customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import facts, graph
from recollect.plans import questions as asking
from recollect.plans import retrieval as searching
from recollect.plans.catalog import _EDGES, _add, _read, edges
from recollect.plans.conflicts import _TRIPLETS, _fact, _triplets

_BOTH = f"(SELECT source AS x, target AS y FROM {_EDGES} UNION SELECT target, source FROM {_EDGES})"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))


_add(
    "related_entities",
    f"""WITH e AS {_BOTH}, s AS (SELECT 'r' || r_regionkey AS seed FROM region),
  h1 AS (SELECT seed, node FROM (SELECT seed, y AS node, row_number() OVER (PARTITION BY seed ORDER BY y) AS r FROM s JOIN e ON x = seed) WHERE r <= 10),
  h2 AS (SELECT seed, node FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS r FROM (SELECT DISTINCT h1.seed, y AS node FROM h1 JOIN e ON x = h1.node WHERE y <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.seed = h1.seed AND z.node = y))) WHERE r <= 10)
  SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2""",
    lambda spark, d: graph.related(edges(spark, d), _regions(spark, d), 2),
)
_add(
    "reachable_entities",
    f"""WITH RECURSIVE e AS {_BOTH}, r AS (SELECT 'r1' AS node, 0 AS hop UNION SELECT y, hop + 1 FROM r JOIN e ON x = node WHERE hop < 2) SELECT 'r1' AS seed, node, min(hop) AS hop FROM r GROUP BY node""",
    lambda spark, d: graph.reach(edges(spark, d), _regions(spark, d).where("seed = 'r1'"), 2),
)
_add(
    "entity_subgraph",
    f"WITH e AS {_BOTH}, s AS (SELECT 'r' || r_regionkey AS seed FROM region), n AS (SELECT seed, seed AS node FROM s UNION SELECT seed, y FROM s JOIN e ON x = seed) SELECT DISTINCT seed, source, relation, target FROM n JOIN {_EDGES} ON source = node OR target = node",
    lambda spark, d: graph.subgraph(edges(spark, d), _regions(spark, d), 2),
)


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return _read(spark, sf_dir, "customer").select(name.alias("start"), F.concat(F.lit("s"), (F.col("c_custkey") % 10 + 1).cast("string")).alias("end"))


_add(
    "shortest_path",
    f"""WITH RECURSIVE e AS {_BOTH}, p AS (SELECT 'c' || c_custkey AS start, 's' || (c_custkey % 10 + 1) AS goal FROM customer),
  w AS (SELECT start AS start, start AS node, [start] AS path FROM p UNION SELECT w.start, e.y, list_append(path, e.y) FROM w JOIN e ON e.x = w.node WHERE len(path) <= 3 AND NOT list_contains(path, e.y) AND (len(path) < 3 OR EXISTS (SELECT 1 FROM p WHERE p.start = w.start AND p.goal = e.y)) AND (len(path) < 2 OR left(e.y, 1) <> 'c')),
  f AS (SELECT p.start, p.goal, path, row_number() OVER (PARTITION BY p.start, p.goal ORDER BY len(path), path) AS r FROM p JOIN w ON w.start = p.start AND w.node = p.goal)
  SELECT start, goal AS "end", CAST(len(path) - 1 AS INT) AS length, array_to_string(path, ' > ') AS path FROM f WHERE r = 1""",
    lambda spark, d: graph.shortest_path(edges(spark, d), _ends(spark, d), 3).withColumn("path", F.array_join("path", " > ")),
)


def _person_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.facts(spark, sf_dir).where("is_current").select(F.col("fact_id").alias("edge_id"), F.col("subject").alias("source"), F.replace("predicate", F.lit(" "), F.lit("_")).alias("relation"), F.col("object").alias("target"))


def _beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asking.asked(spark, sf_dir).where("query_id % 50 = 0").select("query_id", "q")
    seeds = asked.select("query_id", F.explode(questions.names(F.col("q"))).alias("node"))
    known = _person_edges(spark, sf_dir).select(F.col("source").alias("node")).distinct()
    return graph.beam(_person_edges(spark, sf_dir), asked, seeds.join(known, "node", "left_semi"))


_WORTH = """len(list_intersect(t, e.w)) / (len(t) + 1) + CASE WHEN ((contains(l, 'where') OR contains(l, 'location')) AND relation = 'lives in') OR (contains(l, 'who') AND relation = 'knows') OR (contains(l, 'what') AND contains(l, 'like') AND relation = 'likes') THEN 0.3 ELSE 0 END - CASE WHEN list_contains(visited, e.target) THEN 0.5 ELSE 0 END"""


def _grown_sql(k: int, before: str) -> str:
    return f"""g{k} AS (SELECT query_id, target AS node, list_append(path, fact_id) AS path, list_append(visited, target) AS visited, 0.8 * score + 0.2 * worth AS score FROM (SELECT p.*, e.fact_id, e.target, {_WORTH} AS worth FROM {before} p JOIN a USING (query_id) JOIN e ON e.source = p.node) WHERE worth >= 0.1),
  b{k} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS r FROM g{k}) WHERE r <= 5)"""


_add(
    "coe_beam",
    f"""{searching._BASE}, e AS (SELECT fact_id, subject AS source, predicate AS relation, object AS target, w FROM f WHERE is_current),
  b0 AS (SELECT query_id, n AS node, []::BIGINT[] AS path, [n] AS visited, 1.0::DOUBLE AS score FROM (SELECT query_id, unnest(list_filter({asking._CAPS}, lambda x: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, x))) AS n FROM a) WHERE n IN (SELECT source FROM e)),
  {_grown_sql(1, 'b0')}, {_grown_sql(2, 'b1')}, {_grown_sql(3, 'b2')}, u AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)
  SELECT query_id, array_to_string(path, ' > ') AS path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS r FROM u) WHERE r <= 5""",
    lambda spark, d: _beam(spark, d).select("query_id", F.array_join(F.transform("path", lambda x: x.cast("string")), " > ").alias("path"), F.round("score", 6).alias("score")),
)
_add(
    "similar_entities",
    "SELECT DISTINCT a.n AS name, b.n AS entity, CASE WHEN lower(replace(a.n, '_', ' ')) = lower(replace(b.n, '_', ' ')) THEN 1.0 ELSE 0.8 END AS score FROM (SELECT DISTINCT c_mktsegment AS n FROM customer UNION SELECT 'the ' || lower(c_mktsegment) FROM customer) a JOIN (SELECT DISTINCT initcap AS n FROM (SELECT lower(c_mktsegment) AS initcap FROM customer UNION SELECT 'The ' || c_mktsegment FROM customer)) b ON contains(' ' || lower(a.n) || ' ', ' ' || lower(b.n) || ' ') OR contains(' ' || lower(b.n) || ' ', ' ' || lower(a.n) || ' ')",
    lambda spark, d: (lambda c: graph.similar_entities(c.select(F.explode(F.array("c_mktsegment", F.concat(F.lit("the "), F.lower("c_mktsegment")))).alias("name")), c.select(F.explode(F.array(F.lower("c_mktsegment"), F.concat(F.lit("The "), "c_mktsegment"))).alias("entity"))))(_read(spark, d, "customer")),
)
_fact("triplets_of_entity", f"SELECT fact_id AS triplet_id, CASE WHEN subject = 'C7' THEN 'out' ELSE 'in' END AS direction FROM {_TRIPLETS} WHERE is_current AND (subject = 'C7' OR object = 'C7')", lambda f: facts.triplets_of(_triplets(f), "C7").select("triplet_id", "direction"))
_fact("relationships_for_concept", f"SELECT fact_id AS triplet_id FROM {_TRIPLETS} WHERE subject = 'C7' OR object = '1-URGENT'", lambda f: _triplets(f).where("source = 'C7' or target = '1-URGENT'").select("triplet_id"))
_fact(
    "invalidate_edge", "SELECT fact_id AS triplet_id, is_current AND fact_id % 4 <> 0 AS is_current, CASE WHEN fact_id % 4 = 0 THEN fact_id + 1 END AS invalidated_by FROM FACTS",
    lambda f: facts.invalidate(_triplets(f), f.where("fact_id % 4 = 0").select(F.col("fact_id").alias("triplet_id"), (F.col("fact_id") + 1).alias("by"))).select("triplet_id", "is_current", "invalidated_by"),
)
