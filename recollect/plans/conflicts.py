"""Registered queries about conflicts, over facts and triplets made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import conflicts
from recollect.plans.catalog import _add, _read

_SOURCES = list(conflicts.SOURCE_RANK)


def _cases(column: str, values: list[str], otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


_PREDICATES = ["likes", "Disliked", "lives in", "works at", "enjoys"]
FACTS = f"""(SELECT o_orderkey AS fact_id, 'C' || o_custkey AS subject, {_cases('o_orderkey % 5', _PREDICATES)} AS predicate, o_orderpriority AS object, o_orderdate AS created_at,
  (o_orderkey % 10) / 10.0 AS confidence, o_orderkey % 7 AS access_count, (o_orderkey % 11) / 11.0 AS importance, {_cases('o_orderkey % 7', _SOURCES)} AS source, o_orderkey % 6 <> 0 AS is_current FROM orders)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact of every order: its customer likes, dislikes, lives in ... its priority."""
    k = F.col("o_orderkey")

    def pick(n: int, values: list[str]):
        return F.element_at(F.lit(values), (k % n + 1).cast("int")) if n <= len(values) else F.when(k % n < len(values), F.element_at(F.lit(values), F.least(k % n + 1, F.lit(len(values))).cast("int")))

    return _read(spark, sf_dir, "orders").select(
        k.alias("fact_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("subject"), pick(5, _PREDICATES).alias("predicate"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("created_at"),
        (k % 10 / 10.0).alias("confidence"), (k % 7).alias("access_count"), (k % 11 / 11.0).alias("importance"), pick(7, _SOURCES).alias("source"), (k % 6 != 0).alias("is_current"),
    )


def _fact(name: str, sql: str, build) -> None:
    _add(name, sql.replace("FACTS", FACTS), lambda spark, d: build(facts(spark, d)))


def _triplets(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("fact_id").alias("triplet_id"), F.col("subject").alias("source"), F.when(F.col("predicate") == "Disliked", "dislikes").otherwise(F.replace("predicate", F.lit(" "), F.lit("_"))).alias("relation"), F.col("object").alias("target"), "is_current")


def _pairs_sql(source: str, keys: str, value: str, where: str = "TRUE") -> str:
    """Pairs of first facts of different values of a group."""
    on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
    held = f"(SELECT {keys}, lower(trim({value})) AS v, min(fact_id) AS f, count(*) AS n FROM {source} WHERE {where} GROUP BY {keys}, lower(trim({value})))"
    return f"SELECT {', '.join('x.' + k for k in keys.split(', '))}, x.v AS value_a, y.v AS value_b, x.f AS a, y.f AS b, x.n AS facts_a, y.n AS facts_b FROM {held} x JOIN {held} y ON {on} AND x.f < y.f"


_TRIPLETS = "(SELECT fact_id, subject, CASE predicate WHEN 'Disliked' THEN 'dislikes' ELSE replace(predicate, ' ', '_') END AS relation, object, is_current FROM FACTS)"
_fact(
    "triplet_conflicts",
    f"SELECT subject AS source, a, b, 'exclusive' AS kind FROM ({_pairs_sql(_TRIPLETS, 'subject, relation', 'object', 'is_current AND relation IN (' + repr(conflicts.EXCLUSIVE)[1:-1] + ')')}) UNION ALL SELECT subject, a, b, 'polarity' FROM ({_pairs_sql(_TRIPLETS, 'subject, object', 'relation', 'is_current AND relation IN (' + repr(['likes', 'dislikes'])[1:-1] + ')')})",
    lambda f: conflicts.triplet_conflicts(_triplets(f)),
)
_PREFERS = "predicate IN ('likes', 'Disliked', 'enjoys')"
_fact("preference_conflicts", _pairs_sql("FACTS", "subject, predicate", "object", _PREFERS), lambda f: conflicts.value_conflicts(f.where(_PREFERS), ["subject", "predicate"], "object"))
_fact("fact_inconsistency", _pairs_sql("FACTS", "subject, predicate", "object"), lambda f: conflicts.value_conflicts(f, ["subject", "predicate"], "object"))
_NEG = " UNION ALL ".join(f"SELECT k, id, {i} AS pattern, contains(t, '{p}') AS yes, contains(t, '{n}') AS no FROM t" for i, (p, n) in enumerate(conflicts.NEGATIONS))


def _negations(table: str, key: str, block: str) -> str:
    return f"""WITH t AS (SELECT {block} AS k, {key} AS id, lower(coalesce(text, '')) AS t FROM {table}), s AS ({_NEG})
  SELECT k AS block, pattern, min(id) FILTER (yes AND NOT no) AS a, min(id) FILTER (no) AS b, count(*) FILTER (yes AND NOT no) AS positives, count(*) FILTER (no) AS negatives FROM s GROUP BY k, pattern
  HAVING count(*) FILTER (yes AND NOT no) > 0 AND count(*) FILTER (no) > 0"""


_SAYS = "(SELECT *, lower(predicate) || ' ' || object AS says FROM FACTS)"
_OUTDATED = f"""WITH f AS (SELECT *, list_distinct(string_split(lower(says), ' ')) AS w, row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, fact_id DESC) AS r FROM {_SAYS})
  SELECT o.subject, o.fact_id AS a, n.fact_id AS b, CAST(floor((epoch(n.created_at) - epoch(o.created_at)) / 86400) AS INT) AS days FROM f o JOIN f n ON n.subject = o.subject AND n.r = 1 AND o.r > 1
  WHERE floor((epoch(n.created_at) - epoch(o.created_at)) / 86400) >= 30 AND len(list_intersect(o.w, n.w)) / len(list_distinct(list_concat(o.w, n.w))) < 0.8"""


def _outdated(f: DataFrame) -> DataFrame:
    said = f.withColumn("says", F.concat(F.lower("predicate"), F.lit(" "), "object"))
    return conflicts.temporal_outdated(said, ["subject"], "created_at", "says", "fact_id")


_fact("temporal_outdated", _OUTDATED, _outdated)
_NORMAL = "CASE lower(predicate) WHEN 'disliked' THEN 'dislikes' ELSE lower(predicate) END"
_fact(
    "conflict_candidates",
    f"""WITH f AS (SELECT fact_id, subject, {_NORMAL} AS p, object, is_current FROM FACTS)
  SELECT n.fact_id AS new_id, o.fact_id FROM f n JOIN f o ON o.subject = n.subject AND o.fact_id <> n.fact_id WHERE n.fact_id % 9 = 0 AND o.is_current AND o.fact_id % 9 <> 0
    AND (n.p = o.p OR (n.p IN ('likes', 'enjoys') AND o.p = 'dislikes') OR (o.p IN ('likes', 'enjoys') AND n.p = 'dislikes') OR n.object = o.object)""",
    lambda f: conflicts.conflict_candidates(f.where("fact_id % 9 = 0"), f.where("fact_id % 9 <> 0")),
)
_fact(
    "check_new_vs_existing",
    "SELECT DISTINCT n.fact_id AS new_id, n.object AS new_object, o.object AS old_object FROM FACTS n JOIN FACTS o ON o.subject = n.subject AND o.predicate = n.predicate AND o.object <> n.object WHERE n.fact_id % 9 = 0 AND o.fact_id % 9 <> 0",
    lambda f: f.where("fact_id % 9 = 0").select("subject", "predicate", F.col("fact_id").alias("new_id"), F.col("object").alias("new_object")).join(f.where("fact_id % 9 <> 0").select("subject", "predicate", F.col("object").alias("old_object")).distinct(), ["subject", "predicate"]).where("new_object <> old_object").select("new_id", "new_object", "old_object").distinct(),
)


def _said(f: DataFrame) -> DataFrame:
    """What subjects like and dislike, as sentences."""
    predicate = conflicts.normalise_predicate(F.col("predicate"))
    return f.where(predicate.isin("likes", "dislikes")).select(F.col("fact_id").alias("id"), F.col("subject").alias("block"), F.concat_ws(" ", F.lower("subject"), predicate, "object").alias("text"))


def detected(f: DataFrame) -> DataFrame:
    """The conflicts of all detectors over one table of facts."""
    inconsistent = conflicts.typed(conflicts.value_conflicts(f, ["subject", "predicate"], "object"), "fact_inconsistency")
    negated = conflicts.typed(conflicts.negation_pairs(_said(f), ["block"]), "direct_contradiction")
    return inconsistent.unionByName(negated).unionByName(conflicts.typed(_outdated(f), "temporal_outdated")).unionByName(conflicts.typed(conflicts.value_conflicts(f.where(_PREFERS), ["subject", "predicate"], "object"), "preference_conflict"))


_SAID_NEG = _negations("(SELECT fact_id, subject, lower(subject) || ' ' || " + _NORMAL + " || ' ' || object AS text FROM FACTS WHERE " + _NORMAL + " IN ('likes', 'dislikes'))", "fact_id", "subject")
_fact("negation_pairs", _SAID_NEG, lambda f: conflicts.negation_pairs(_said(f), ["block"]))
_DETECTED = f"""(SELECT a, b, 'fact_inconsistency' AS type, 'medium' AS severity, 0.9::DOUBLE AS confidence, TRUE AS auto FROM ({_pairs_sql('FACTS', 'subject, predicate', 'object')})
  UNION ALL SELECT a, b, 'direct_contradiction', 'high', 0.85, FALSE FROM ({_SAID_NEG}) UNION ALL SELECT a, b, 'temporal_outdated', 'low', 0.6, TRUE FROM ({_OUTDATED})
  UNION ALL SELECT a, b, 'preference_conflict', 'medium', 0.8, TRUE FROM ({_pairs_sql('FACTS', 'subject, predicate', 'object', _PREFERS)}))"""
_fact("detect_conflicts", f"SELECT * FROM {_DETECTED}", detected)
_STRATEGY = "CASE type WHEN 'fact_inconsistency' THEN 'confidence' WHEN 'direct_contradiction' THEN 'user_guided' ELSE 'recency' END"
_fact("choose_strategy", f"SELECT a, b, type, {_STRATEGY} AS strategy FROM {_DETECTED}", lambda f: detected(f).select("a", "b", "type", conflicts.choose_strategy(F.col("type"), F.col("severity")).alias("strategy")))
_fact(
    "conflict_stats",
    f"SELECT coalesce(type, 'all') AS type, count(*) AS n, count(*) FILTER (auto) AS auto FROM {_DETECTED} GROUP BY ROLLUP (type)",
    lambda f: detected(f).rollup("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("auto").alias("auto")).withColumn("type", F.coalesce("type", F.lit("all"))),
)
_fact(
    "conflicts_for_memory", f"SELECT a, b, type FROM {_DETECTED} WHERE a IN (SELECT fact_id FROM FACTS WHERE importance = 0) OR b IN (SELECT fact_id FROM FACTS WHERE importance = 0)",
    lambda f: (lambda c, m: c.join(m, (c["a"] == m["fact_id"]), "left_semi").select("a", "b", "type").union(c.join(m, c["a"] == m["fact_id"], "left_anti").join(m, F.col("b") == m["fact_id"], "left_semi").select("a", "b", "type")))(detected(f), f.where("importance = 0").select("fact_id")),
)
_DAYS = "abs(floor((epoch(x.created_at) - epoch(y.created_at)) / 86400))"
_RANK = {s: f"(CASE {s}.source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in conflicts.SOURCE_RANK.items()) + " ELSE 0 END)" for s in "xy"}
_WINS = {
    "recency": ("x.created_at > y.created_at", f"least(0.95, 0.5 + 0.01 * {_DAYS})"),
    "confidence": ("x.confidence >= y.confidence", "least(0.9, 0.5 + abs(x.confidence - y.confidence))"),
    "source": (f"{_RANK['x']} >= {_RANK['y']}", f"0.75 + 0.05 * abs({_RANK['x']} - {_RANK['y']})"),
    "frequency": ("x.access_count >= y.access_count", "0.6 + least(0.3, 0.05 * abs(x.access_count - y.access_count))"),
    "importance": ("x.importance >= y.importance", "least(0.95, 0.6 + abs(x.importance - y.importance))"),
}
_CLASH = _pairs_sql("FACTS", "subject, predicate", "object")


def _resolved_sql(wins: str, confidence: str, strategy: str, pairs: str) -> str:
    return f"""SELECT a, b, {strategy} AS strategy, CASE WHEN {wins} THEN 'keep_a' ELSE 'keep_b' END AS action, CASE WHEN {wins} THEN a ELSE b END AS winner, CASE WHEN {wins} THEN b ELSE a END AS loser, round(CAST({confidence} AS DOUBLE), 6) AS confidence
  FROM ({pairs}) p JOIN FACTS x ON x.fact_id = p.a JOIN FACTS y ON y.fact_id = p.b"""


for _name, (_first, _sure) in _WINS.items():
    _fact(
        f"resolve_by_{_name}", _resolved_sql(_first, _sure, f"'{_name}'", _CLASH),
        lambda f, s=_name: conflicts.resolve(conflicts.value_conflicts(f, ["subject", "predicate"], "object"), f, s).withColumn("confidence", F.round("confidence", 6)),
    )
_RESOLVED = f"""(SELECT a, b, s AS strategy, CASE s WHEN 'user_guided' THEN 'defer' WHEN 'confidence' THEN {'CASE WHEN x.confidence >= y.confidence THEN ' + "'keep_a' ELSE 'keep_b' END"} ELSE {'CASE WHEN x.created_at > y.created_at THEN ' + "'keep_a' ELSE 'keep_b' END"} END AS action,
  round(CAST(CASE s WHEN 'user_guided' THEN 0 WHEN 'confidence' THEN {_WINS['confidence'][1]} ELSE {_WINS['recency'][1]} END AS DOUBLE), 6) AS confidence
  FROM (SELECT *, {_STRATEGY} AS s FROM {_DETECTED}) p JOIN FACTS x ON x.fact_id = p.a JOIN FACTS y ON y.fact_id = p.b)"""


def _resolved(f: DataFrame) -> DataFrame:
    chosen = detected(f).withColumn("strategy", conflicts.choose_strategy(F.col("type"), F.col("severity")))
    return conflicts.resolve(chosen, f).withColumn("confidence", F.round("confidence", 6))


_fact("resolve_conflicts", f"SELECT *, CASE action WHEN 'keep_a' THEN a WHEN 'keep_b' THEN b END AS winner, CASE action WHEN 'keep_a' THEN b WHEN 'keep_b' THEN a END AS loser FROM {_RESOLVED}", _resolved)
_fact(
    "apply_resolutions",
    f"SELECT fact_id, 'kept' AS status FROM FACTS WHERE fact_id NOT IN (SELECT CASE action WHEN 'keep_a' THEN b ELSE a END FROM {_RESOLVED} WHERE action <> 'defer')",
    lambda f: conflicts.apply_resolutions(f, _resolved(f)).select("fact_id", "status"),
)
_fact(
    "resolve_batch",
    f"SELECT a, b, type FROM {_DETECTED} WHERE auto AND severity IN ('low', 'medium') ORDER BY CASE severity WHEN 'low' THEN 0 ELSE 1 END, type, a, b LIMIT 50",
    lambda f: detected(f).where("auto and severity in ('low', 'medium')").orderBy(conflicts.severity_rank(F.col("severity")), "type", "a", "b").limit(50).select("a", "b", "type"),
)
_AXIS = f"""SELECT *, CASE WHEN p IN ('lives in', 'works at') THEN p WHEN p IN ('likes', 'enjoys', 'dislikes') THEN 'dislikes:' || object ELSE p || ':' || object END AS axis,
  CASE WHEN p IN ('lives in', 'works at') THEN object WHEN p = 'dislikes' THEN 'no' ELSE 'yes' END AS v FROM (SELECT fact_id, subject, lower(object) AS object, created_at, {_NORMAL} AS p FROM FACTS)"""
_fact(
    "fact_conflicts_v4",
    f"""WITH a AS ({_AXIS}), l AS (SELECT *, lag(v) OVER (PARTITION BY subject, axis ORDER BY created_at, fact_id) AS prior FROM a), k AS (SELECT * FROM l WHERE prior IS NULL OR prior <> v),
  c AS (SELECT fact_id, lag(fact_id) OVER w AS supersedes, lead(fact_id) OVER w AS superseded_by FROM k WINDOW w AS (PARTITION BY subject, axis ORDER BY created_at, fact_id))
  SELECT fact_id, CASE WHEN supersedes IS NULL THEN 'new' ELSE 'supersedes' END AS outcome, supersedes, superseded_by, superseded_by IS NULL AS is_current FROM c
  UNION ALL SELECT fact_id, 'duplicate', NULL, NULL, FALSE FROM l WHERE prior = v""",
    lambda f: conflicts.fold_updates(f, ["created_at", "fact_id"]),
)
