"""Registered searches: questions of customers over facts about customers, and benchmark items over documents.

The questions are those whose id is divisible by 50, against all facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import intents, lexicons, questions, scores
from recollect.functions.tokens import tokens
from recollect.operators import joins, retrieval
from recollect.plans import questions as asking
from recollect.plans.catalog import _OVER, _TOK, _add, _mention_sql, _overlaps, _read

_NEXT_SQL = "upper('z') || translate(CAST(query_id + 1 AS VARCHAR), '0123456789', 'abcdefghij')"
_FACT_SQL = f"""(SELECT *, fact_id % 7 <> 0 AS is_current FROM (SELECT query_id * 3 AS fact_id, who AS subject, 'lives in' AS predicate, place AS object, 'location' AS fact_type FROM {asking.PEOPLE}
  UNION ALL SELECT query_id * 3 + 1, who, 'likes', thing, 'preference' FROM {asking.PEOPLE} UNION ALL SELECT query_id * 3 + 2, who, 'knows', {_NEXT_SQL}, 'relationship' FROM {asking.PEOPLE}))"""
_STATE_SQL = f"(SELECT -query_id - 1 AS fact_id, who AS subject, 'moved from ' || place || ' ' || (query_id % 9 + 1) || ' years ago' AS description FROM {asking.PEOPLE})"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each customer lives, what it likes and whom it knows."""
    k = F.col("query_id")
    after = F.concat(F.lit("Z"), F.translate((k + 1).cast("string"), "0123456789", "abcdefghij"))
    three = F.array(*[F.struct((k * 3 + i).alias("fact_id"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(t).alias("fact_type")) for i, (p, o, t) in enumerate((("lives in", F.col("place"), "location"), ("likes", F.col("thing"), "preference"), ("knows", after, "relationship")))])
    rows = asking.people(spark, sf_dir).select(F.col("who").alias("subject"), F.explode(three).alias("f")).select("subject", "f.*")
    return rows.withColumn("is_current", F.col("fact_id") % 7 != 0)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("query_id")
    return asking.people(spark, sf_dir).select((-k - 1).alias("fact_id"), F.col("who").alias("subject"), F.concat(F.lit("moved from "), "place", F.lit(" "), (k % 9 + 1).cast("string"), F.lit(" years ago")).alias("description"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.asked(spark, sf_dir).where("query_id % 50 = 0").select("query_id", "q")


_OWN = f"list_has_any(string_split(l, ' '), {asking._list_sql(questions.SELF)})"
_BASE = f"""WITH a AS MATERIALIZED (SELECT query_id, q, l, list_distinct(string_split(l, ' ')) AS t, {asking._ENTITIES} AS es FROM {asking.ASKED} WHERE query_id % 50 = 0),
f AS MATERIALIZED (SELECT *, list_distinct(string_split(lower(subject || ' ' || predicate || ' ' || object), ' ')) AS w FROM {_FACT_SQL}), st AS MATERIALIZED (SELECT * FROM {_STATE_SQL}),
fact_hits AS (SELECT query_id, fact_id, len(list_intersect(t, w)) / (len(t) + 1) + CASE WHEN contains(l, lower(subject)) THEN 0.3 ELSE 0 END + CASE WHEN contains(l, predicate) THEN 0.2 ELSE 0 END AS score FROM a JOIN f ON list_has_any(t, w) WHERE is_current),
kw AS (SELECT *, list_concat(list_filter(t, lambda x: NOT list_contains({asking._list_sql(retrieval.STOP_WORDS)}, x)), CASE WHEN {_OWN} THEN ['user'] ELSE [] END) AS k FROM a),
keyword AS (SELECT query_id, fact_id, len(list_intersect(k, w)) / len(k) + CASE WHEN contains(l, lower(subject)) THEN 0.4 ELSE 0 END + CASE WHEN len(list_filter(k, lambda x: contains(lower(object), x))) > 0 THEN 0.2 ELSE 0 END AS score FROM kw JOIN f ON list_has_any(k, w) WHERE is_current),
entity AS (SELECT query_id, fact_id, 0.3 + 0.2 * len(list_intersect(es, list_distinct([lower(subject), lower(object)]))) AS score FROM a JOIN f ON list_has_any(es, [lower(subject), lower(object)]) WHERE is_current),
near AS (SELECT DISTINCT query_id, unnest(CASE WHEN list_contains(es, lower(subject)) AND list_contains(es, lower(object)) THEN [lower(subject), lower(object)] WHEN list_contains(es, lower(subject)) THEN [lower(object)] ELSE [lower(subject)] END) AS e, es FROM a JOIN f ON list_has_any(es, [lower(subject), lower(object)])),
graph AS (SELECT DISTINCT query_id, fact_id, 0.25 AS score FROM near JOIN f ON lower(subject) = e OR lower(object) = e WHERE is_current AND NOT list_contains(es, e)),
names AS (SELECT *, list_filter({asking._CAPS}, lambda x: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, x))[1] AS who FROM a WHERE {asking._any_sql(questions.FLAGS['temporal'])}),
temporal AS (SELECT query_id, fact_id, 0.5 + 0.1 * len(list_intersect(t, list_distinct(string_split(lower(description), ' ')))) AS score FROM names JOIN st ON lower(subject) = lower(who))"""


def _top_sql(table: str, k: int) -> str:
    return f"SELECT query_id, fact_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fact_id) AS rank FROM {table}) WHERE rank <= {k}"


def _search(name: str, table: str, k: int, how) -> None:
    _add(name, f"{_BASE} SELECT query_id, fact_id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM ({_top_sql(table, k)})", lambda spark, d: how(spark, d).withColumn("score", F.round(F.col("score").cast("double"), 6)))


_search("search_facts_v4", "fact_hits", 20, lambda spark, d: retrieval.search_facts(_questions(spark, d), facts(spark, d)))
_search("search_keyword_v4", "keyword", 40, lambda spark, d: retrieval.search_keyword(_questions(spark, d), facts(spark, d)))
_search("search_entity_v4", "entity", 40, lambda spark, d: retrieval.search_entity(_questions(spark, d), facts(spark, d)))
_search("two_hop_facts", "graph", 20, lambda spark, d: retrieval.search_graph(_questions(spark, d), facts(spark, d)))
_search("search_temporal_v4", "temporal", 40, lambda spark, d: retrieval.search_states(_questions(spark, d), states(spark, d)))
_FUSED = f"""fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY o, rank) AS r FROM (
  SELECT *, 'keyword' AS signal, 0 AS o FROM ({_top_sql('keyword', 40)}) UNION ALL SELECT *, 'entity', 1 FROM ({_top_sql('entity', 40)}) UNION ALL SELECT *, 'graph', 2 FROM ({_top_sql('graph', 20)}) UNION ALL SELECT *, 'temporal', 3 FROM ({_top_sql('temporal', 40)}))) WHERE r = 1),
typed AS (SELECT fused.*, coalesce(fact_type, 'unknown') AS fact_type FROM fused LEFT JOIN f USING (fact_id)),
boosted AS (SELECT * EXCLUDE (score, rank), score + CASE WHEN row_number() OVER (PARTITION BY query_id, fact_type ORDER BY o, rank) = 1 THEN 0.1 ELSE 0 END AS score FROM typed),
retrieved AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fact_id) AS rank FROM boosted) WHERE rank <= 20)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, f = _questions(spark, sf_dir), facts(spark, sf_dir)
    return retrieval.fuse_signals({"keyword": retrieval.search_keyword(a, f), "entity": retrieval.search_entity(a, f), "graph": retrieval.search_graph(a, f), "temporal": retrieval.search_states(a, states(spark, sf_dir))})


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieve(_questions(spark, sf_dir), facts(spark, sf_dir), states(spark, sf_dir))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = facts(spark, sf_dir), states(spark, sf_dir)
    return f.select("fact_id", retrieval.statement(f).alias("line")).unionByName(s.select("fact_id", F.concat_ws(" ", "subject", "description").alias("line")))


_add("fuse_signals", f"{_BASE}, {_FUSED} SELECT query_id, fact_id, signal, round(CAST(score AS DOUBLE), 6) AS score FROM fused", lambda spark, d: _fused(spark, d).select("query_id", "fact_id", "signal", F.round(F.col("score").cast("double"), 6).alias("score")))
_add("retrieve_multi_angle", f"{_BASE}, {_FUSED} SELECT query_id, fact_id, signal, fact_type, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INT) AS rank FROM retrieved", lambda spark, d: _retrieved(spark, d).withColumn("score", F.round(F.col("score").cast("double"), 6)))
_LINE = "coalesce(f.subject || ' ' || f.predicate || ' ' || f.object, st.subject || ' ' || st.description)"
_add(
    "build_context",
    f"""{_BASE}, {_FUSED}, said AS (SELECT query_id, rank, signal = 'temporal' AS part, '- ' || {_LINE} AS line FROM retrieved LEFT JOIN f USING (fact_id) LEFT JOIN st ON st.fact_id = retrieved.fact_id),
  parts AS (SELECT query_id, part, CASE WHEN part THEN 'TEMPORAL INFORMATION:' ELSE 'FACTS:' END || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS text FROM said GROUP BY query_id, part)
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY part) AS context FROM parts GROUP BY query_id""",
    lambda spark, d: retrieval.build_context(_retrieved(spark, d), _lines(spark, d)),
)
_HOPS = f"""hops AS (SELECT query_id, unnest(d) AS part, unnest(range(0, len(d))) AS hop FROM (SELECT query_id, (CASE {asking._PARTS_SQL}
  WHEN contains(l, ' and ') AND length(q) > 30 AND len({asking._HALVES}) = 2 AND len(list_filter({asking._HALVES}, lambda p: length(p) > 10)) = 2 THEN {{'kind': 'multi-hop', 'reasoning': TRUE, 'parts': list_transform({asking._HALVES}, lambda p: rtrim(p, '?') || '?')}} ELSE {{'kind': 'simple', 'reasoning': FALSE, 'parts': [q]}} END).parts[1:4] AS d FROM a)),
hop_hits AS (SELECT query_id, hop, part, fact_id, len(list_intersect(list_distinct(string_split(lower(part), ' ')), w)) / (len(list_distinct(string_split(lower(part), ' '))) + 1) + CASE WHEN contains(lower(part), lower(subject)) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(part), predicate) THEN 0.2 ELSE 0 END AS score
  FROM hops JOIN f ON list_has_any(string_split(lower(part), ' '), w) WHERE is_current),
hop_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, hop ORDER BY round(score, 6) DESC, fact_id) AS rank FROM hop_hits) WHERE rank <= 5),
path AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY hop) AS r FROM hop_top) WHERE r = 1)"""


def _path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.multi_hop(_questions(spark, sf_dir), facts(spark, sf_dir))


_add("multi_hop_retrieve", f"{_BASE}, {_HOPS} SELECT query_id, CAST(hop AS INT) AS hop, part AS sub_query, fact_id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INT) AS rank FROM path", lambda spark, d: _path(spark, d).withColumn("score", F.round(F.col("score").cast("double"), 6)))
_add("hop_confidence", f"{_BASE}, {_HOPS} SELECT query_id, CAST(hop AS INT) AS hop, round(CAST(least(1.0, avg(score) * CASE WHEN count(*) >= 3 THEN 1.1 ELSE 1 END) AS DOUBLE), 6) AS confidence, count(*) AS rows FROM path GROUP BY query_id, hop".replace("AS rows", 'AS "rows"'), lambda spark, d: retrieval.hop_confidence(_path(spark, d), ["query_id", "hop"]).withColumn("confidence", F.round("confidence", 6)))
_add("evidence_confidence", f"{_BASE}, {_HOPS} SELECT query_id, round(CAST(sum(score * (1 + hop * 0.5)) / sum(1 + hop * 0.5) AS DOUBLE), 6) AS confidence FROM path GROUP BY query_id", lambda spark, d: retrieval.evidence_confidence(_path(spark, d), ["query_id"]).withColumn("confidence", F.round("confidence", 6)))
_add(
    "explain_path",
    f"""{_BASE}, {_HOPS}, e AS (SELECT query_id, hop, part, left(string_agg(f.subject || ' ' || f.predicate || ' ' || f.object, ' | ' ORDER BY rank), 200) AS line FROM path JOIN f USING (fact_id) GROUP BY query_id, hop, part)
  SELECT query_id, string_agg('Hop ' || (hop + 1) || ': ' || part || ' -> ' || line, chr(10) ORDER BY hop) AS path FROM e GROUP BY query_id""",
    lambda spark, d: retrieval.explain_path(_path(spark, d), _lines(spark, d)),
)
_add(
    "answer_confidence",
    f"""{_BASE}, {_FUSED}, n AS (SELECT query_id, avg(least(1.0, score)) AS s, count(*) AS n FROM retrieved GROUP BY query_id), c AS (SELECT a.query_id, n.n, 0.5 * s + 0.3 * least(1.0, n.n / 3) + 0.2 * least(1.0, len(string_split(q, ' ')) / 10) AS c FROM n JOIN a USING (query_id))
  SELECT query_id, round(CAST(least(1.0, c) AS DOUBLE), 6) AS confidence, CASE WHEN least(1.0, c) >= 0.7 AND n >= 2 THEN 'high' WHEN least(1.0, c) >= 0.5 AND n >= 1 THEN 'medium' WHEN least(1.0, c) >= 0.3 THEN 'low' ELSE 'none' END AS quality FROM c""",
    lambda spark, d: _retrieved(spark, d).groupBy("query_id").agg(F.avg(F.least(F.lit(1.0), "score")).alias("s"), F.count(F.lit(1)).alias("n")).join(_questions(spark, d), "query_id")
    .withColumn("c", retrieval.answer_confidence(F.col("s"), F.col("n"), F.col("q"))).select("query_id", F.round("c", 6).alias("confidence"), retrieval.answer_quality(F.col("c"), F.col("n")).alias("quality")),
)

# ---- benchmark items over documents by tier (the language), aged by their id

_TIER = "CASE lang WHEN 'en' THEN 'semantic' WHEN 'de' THEN 'episodic' ELSE 'short_term' END"
_SALIENCE = f"greatest(0.1, least(1.0, 0.2 * {_mention_sql(lexicons.HIGH_EMOTION)} + 0.1 * {_mention_sql(lexicons.MEDIUM_EMOTION)}))"
_PLAN = {n: "CASE intent " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, (_, w) in intents.PROFILES.items()) + " END" for i, n in enumerate(("recency", "importance", "similarity"))}
_TIERS = "CASE intent " + " ".join(f"WHEN '{k}' THEN {asking._list_sql(t)}" for k, (t, _) in intents.PROFILES.items()) + " END"
_TERMS = f"list_filter(regexp_split_to_array(l, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({asking._list_sql(questions.STOP_TERMS)}, w))[1:10]"
_TIERED = f"""WITH {_OVER}, b AS (SELECT item_id AS query_id, lower(text) AS l FROM benchmark), i AS (SELECT query_id, {_TERMS} AS terms, CASE WHEN len(b) > 0 THEN b[1].n ELSE 'general' END AS intent FROM (SELECT *, {asking._BEST} AS b FROM b)),
  p AS (SELECT *, {_TIERS} AS tiers, {_PLAN['recency']} AS wr, {_PLAN['importance']} AS wi, {_PLAN['similarity']} AS ws FROM i),
  d AS (SELECT doc_id AS memory_id, text, {_TIER} AS tier, doc_id % 1000 AS hours, {_SALIENCE} AS salience, len({_TOK}) AS size FROM documents),
  s AS (SELECT *, overlap / (n + size - overlap) AS similarity, list_position(tiers, tier) - 1 AS place, greatest(0.0, 1 - hours / 720.0) AS recency FROM o JOIN d USING (memory_id) JOIN p USING (query_id) WHERE overlap / (n + size - overlap) >= 0.3 AND list_contains(tiers, tier)),
  v AS (SELECT *, least(1.0, 0.5 + 0.3 * (1 - 0.2 * place) + 0.2 * len(list_filter(terms, lambda x: contains(lower(text), x))) / greatest(len(terms), 1)) AS relevance FROM s),
  c AS (SELECT *, round((similarity * ws + relevance * wi + 0.3 * recency * wr) * CASE WHEN tier = 'short_term' AND intent = 'context' THEN 1.3 ELSE 1 END * (1 - 0.1 * place), 6) AS score FROM v),
  w AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, memory_id) AS r FROM c),
  tiered AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM w WHERE r <= 5) WHERE rank <= 10)"""


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    text = F.col("text")
    memories = docs.select(F.col("doc_id").alias("memory_id"), "text", F.when(F.col("lang") == "en", "semantic").when(F.col("lang") == "de", "episodic").otherwise("short_term").alias("tier"), (F.col("doc_id") % 1000).alias("hours"), scores.emotional_salience(text).alias("importance"))
    sizes = docs.select(F.col("doc_id").alias("memory_id"), F.size(tokens(text)).alias("memory_size"))
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), intents.plan(text).alias("plan"), questions.key_terms(text).alias("terms"))
    return retrieval.search_tiered(_overlaps(spark, sf_dir).join(sizes, "memory_id"), asked, memories)


_add("search_tiered", f"{_TIERED} SELECT query_id, memory_id, tier, round(similarity, 6) AS similarity, round(relevance, 6) AS relevance, score, CAST(rank AS INT) AS rank FROM tiered", lambda spark, d: _tiered(spark, d).select("query_id", "memory_id", "tier", F.round("similarity", 6).alias("similarity"), F.round("relevance", 6).alias("relevance"), "score", "rank"))
_add("result_tier_filter", f"{_TIERED} SELECT query_id, memory_id FROM tiered WHERE tier = 'semantic'", lambda spark, d: _tiered(spark, d).where("tier = 'semantic'").select("query_id", "memory_id"))
_add(
    "rank_by_intent",
    f"""{_TIERED}, x AS (SELECT query_id, memory_id, round((similarity * CASE intent WHEN 'context' THEN 0.5 WHEN 'factual' THEN 0.7 ELSE ws END + relevance * wi + recency * CASE intent WHEN 'context' THEN 0.8 WHEN 'factual' THEN 0.2 WHEN 'preference' THEN 0.7 ELSE wr END
    + salience * CASE intent WHEN 'preference' THEN 0.5 ELSE 0.3 END) * CASE tier WHEN 'short_term' THEN 1.2 WHEN 'semantic' THEN 0.9 ELSE 1 END * (1 + 0.1 * (len(tiers) - place)), 6) AS score FROM tiered)
  SELECT query_id, memory_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS INT) AS rank FROM x""",
    lambda spark, d: retrieval.rank_by_intent(_tiered(spark, d)).select("query_id", "memory_id", "score", "rank"),
)


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, docs = _read(spark, sf_dir, "embeddings"), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    chosen = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    asked = docs.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), tokens(F.col("text")).alias("words"))
    return retrieval.hybrid(joins.vector_knn(chosen, vectors, 10, 0.3).select("query_id", "vec_id", "similarity"), docs, asked)


_add(
    "hybrid_search",
    rf"""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS similarity FROM q CROSS JOIN embeddings),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s WHERE similarity >= 0.3) WHERE r <= 10), t AS (SELECT doc_id, {_TOK} AS w FROM documents),
  h AS (SELECT query_id, vec_id, round(0.7 * similarity + 0.3 * len(list_intersect(x.w, y.w)) / greatest(len(x.w), 1), 6) AS score FROM near JOIN t x ON x.doc_id = query_id JOIN t y ON y.doc_id = vec_id)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM h WHERE score >= 0.5) WHERE rank <= 5""",
    _hybrid,
)
_add(
    "context_topics_boost",
    rf"""WITH t AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), b AS (SELECT conv_id, turn, w, flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS known FROM t)
  SELECT conv_id, turn, round(1 + least(0.2, 0.05 * len(list_intersect(coalesce(known, []), w))), 6) AS score FROM b""",
    lambda spark, d: (lambda c: retrieval.context_topics_boost(c.withColumn("score", F.lit(1.0)), c))(_read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text"))
    .select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"), F.round("score", 6).alias("score")),
)
