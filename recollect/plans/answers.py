"""Registered searches over turns, and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import extract, questions
from recollect.operators import answers, joins
from recollect.plans import questions as asking
from recollect.plans import retrieval as searching
from recollect.plans.catalog import _TOK, _add, _read

_ITEMS = f"""q AS (SELECT item_id AS query_id, unnest(w) AS w, len(w) AS n FROM (SELECT item_id, {_TOK} AS w FROM benchmark)),
  i AS (SELECT conv_id * 100 + turn AS memory_id, conv_id, turn, role, text, {_TOK} AS w FROM conversations),
  o AS (SELECT query_id, memory_id, any_value(n) AS n, count(*) AS overlap FROM q JOIN (SELECT memory_id, unnest(w) AS w FROM i) USING (w) GROUP BY query_id, memory_id),
  s AS (SELECT query_id, memory_id, role, turn, round(0.3 * (1 - turn / 10) + 0.3 * (conv_id % 10 / 10) + 0.3 * overlap / (n + 1) + 0.1 * least(1.0, ln(1 + turn) / 3.0), 6) AS score FROM o JOIN i USING (memory_id))"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("memory_id"), "text", "role", "turn", (1 - F.col("turn") / 10).alias("activation"), (F.col("conv_id") % 10 / 10).alias("importance"), F.col("turn").alias("rehearsals"))


def _ranked(rows: str, columns: str = "query_id, memory_id, score", k: int = 10) -> str:
    return f"SELECT {columns}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM {rows}) WHERE rank <= {k}"


_add("search_ltm", f"WITH {_ITEMS} {_ranked('(SELECT * FROM s WHERE role = ' + repr('user') + ')')}", lambda spark, d: answers.search_items(_asked(spark, d), items(spark, d).where("role = 'user'")))
_add(
    "search_tiers_v5",
    f"""WITH {_ITEMS}, t AS (SELECT *, CASE WHEN turn >= 4 THEN 'short' ELSE 'long' END AS tier FROM s), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, memory_id) AS r FROM t) WHERE r <= 5) {_ranked('u', 'query_id, memory_id, tier, score')}""",
    lambda spark, d: (lambda i: answers.search_tiers(_asked(spark, d), {"short": i.where("turn >= 4"), "long": i.where("turn < 4")}))(items(spark, d)),
)
_add(
    "unit_candidates",
    f"""WITH {_ITEMS}, v AS (SELECT query_id, memory_id, CASE WHEN turn = 0 THEN 'session' WHEN role = 'user' THEN 'turn' ELSE 'utterance' END AS level, turn, overlap, n FROM o JOIN i USING (memory_id)),
  x AS (SELECT query_id, memory_id, level, round(overlap / (n + 1) + CASE level WHEN 'session' THEN 0.15 WHEN 'turn' THEN 0.1 ELSE 0 END + 0.2 * (turn % 5 / 5), 6) AS score FROM v) {_ranked('x', 'query_id, memory_id, level, score')}""",
    lambda spark, d: answers.unit_candidates(_asked(spark, d), items(spark, d).select("memory_id", "text", F.when(F.col("turn") == 0, "session").when(F.col("role") == "user", "turn").otherwise("utterance").alias("level"), (F.col("turn") % 5 / 5).alias("feedback"))),
)
_add(
    "best_context_line",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS place FROM documents), q AS (SELECT item_id AS query_id, unnest({_TOK}) AS w FROM benchmark),
  s AS (SELECT query_id, doc_id, place, any_value(line) AS line, count(*) AS n FROM q JOIN (SELECT doc_id, place, line, unnest({_TOK.replace('text', 'line')}) AS w FROM l) USING (w) GROUP BY query_id, doc_id, place)
  SELECT item_id AS query_id, coalesce(b.line, 'Not mentioned') AS line FROM benchmark LEFT JOIN (SELECT query_id, left(arg_max(line, (n, -doc_id, -place)), 80) AS line FROM s GROUP BY query_id) b ON b.query_id = item_id""",
    lambda spark, d: answers.best_line(_asked(spark, d), _read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")),
)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asking.asked(spark, sf_dir).where("query_id % 50 = 0").select("query_id", "q")


_add(
    "answer_from_facts",
    f"""{searching._BASE}, h AS ({searching._top_sql('fact_hits', 20)}), b AS (SELECT query_id, string_agg(DISTINCT object, ', ' ORDER BY object) FILTER (fact_type = 'preference') AS liked, arg_min(object, rank) AS first FROM h JOIN f USING (fact_id) GROUP BY query_id)
  SELECT query_id, CASE WHEN {asking._any_sql(questions.FLAGS['preference'])} AND liked IS NOT NULL THEN liked ELSE first END AS answer FROM a JOIN b USING (query_id)""",
    lambda spark, d: answers.answer_from_facts(_questions(spark, d), searching.retrieval.search_facts(_questions(spark, d), searching.facts(spark, d)), searching.facts(spark, d)),
)
_add(
    "answer_duration",
    f"""{searching._BASE} SELECT query_id, y || CASE WHEN y = 1 THEN ' year' ELSE ' years' END || CASE WHEN contains(l, 'ago') THEN ' ago' ELSE '' END AS answer FROM (SELECT query_id, l, query_id % 9 + 1 AS y FROM names WHERE who IN (SELECT subject FROM st))""",
    lambda spark, d: answers.answer_duration(_questions(spark, d), searching.states(spark, d).withColumn("days", ((-F.col("fact_id") - 1) % 9 + 1) * 365)),
)
_KNN = """WITH q AS (SELECT vec_id AS a, embedding AS x FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT a, vec_id AS b, list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q CROSS JOIN embeddings WHERE a <> vec_id),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s) WHERE r <= 5)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    near = joins.vector_knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 6, -1.0).where("query_id <> vec_id")
    from pyspark.sql import Window

    line = Window.partitionBy("query_id").orderBy("rank")
    return near.withColumn("_r", F.row_number().over(line)).where("_r <= 5").select(F.col("query_id").alias("a"), F.col("vec_id").alias("b"), F.col("similarity").alias("score"))


_add("pair_score_lookup", f"{_KNN} SELECT b AS a, a AS b, round(max(score), 6) AS score FROM k GROUP BY k.b, k.a", lambda spark, d: (lambda k: answers.pair_scores(k.select(F.col("b").alias("a"), F.col("a").alias("b")), k).select("a", "b", F.round("score", 6).alias("score")))(_known(spark, d)))
_WORDS = r"list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')), lambda w: lower(w)))"
_add(
    "entity_to_memory", f"SELECT entity, memory_id FROM (SELECT entity, memory_id, row_number() OVER (PARTITION BY entity ORDER BY memory_id) AS r FROM (SELECT conv_id * 100 + turn AS memory_id, unnest({_WORDS}) AS entity FROM (SELECT conv_id, turn, role || ' Person Met ' || upper(left(role, 1)) || right(role, length(role) - 1) AS text FROM conversations))) WHERE r <= 3",
    lambda spark, d: answers.entity_memories(items(spark, d).withColumn("said", F.concat_ws(" Person Met ", "role", F.initcap("role"))), F.regexp_extract_all("said", F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1))),
)
_add(
    "speaker_boost_join",
    f"WITH {_ITEMS}, p AS (SELECT query_id, memory_id, role, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 10) SELECT query_id, memory_id, round(score + CASE WHEN role = 'user' THEN 0.2 ELSE 0 END, 6) AS score FROM p",
    lambda spark, d: answers.speaker_boost(answers.search_items(_asked(spark, d), items(spark, d)).join(items(spark, d).select("memory_id", F.col("role").alias("speaker")), "memory_id"), _asked(spark, d).withColumn("text", F.lit("what did the User say"))).select("query_id", "memory_id", F.round("score", 6).alias("score")),
)

_add(
    "conversation_context",
    f"""WITH p AS (SELECT *, {_TOK} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations), e AS (SELECT p.conv_id, p.turn, p.text, len(list_intersect(p.w, l.w)) AS n FROM p JOIN p l ON l.conv_id = p.conv_id AND l.back = 1 WHERE p.back > 5),
  b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, turn) AS r FROM e WHERE n > 0), k AS (SELECT conv_id, 0 AS part, turn AS seq, text FROM p WHERE back <= 5 UNION ALL SELECT conv_id, 1, r, text FROM b WHERE r <= 5)
  SELECT conv_id AS session_id, string_agg(CASE part WHEN 0 THEN '- ' ELSE '* ' END || text, chr(10) ORDER BY part, seq) AS context FROM k GROUP BY conv_id""",
    lambda spark, d: answers.conversation_context(_read(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text")),
)
_TEXT = "who || ' moved to ' || place || ' on 7 May 2023, ' || (query_id % 9 + 2) || ' years ago.' || chr(10) || 'It is correct.'"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for n, ps in questions.TYPES for p in ps) + " ELSE 'what' END"
_add(
    "answer_extractive",
    f"SELECT query_id, kind, CASE kind WHEN 'when' THEN '7 May 2023' WHEN 'who' THEN who WHEN 'where' THEN place WHEN 'how_many' THEN CAST(query_id % 9 + 2 AS VARCHAR) WHEN 'yes_no' THEN 'Yes' ELSE split_part({_TEXT}, chr(10), 1) END AS answer FROM (SELECT *, {_KIND} AS kind FROM {asking.ASKED})",
    lambda spark, d: asking.asked(spark, d).withColumn("text", F.concat("who", F.lit(" moved to "), "place", F.lit(" on 7 May 2023, "), (F.col("query_id") % 9 + 2).cast("string"), F.lit(" years ago.\nIt is correct."))).withColumn("a", answers.extract_answer(F.col("q"), F.col("text"))).select("query_id", "a.kind", "a.answer"),
)
_NAMED = f"list_filter({asking._ONCE.format(asking._CAPS)}, lambda w: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, w))"
_add(
    "decompose_evidence",
    f"SELECT query_id, array_to_string(list_concat(list_transform({_NAMED}[1:3], lambda n: 'What do we know about ' || n || '?'), [q]), ' | ') AS found FROM {asking.ASKED} WHERE query_id % 12 <> 11 UNION ALL SELECT query_id, 'What do we know about ' || who || '? | Does he is glad apply to ' || who || '? | Would ' || who || ' likely work?' FROM {asking.ASKED} WHERE query_id % 12 = 11",
    lambda spark, d: asking.asked(spark, d).withColumn("q", F.when(F.col("query_id") % 12 == 11, F.concat(F.lit("Would "), "who", F.lit(" likely work because he is glad"))).otherwise(F.col("q"))).select("query_id", F.array_join(questions.evidence_steps(F.col("q")), " | ").alias("found")),
)
_HYPE = "CASE WHEN contains(l, 'how long') OR contains(l, 'how many years') OR contains(l, 'how many months') THEN 'how_long' WHEN regexp_matches(l, '^when|what time|what date') THEN 'when' WHEN regexp_matches(l, '^who|whom') THEN 'who' WHEN regexp_matches(l, '^where|what place') THEN 'where' WHEN regexp_matches(l, '^(is|are|was|were|did|does|do|would|could) ') THEN 'yes_no' ELSE 'what' END"
_add(
    "hyde_templates",
    f"SELECT query_id, replace(CASE {_HYPE} " + " ".join(f"WHEN '{k}' THEN '{' | '.join(v)}'" for k, v in questions.HYPOTHETICAL.items()) + f" END, '{{person}}', coalesce({_NAMED}[1], '{{person}}')) AS found FROM {asking.ASKED}",
    lambda spark, d: asking.asked(spark, d).select("query_id", F.array_join(questions.hypothetical_answers(F.col("q")), " | ").alias("found")),
)
_add(
    "contradiction_flag", f"SELECT query_id, CASE query_id % 4 WHEN 0 THEN place <> 'Asia' WHEN 1 THEN TRUE WHEN 2 THEN TRUE ELSE FALSE END AS contradicts FROM {asking.PEOPLE}",
    lambda spark, d: (lambda p, k: p.select("query_id", extract.contradicts(
        F.when(k == 0, F.lit("I live in Asia")).when(k == 1, F.concat(F.lit("Now I hate "), "thing")).when(k == 2, F.concat("who", F.lit(" is not glad"))).otherwise(F.concat("who", F.lit(" sings loud"))),
        F.when(k == 0, F.concat(F.lit("I live in "), "place")).when(k == 1, F.concat(F.lit("I love "), "thing")).when(k == 2, F.concat("who", F.lit(" is glad"))).otherwise(F.concat("who", F.lit(" sings"))),
    ).alias("contradicts")))(asking.people(spark, d), F.col("query_id") % 4),
)
