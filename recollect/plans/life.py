"""Registered lifecycle: promotion of sessions and episodes, merging, decay by tier, and the maintenance run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import extract, scores
from recollect.operators import joins, lifecycle
from recollect.plans.catalog import _TOK, _add, _clamp, _mem, _read, _slow, _turn
from recollect.streaming import events

_TURNS = "(SELECT conv_id AS session_id, turn AS seq, role AS speaker, CASE WHEN turn = 5 THEN 'It is fixed now. ' || text WHEN turn = 4 AND conv_id % 3 = 0 THEN 'An error came. ' || text ELSE text END AS text FROM conversations)"


def turns(c: DataFrame) -> DataFrame:
    """Turns of the conversations, some of which tell of success or failure."""
    text = F.when(F.col("turn") == 5, F.concat(F.lit("It is fixed now. "), "text")).when((F.col("turn") == 4) & (F.col("conv_id") % 3 == 0), F.concat(F.lit("An error came. "), "text")).otherwise(F.col("text"))
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), text.alias("text"))


_LAST = f"""l AS (SELECT *, lower(text) AS low, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM {_TURNS}),
  o AS (SELECT session_id, arg_min(left(text, 200), back) FILTER (regexp_matches(low, '{lifecycle.DONE}')) AS outcome, bool_or(regexp_matches(low, '{lifecycle.SUCCESS}')) AS good, bool_or(regexp_matches(low, '{lifecycle.FAILURE.replace("'", "''")}')) AS bad FROM l WHERE back <= 3 GROUP BY session_id),
  out AS (SELECT session_id, outcome, CASE WHEN good AND NOT bad THEN TRUE WHEN bad AND NOT good THEN FALSE END AS success FROM o)"""
_turn("last3_outcome", f"WITH {_LAST} SELECT * FROM out", lambda c: lifecycle.last_outcome(turns(c)))
_turn(
    "promote_stm",
    f"""WITH {_LAST}, r AS (SELECT session_id, string_agg(speaker || ': ' || n, ', ' ORDER BY f) AS roles, CAST(sum(n) AS BIGINT) AS items FROM (SELECT session_id, speaker, count(*) AS n, min(seq) AS f FROM l GROUP BY ALL) GROUP BY session_id),
  w AS (SELECT session_id, string_agg('[' || speaker || ']: ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY seq) AS content, string_agg(low, ' ' ORDER BY seq) AS low, arg_min(text, seq) FILTER (speaker = 'user') AS asked FROM l GROUP BY session_id)
  SELECT session_id, CASE WHEN regexp_matches(low, 'error|exception|bug|crash|failed') THEN 'error' WHEN regexp_matches(low, 'fixed|solved|resolved|done|complete') THEN 'task_completion' WHEN regexp_matches(low, 'learned|discovered|found out|realized') THEN 'discovery' WHEN regexp_matches(low, 'decided|chose|will use|going with') THEN 'decision' WHEN regexp_matches(low, 'feedback|suggest|recommend|think') THEN 'feedback' ELSE 'conversation' END AS event_type,
    coalesce(CASE WHEN length(asked) > 100 THEN left(asked, 100) || '...' ELSE asked END, 'Conversation session') AS description, content, 'Conversation with ' || items || ' messages (' || roles || ')' AS summary, outcome, success FROM w JOIN r USING (session_id) JOIN out USING (session_id)""",
    lambda c: lifecycle.promote_sessions(turns(c)),
)
_STATE = f"(SELECT session_id, count(*) AS items, session_id * 97 % 4000 AS age_seconds, session_id % 10 / 10.0 AS importance, arg_max(text, seq) AS last_text, session_id % 2 = 0 AS has_task FROM {_TURNS} GROUP BY session_id)"


def _checked(c: DataFrame) -> DataFrame:
    s = F.col("session_id")
    state = turns(c).groupBy("session_id").agg(F.count(F.lit(1)).alias("items"), F.max_by("text", "seq").alias("last_text"))
    return lifecycle.promotion_check(state.withColumns({"age_seconds": s * 97 % 4000, "importance": s % 10 / 10, "has_task": s % 2 == 0}))


_CHECK = f"(SELECT session_id, CASE WHEN age_seconds >= 3600 THEN 'Maximum age exceeded' WHEN age_seconds < 60 THEN 'STM too recent' WHEN importance >= 0.4 THEN 'Importance threshold met' WHEN has_task AND regexp_matches(lower(last_text), '{lifecycle.FINISHED}') THEN 'Task completed' ELSE 'No promotion criteria met' END AS reason FROM {_STATE})"
_turn("stm_promotion_check", f"SELECT session_id, reason IN ('Maximum age exceeded', 'Importance threshold met', 'Task completed') AS promote, reason FROM {_CHECK}", _checked)

# ---- episodes out of events

_EPISODE = "(SELECT id, user_id, CASE memory_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'decision' WHEN 'purchase' THEN 'task_completion' ELSE 'conversation' END AS event_type, memory_type || ' of k ' || access_count AS text, hours, is_consolidated, importance FROM MEM)"


def episodes(m: DataFrame) -> DataFrame:
    kind = F.when(F.col("memory_type") == "click", "error").when(F.col("memory_type") == "view", "decision").when(F.col("memory_type") == "purchase", "task_completion").otherwise("conversation")
    return m.select("id", "user_id", kind.alias("event_type"), F.concat_ws(" of k ", "memory_type", F.col("access_count").cast("string")).alias("text"), "hours", "is_consolidated", "importance")


_GROUPS = f"""e AS (SELECT *, {_TOK} AS w FROM {_EPISODE} WHERE NOT is_consolidated AND hours >= 24), s AS (SELECT event_type, min(id) AS "group", arg_min(w, id) AS sw FROM e GROUP BY event_type),
  m AS (SELECT "group", id, e.event_type FROM e JOIN s ON s.event_type = e.event_type WHERE id = "group" OR len(list_intersect(w, sw)) / len(list_distinct(list_concat(w, sw))) >= 0.3),
  g AS (SELECT * FROM m WHERE "group" IN (SELECT "group" FROM m GROUP BY "group" HAVING count(*) >= 3))"""
_mem("episode_groups", f"WITH {_GROUPS} SELECT * FROM g", lambda m: lifecycle.episode_groups(episodes(m)))
_mem(
    "promote_episodes",
    f"""WITH {_GROUPS}, p AS (SELECT "group", event_type, count(*) AS episodes, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS user_id, round(least(1.0, avg(importance)), 6) AS importance FROM g JOIN {_EPISODE} x USING (id, event_type) GROUP BY "group", event_type)
  SELECT "group", CASE event_type WHEN 'error' THEN 'Recurring error pattern observed ' || episodes || ' times' WHEN 'task_completion' THEN 'Task completion pattern from ' || episodes || ' experiences' WHEN 'decision' THEN 'Decision pattern observed across ' || episodes || ' instances' ELSE 'Pattern extracted from ' || episodes || ' related conversations' END AS pattern,
  round(least(1.0, 0.5 + 0.1 * episodes), 6) AS confidence, episodes, user_id, importance FROM p""",
    lambda m: lifecycle.promote_groups(lifecycle.episode_groups(episodes(m)), episodes(m)).withColumns({c: F.round(c, 6) for c in ("confidence", "importance")}),
)
_mem(
    "decay_by_tier",
    "SELECT id, round(CASE id % 3 WHEN 0 THEN " + " ".join(f"{_clamp('strength * exp(-' + _slow(r, 'importance + 0.5') + ' * hours)')} {w}" for r, w in (("0.1", "WHEN 1 THEN"), ("0.01", "ELSE"), ("0.001", "END"))) + ", 6) AS strength FROM MEM",
    lambda m: m.select("id", F.round(F.when(F.col("id") % 3 == 0, scores.strength_now(F.col("strength"), F.col("importance"), F.col("access_count"), F.col("hours"), 0.1)).when(F.col("id") % 3 == 1, scores.strength_now(F.col("strength"), F.col("importance"), F.col("access_count"), F.col("hours"), 0.01)).otherwise(scores.strength_now(F.col("strength"), F.col("importance"), F.col("access_count"), F.col("hours"), 0.001)), 6).alias("strength")),
)
_mem(
    "store_filters_v5", "SELECT id, CASE WHEN importance >= 0.8 OR (importance >= 0.6 AND access_count >= 2) THEN 'long_term' WHEN importance >= 0.4 THEN 'short_term' ELSE 'none' END AS tier FROM MEM",
    lambda m: m.select("id", F.when((F.col("importance") >= 0.8) | ((F.col("importance") >= 0.6) & (F.col("access_count") >= 2)), "long_term").when(F.col("importance") >= 0.4, "short_term").otherwise("none").alias("tier")),
)
_turn(
    "merge_semantic",
    """WITH t AS (SELECT conv_id AS g, conv_id * 100 + turn AS id, trim(text, ' ') AS text FROM conversations), u AS (SELECT g, arg_min(text, id) AS text, min(id) AS id FROM t GROUP BY g, lower(text))
  SELECT t.g AS "group", min(t.id) AS id, (SELECT string_agg(text, chr(10) || chr(10) ORDER BY id) FROM u WHERE u.g = t.g) AS content, arg_max(text, (length(text), -id)) AS summary, count(*) AS members, round(least(1.0, 0.5 + 0.05 * count(*)), 6) AS confidence FROM t GROUP BY t.g""",
    lambda c: lifecycle.merge_semantic(c.select(F.col("conv_id").alias("group"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.trim("text").alias("text"), F.trim("text").alias("summary"), F.lit(0.5).alias("confidence"))).withColumn("confidence", F.round("confidence", 6)),
)
_mem(
    "merge_episodic", "SELECT user_id, memory_type, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, min(created_at) AS start, max(created_at) AS stop FROM MEM WHERE memory_type = 'purchase' GROUP BY user_id, memory_type",
    lambda m: m.where("memory_type = 'purchase'").groupBy("user_id", "memory_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"), F.min("created_at").alias("start"), F.max("created_at").alias("stop")),
)

# ---- duplicates among documents

_ALIKE = f"""s AS MATERIALIZED (SELECT doc_id, source, lang, unnest(w) AS w, len(w) AS n FROM (SELECT doc_id, source, lang, {_TOK} AS w FROM documents)),
  rep AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY lang, list_sort({_TOK})) AS rep FROM documents),
  pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.lang = b.lang) AS same, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
  star AS (SELECT pairs.*, x.rep = a AND (y.rep = b OR y.rep = a) AS star FROM pairs JOIN rep x ON x.doc_id = a JOIN rep y ON y.doc_id = b)"""
_GREEDY = f"""WITH RECURSIVE {_ALIKE}, near AS (SELECT b AS id, list(a) AS nb, row_number() OVER (ORDER BY b) AS k FROM pairs WHERE similarity >= 0.9 GROUP BY b),
  g AS (SELECT 0::BIGINT AS k, (SELECT list(doc_id) FROM documents WHERE doc_id NOT IN (SELECT id FROM near)) AS led UNION ALL SELECT near.k, CASE WHEN list_has_any(nb, led) THEN led ELSE list_append(led, id) END FROM g JOIN near ON near.k = g.k + 1),
  f AS (SELECT led FROM g ORDER BY k DESC LIMIT 1)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.length("text").alias("size"))


def _leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.duplicate_leaders(_docs(spark, sf_dir), 90)


_add("duplicate_groups", f"{_GREEDY} SELECT doc_id, coalesce(x.leader, doc_id) AS leader FROM documents d LEFT JOIN (SELECT id, list_min(list_intersect(nb, led)) AS leader FROM near, f) x ON x.id = d.doc_id", lambda spark, d: _leaders(spark, d).withColumnsRenamed({"id": "doc_id"}))
_add("merge_duplicates", f"{_GREEDY} SELECT leader AS doc_id, count(*) AS members FROM (SELECT doc_id, coalesce(x.leader, doc_id) AS leader FROM documents d LEFT JOIN (SELECT id, list_min(list_intersect(nb, led)) AS leader FROM near, f) x ON x.id = d.doc_id) GROUP BY leader", lambda spark, d: _leaders(spark, d).groupBy(F.col("leader").alias("doc_id")).agg(F.count(F.lit(1)).alias("members")))
_add("should_merge", f"WITH {_ALIKE} SELECT a, b FROM star WHERE star AND same AND similarity >= 0.85", lambda spark, d: joins.jaccard_pairs(_docs(spark, d), 85, ["lang"]).select("a", "b"))
_add("ltm_consolidate", f"WITH {_ALIKE}, r AS (SELECT doc_id, length(text) AS size FROM documents) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN (x.size, -x.doc_id) > (y.size, -y.doc_id) THEN b ELSE a END FROM pairs JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE same)", lambda spark, d: (lambda docs: lifecycle.keep_better(docs, joins.jaccard_pairs(docs, 80, ["lang"]), [F.col("size")]).select(F.col("id").alias("doc_id")))(_docs(spark, d)))
_mem(
    "consolidate_all",
    f"WITH {_GROUPS} SELECT (SELECT count(*) FROM MEM WHERE strength < 0.05) AS weak, (SELECT count(*) FROM g) AS promoted, (SELECT count(DISTINCT \"group\") FROM g) AS patterns, (SELECT count(*) FROM MEM WHERE is_active AND strength < 0.1 AND importance < 0.5) AS collected",
    lambda m: m.agg(F.count_if(F.col("strength") < 0.05).alias("weak"), F.count_if(F.col("is_active") & (F.col("strength") < 0.1) & (F.col("importance") < 0.5)).alias("collected")).join(lifecycle.episode_groups(episodes(m)).agg(F.count(F.lit(1)).alias("promoted"), F.count_distinct("group").alias("patterns")), how="cross").select("weak", "promoted", "patterns", "collected"),
)

# ---- streams with state

_add(
    "stream_sliding_counts",
    "SELECT * FROM (SELECT event_type, w AS start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    lambda spark, d: events.drain(events.windowed_counts(events.event_stream(spark, d), "event_type", "1 hour", "10 minutes", "30 minutes"), events.work_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")),
)


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream: facts out of each, of every session and relation the newest."""
    stream = events.event_stream(spark, sf_dir, "conversations.parquet", at=None).where("role = 'user'")
    said = stream.select("conv_id", "turn", F.concat(F.lit("I live in room "), F.col("turn").cast("string"), F.lit(". I like tea "), F.col("conv_id").cast("string"), F.lit(".")).alias("text"))
    facts = extract.extract_facts(said).select("conv_id", "relation", "object", "turn")
    return events.latest(facts, ["conv_id", "relation"], "turn", events.work_folder(spark)).select("conv_id", "relation", "object")


_add("stream_ingest", "SELECT conv_id, 'lives_in' AS relation, 'room ' || max(turn) AS object FROM conversations WHERE role = 'user' GROUP BY conv_id UNION ALL SELECT DISTINCT conv_id, 'likes', 'tea ' || conv_id FROM conversations WHERE role = 'user'", _ingested)
