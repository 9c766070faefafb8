"""Registered queries of the memory operators, each with SQL that states it another way.

``MEM`` makes memories of the events table: one row an event, with the user, the
event type as memory type, value / 500 as strength and importance, and the number
in ``props`` as access count.  Ages count back from ``AS_OF``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import extract, intents, lexicons, scores
from recollect.functions.tokens import mentions, tokens, word_tokens
from recollect.operators import evaluation, graph, joins, lifecycle, ranking, shared, sparse, tables
from recollect.streaming import events

AS_OF = "2024-02-01 00:00:00"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None, build: Query) -> None:
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


# ---- memories out of events

MEM = f"""(SELECT event_id AS id, user_id, event_type AS memory_type, ts AS created_at, value / 500 AS strength, value / 500 AS importance,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS access_count, event_id % 7 <> 0 AS is_active, event_id % 3 = 0 AS is_consolidated,
  (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 3600.0 AS hours FROM events)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("memory_type"), F.col("ts").alias("created_at"), (F.col("value") / 500).alias("strength"), (F.col("value") / 500).alias("importance"),
        F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("access_count"), (F.col("event_id") % 7 != 0).alias("is_active"), (F.col("event_id") % 3 == 0).alias("is_consolidated"),
        scores.hours_between(F.col("ts"), F.lit(AS_OF)).alias("hours"),
    )


def _score(name: str, score: Callable[[Column, Column, Column, Column], Column], sql: str, digits: int = 6) -> None:
    """A score of every memory out of its strength, importance, access count and age, rounded."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        column = score(*(F.col(c) for c in ("strength", "importance", "access_count", "hours")))
        return memories(spark, sf_dir).select("id", F.round(column.cast("double"), digits).alias(name))

    _add(name, f"SELECT id, round(CAST({sql} AS DOUBLE), {digits}) AS {name} FROM {MEM}", build)


def _slow(rate: str, importance: str = "importance") -> str:
    return f"({rate} / greatest(0.1, {importance}) / (1 + 0.1 * access_count))"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_RECENT = "CASE WHEN hours <= 0 THEN 1.0 ELSE pow(0.5, hours / 24.0) END"
_RATE = "CASE WHEN hours <= 0 THEN CASE WHEN access_count > 0 THEN 1.0 ELSE 0.5 END ELSE least(1.0, access_count / greatest(least(hours, 168.0), 1.0)) END"
_UPDATED = "CASE WHEN hours <= 0 THEN 1.0 ELSE pow(0.5, hours / 48.0) END"
_STEPS = "CASE WHEN hours < importance THEN least(1.0, 1.0 + least(0.2, 0.05 * access_count)) WHEN hours < 24 * importance THEN least(1.0, 0.8 + least(0.2, 0.05 * access_count)) WHEN hours < 168 * importance THEN least(1.0, 0.6 + least(0.2, 0.05 * access_count)) WHEN hours < 720 * importance THEN least(1.0, 0.4 + least(0.2, 0.05 * access_count)) ELSE greatest(0.1, 0.2 + 0.02 * access_count) END"

_score("decay_exponential", lambda s, i, n, h: scores.decay_exponential(s, 0.01, i, n, h), _clamp(f"strength * exp(-{_slow('0.01')} * hours)"))
_score("decay_power", lambda s, i, n, h: scores.decay_power(s, 0.1, i, n, h), _clamp(f"strength * pow(1 + hours, -{_slow('0.1')})"))
_score("decay_linear", lambda s, i, n, h: scores.decay_linear(s, 0.001, i, n, h), _clamp(f"strength - {_slow('0.001')} * hours"))
_score("decay_stepped", lambda s, i, n, h: scores.decay_stepped(s, 0.1, i, n, h), _STEPS)
_score("strength_now", lambda s, i, n, h: scores.strength_now(s, i, n, h, scores.TIER_RATES["episodic"]), _clamp(f"strength * exp(-{_slow('0.01', 'importance + 0.5')} * hours)"))
_score("decayed_strength_base", lambda s, i, n, h: scores.decayed_strength_base(s, 0.01, i, h), _clamp("strength * exp(-0.01 / (0.5 + importance) * hours)"))
_score("effective_strength", lambda s, i, n, h: scores.effective_strength(s, i), "strength * (0.5 + 0.5 * importance)", 12)
_score("rehearsal_boost", lambda s, i, n, h: scores.rehearsal_boost(s), "least(1.0, strength + 0.2)")
_score("hours_to_threshold", lambda s, i, n, h: scores.hours_to_threshold(s, 0.1, 0.01, i), "CASE WHEN strength <= 0.1 THEN 0 ELSE -ln(0.1 / strength) / (0.01 / (0.5 + importance)) END")
_score("importance_composite", lambda s, i, n, h: scores.importance_composite(s, F.lit(0.8), scores.relevance_frequency(n), F.lit(0.2), i), "0.2 * strength + 0.25 * 0.8 + 0.2 * least(1.0, ln(1 + access_count) / ln(101)) + 0.25 * 0.2 + 0.1 * importance", 12)
_score("relevance_frequency", lambda s, i, n, h: scores.relevance_frequency(n), "least(1.0, ln(1 + access_count) / ln(101))")
_score("decay_novelty", lambda s, i, n, h: scores.decay_novelty(i), "greatest(0.1, importance - 0.1)")
_score("recency_half_life", lambda s, i, n, h: scores.recency_half_life(h), _RECENT)
_score("access_rate_score", lambda s, i, n, h: scores.access_rate_score(n, h), _RATE)
_score("update_score", lambda s, i, n, h: scores.update_score(h), _UPDATED)
_score("temporal_score_hybrid", lambda s, i, n, h: scores.temporal_score(s, h, h, n), f"strength * (0.4 * ({_RECENT}) + 0.2 * ({_RATE}) + 0.2 * ({_UPDATED}) + 0.2) * CASE WHEN hours <= 1 THEN 1.5 ELSE 1 END")
_score("temporal_score_recency", lambda s, i, n, h: scores.temporal_score(s, h, h, n, "recency"), f"strength * ({_RECENT})")
_score("temporal_score_linear", lambda s, i, n, h: scores.temporal_score(s, h, h, n, "linear"), "strength * greatest(0.0, 1 - hours / 240.0)", 12)
_score("temporal_score_step", lambda s, i, n, h: scores.temporal_score(s, h, h, n, "step"), "strength * CASE WHEN hours <= 1 THEN 1.5 ELSE 1 END")
_score("temporal_score_frequency", lambda s, i, n, h: scores.temporal_score(s, h, h, n, "frequency"), f"strength * ({_RATE})", 12)
_score("temporal_rerank", lambda s, i, n, h: 0.7 * s + 0.3 * scores.temporal_score(s, h, h, n, "recency"), f"0.7 * strength + 0.3 * strength * ({_RECENT})")
_score("linear_recency_30d", lambda s, i, n, h: scores.linear_recency_30d(h), "greatest(0.0, 1 - hours / 720.0)", 12)
_score("recency_boost_7d", lambda s, i, n, h: scores.recency_boost_7d(s, h), "CASE WHEN hours BETWEEN 0 AND 168 THEN strength + 0.2 * (1 - hours / 168.0) ELSE strength END", 12)
_score("item_score", lambda s, i, n, h: scores.item_score(s, i, F.lit(0.5), n), "0.3 * strength + 0.3 * importance + 0.15 + 0.1 * least(1.0, ln(1 + access_count) / 3.0)", 12)
_score("activation_decay", lambda s, i, n, h: scores.activation_decay(s, 0.001, h), "greatest(0.0, strength - 0.001 * hours)", 12)
_score("decay_factor_v3", lambda s, i, n, h: scores.decay_factor_v3(s), "greatest(0.1, strength - 0.01)")
_score("fact_strengthen", lambda s, i, n, h: scores.fact_strengthen(s), "least(1.0, strength + 0.1)")
_score("classify_age_bucket", lambda s, i, n, h: scores.strength_bin(s), "CASE WHEN strength >= 0 AND strength < 1 THEN floor(strength / 0.25) END")

# ---- filters and pages


def _mem(name: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql.replace("MEM", MEM), lambda spark, d: build(memories(spark, d)))


_mem("query_by_type", "SELECT id, user_id FROM MEM WHERE memory_type = 'click' AND is_active ORDER BY created_at DESC, id LIMIT 50 OFFSET 10", lambda m: tables.query_by_type(m, "click", 50, 10).select("id", "user_id"))
_mem("query_by_user", "SELECT id, memory_type FROM MEM WHERE user_id = 7", lambda m: m.where(tables.where_spec({"user_id": 7})).select("id", "memory_type"))
_mem("query_by_time_range", "SELECT id FROM MEM WHERE created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'", lambda m: tables.query_by_time_range(m, "2024-01-10", "2024-01-12").select("id"))
_mem("query_by_strength", "SELECT id FROM MEM WHERE strength BETWEEN 0.2 AND 0.6", lambda m: tables.query_by_strength(m, 0.2, 0.6).select("id"))
_mem("query_weak", "SELECT id FROM MEM WHERE strength < 0.05", lambda m: m.where("strength < 0.05").select("id"))
_mem("query_unconsolidated", "SELECT id FROM MEM WHERE NOT is_consolidated AND is_active AND importance >= 0.3 ORDER BY created_at, id LIMIT 40", lambda m: tables.query_unconsolidated(m, 0.3, 40).select("id"))
_mem("where_spec", "SELECT id FROM MEM WHERE memory_type IN ('click', 'view') AND strength >= 0.1 AND user_id <> 3", lambda m: m.where(tables.where_spec({"memory_type": ["click", "view"], "strength": {"$gte": 0.1}, "user_id": {"$ne": 3}})).select("id"))
_mem("list_memories", "SELECT id FROM MEM ORDER BY created_at DESC, id LIMIT 25 OFFSET 25", lambda m: tables.page(m, [F.desc("created_at"), F.asc("id")], 25, 25).select("id"))
_mem("time_filter", f"SELECT id FROM MEM WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{AS_OF}'", lambda m: tables.time_filter(m, AS_OF, 7).select("id"))
_mem("soft_delete", "SELECT id, is_active AND strength >= 0.1 AS is_active FROM MEM", lambda m: m.withColumn("is_active", F.col("is_active") & (F.col("strength") >= 0.1)).select("id", "is_active"))
_mem("active_items", "SELECT id FROM MEM WHERE strength >= 0.3", lambda m: m.where("strength >= 0.3").select("id"))
_mem("gc_collect", "SELECT id, is_active AND NOT (strength < 0.1 AND importance < 0.5) AS is_active FROM MEM", lambda m: m.select("id", (F.col("is_active") & ~((F.col("strength") < 0.1) & (F.col("importance") < 0.5))).alias("is_active")))
_mem(
    "delete_many", "SELECT id FROM MEM WHERE id NOT IN (SELECT id FROM MEM WHERE user_id % 2 = 0)", lambda m: tables.delete_many(m, m.where("user_id % 2 = 0")).select("id")
)
_mem("read_many", "SELECT id FROM MEM WHERE user_id % 2 = 0", lambda m: tables.read_many(m, m.where("user_id % 2 = 0")).select("id"))
_mem(
    "upsert_by_key",
    "SELECT user_id, memory_type, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, memory_type ORDER BY id DESC) AS r FROM MEM) WHERE r = 1",
    lambda m: tables.upsert_by_key(m.where("id % 2 = 0"), m.where("id % 2 = 1"), ["user_id", "memory_type"], "id").select("user_id", "memory_type", "id"),
)
_mem(
    "touch",
    "SELECT user_id AS id, 1 + count(*) AS access_count, max(created_at) AS last_accessed_at FROM MEM GROUP BY user_id",
    lambda m: tables.touch(m.select(F.col("user_id").alias("id")).distinct().select("id", F.lit(1).cast("long").alias("access_count"), F.lit("2000-01-01").cast("timestamp_ntz").alias("last_accessed_at")), m.select(F.col("user_id").alias("id"), F.col("created_at").alias("ts"))),
)
_mem(
    "update_fields",
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'patched' ELSE memory_type END AS memory_type, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-02-01' ELSE created_at END AS updated_at FROM MEM",
    lambda m: tables.update_fields(m.withColumn("updated_at", F.col("created_at")), m.where("id % 5 = 0").select("id", F.lit("patched").alias("memory_type"), F.lit(AS_OF).cast("timestamp_ntz").alias("updated_at")), "id", ["memory_type", "updated_at"]).select("id", "memory_type", "updated_at"),
)
_mem("capacity_keep_last", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM MEM) WHERE r <= 20", lambda m: tables.keep_last(m, ["user_id"], [F.col("created_at"), F.col("id")], 20).select("id"))
_mem(
    "evict_weakest",
    "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY strength * (0.5 + 0.5 * importance) DESC, id) AS r FROM MEM) WHERE r <= 20",
    lambda m: tables.first_rows(m, ["user_id"], [scores.effective_strength(F.col("strength"), F.col("importance")).desc(), F.asc("id")], 20).select("id"),
)
_mem(
    "newest_per_subject", "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r FROM MEM) WHERE r = 1",
    lambda m: tables.keep_last(m, ["user_id"], [F.col("created_at"), F.col("id")], 1).select("user_id", "id"),
)
_mem(
    "select_best",
    "SELECT memory_type, arg_max(id, (importance, access_count, created_at, id)) AS id FROM MEM GROUP BY memory_type",
    lambda m: m.groupBy("memory_type").agg(F.max_by("id", F.struct("importance", "access_count", "created_at", "id")).alias("id")),
)
_mem(
    "prev_next_event",
    "SELECT id, lag(id) OVER w AS preceded_by, lead(id) OVER w AS followed_by FROM MEM WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)",
    lambda m: (lambda w: m.select("id", F.lag("id").over(w).alias("preceded_by"), F.lead("id").over(w).alias("followed_by")))(Window.partitionBy("user_id").orderBy("created_at", "id")),
)
_mem("sequence_number", "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) - 1 AS seq FROM MEM", lambda m: m.select("id", (F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")) - 1).cast("long").alias("seq")))
_mem(
    "time_context",
    "SELECT id, dayname(created_at) AS weekday, CASE WHEN hour(created_at) < 5 OR hour(created_at) >= 21 THEN 'night' WHEN hour(created_at) < 12 THEN 'morning' WHEN hour(created_at) < 17 THEN 'afternoon' ELSE 'evening' END AS part, isodow(created_at) >= 6 AS weekend FROM MEM",
    lambda m: m.select("id", F.date_format("created_at", "EEEE").alias("weekday"), scores.part_of_day(F.col("created_at")).alias("part"), (F.weekday("created_at") >= 5).alias("weekend")),
)

# ---- aggregates

_mem(
    "memory_stats",
    "SELECT coalesce(memory_type, 'all') AS memory_type, count(*) AS total, count(*) FILTER (is_active) AS active, count(DISTINCT user_id) AS sessions, count(*) FILTER (strength < 0.25) AS bin_0, count(*) FILTER (strength >= 0.25 AND strength < 0.5) AS bin_1, count(*) FILTER (strength >= 0.5 AND strength < 0.75) AS bin_2, count(*) FILTER (strength >= 0.75 AND strength < 1) AS bin_3 FROM MEM GROUP BY ROLLUP (memory_type)",
    lambda m: m.rollup("memory_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_distinct("user_id").alias("sessions"), *[F.count_if(scores.strength_bin(F.col("strength")) == b).alias(f"bin_{b}") for b in range(4)]).withColumn("memory_type", F.coalesce("memory_type", F.lit("all"))),
)
_mem(
    "temporal_span", "SELECT user_id, min(created_at) AS first, max(created_at) AS last, CAST(floor(epoch(max(created_at))) - floor(epoch(min(created_at))) AS BIGINT) AS seconds FROM MEM GROUP BY user_id",
    lambda m: m.groupBy("user_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last")).withColumn("seconds", F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))),
)
_mem(
    "common_event_type",
    "SELECT user_id, arg_max(memory_type, (n, memory_type)) AS memory_type FROM (SELECT user_id, memory_type, count(*) AS n FROM MEM GROUP BY ALL) GROUP BY user_id",
    lambda m: m.groupBy("user_id", "memory_type").count().groupBy("user_id").agg(F.max_by("memory_type", F.struct("count", "memory_type")).alias("memory_type")),
)
_mem(
    "feedback_stats",
    "SELECT user_id, count(*) AS retrievals, count(*) FILTER (strength >= 0.2) AS used, round(count(*) FILTER (strength >= 0.2) / count(*), 6) AS usage_rate, count(DISTINCT memory_type) AS units, round(avg(strength), 6) AS helpfulness FROM MEM GROUP BY user_id",
    lambda m: m.groupBy("user_id").agg(F.count(F.lit(1)).alias("retrievals"), F.count_if(F.col("strength") >= 0.2).alias("used"), F.round(F.avg((F.col("strength") >= 0.2).cast("double")), 6).alias("usage_rate"), F.count_distinct("memory_type").alias("units"), F.round(F.avg("strength"), 6).alias("helpfulness")),
)


def feedback_ema(log: DataFrame, keys: list[str], helpfulness: str, order: list[str]) -> DataFrame:
    """s <- s + 0.3 (h - s) from 0.5 in order of time, in closed form."""
    line = Window.partitionBy(*keys).orderBy(*order)
    placed = log.withColumns({"_i": F.row_number().over(line), "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    term = 0.3 * F.col(helpfulness) * F.pow(F.lit(0.7), F.col("_n") - F.col("_i"))
    return placed.groupBy(*keys).agg((0.5 * F.pow(F.lit(0.7), F.max("_n")) + F.sum(term)).alias("score"))


_mem(
    "feedback_ema",
    """WITH RECURSIVE o AS (SELECT user_id, memory_type, strength, row_number() OVER (PARTITION BY user_id, memory_type ORDER BY created_at, id) AS i FROM MEM),
  r AS (SELECT user_id, memory_type, i, 0.5 + 0.3 * (strength - 0.5) AS s FROM o WHERE i = 1 UNION ALL
        SELECT o.user_id, o.memory_type, o.i, r.s + 0.3 * (o.strength - r.s) FROM r JOIN o ON o.user_id = r.user_id AND o.memory_type = r.memory_type AND o.i = r.i + 1)
  SELECT user_id, memory_type, round(arg_max(s, i), 6) AS score FROM r GROUP BY ALL""",
    lambda m: feedback_ema(m, ["user_id", "memory_type"], "strength", ["created_at", "id"]).withColumn("score", F.round("score", 6)),
)
_mem(
    "latency_summary",
    "SELECT memory_type, count(*) AS n, round(avg(strength), 6) AS mean, round(stddev_samp(strength), 6) AS std, min(strength) AS least, max(strength) AS most, round(quantile_cont(strength, 0.5), 6) AS p50, round(quantile_cont(strength, 0.95), 6) AS p95, round(quantile_cont(strength, 0.99), 6) AS p99 FROM MEM GROUP BY memory_type",
    lambda m: evaluation.latency_summary(m, ["memory_type"], "strength").withColumns({c: F.round(c, 6) for c in ("mean", "std", "p50", "p95", "p99")}),
)
_mem("forgetting_slope", "SELECT round(regr_slope(strength, hours), 9) AS slope, count(*) AS n FROM MEM", lambda m: evaluation.forgetting_slope(m, "hours", "strength").withColumn("slope", F.round("slope", 9)))
_mem("mean_strength_decay", f"SELECT memory_type, round(avg(strength - {_clamp('strength * exp(-0.01 / (0.5 + importance) * hours)')}), 6) AS decay FROM MEM GROUP BY memory_type", lambda m: m.groupBy("memory_type").agg(F.round(F.avg(F.col("strength") - scores.decayed_strength_base(F.col("strength"), 0.01, F.col("importance"), F.col("hours"))), 6).alias("decay")))
_mem("windowed_counts", "SELECT memory_type, date_trunc('hour', created_at) AS start, count(*) AS n FROM MEM GROUP BY ALL", lambda m: m.groupBy("memory_type", F.window("created_at", "1 hour").alias("w")).count().select("memory_type", F.col("w.start").alias("start"), F.col("count").alias("n")))

# ---- documents as memories, benchmark items as questions


def _doc(name: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql, lambda spark, d: build(_read(spark, d, "documents")))


def _mention_sql(words: list[str]) -> str:
    return "(" + " + ".join("contains(lower(text), '" + w.replace("'", "''") + "')::INT" for w in words) + ")"


_doc("emotional_salience", f"SELECT doc_id, round(greatest(0.1, least(1.0, 0.2 * {_mention_sql(lexicons.HIGH_EMOTION)} + 0.1 * {_mention_sql(lexicons.MEDIUM_EMOTION)})), 6) AS salience FROM documents", lambda d: d.select("doc_id", F.round(scores.emotional_salience(F.col("text")), 6).alias("salience")))
_doc(
    "content_type",
    "SELECT doc_id, CASE WHEN contains(text, '?') THEN 'question' WHEN " + _mention_sql(lexicons.ERROR_WORDS) + " > 0 THEN 'error' WHEN " + " OR ".join(f"contains(text, '{m}')" for m in lexicons.CODE_MARKS) + " THEN 'code' WHEN " + _mention_sql(lexicons.DECISION_WORDS) + " > 0 THEN 'decision' WHEN " + _mention_sql(lexicons.PREFERENCE_WORDS) + " > 0 THEN 'preference' ELSE 'general' END AS kind FROM documents",
    lambda d: d.select("doc_id", scores.content_type(F.col("text")).alias("kind")),
)
_doc(
    "topic_of",
    "SELECT doc_id, coalesce(arg_max(topic, (n, -o)) FILTER (n > 0), 'general') AS topic FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, {i} AS o, {_mention_sql(kw)} AS n FROM documents" for i, (t, kw) in enumerate(lexicons.TOPICS.items())) + ") GROUP BY doc_id",
    lambda d: d.select("doc_id", scores.topic_of(F.col("text")).alias("topic")),
)
_doc("summary_ratio", "SELECT doc_id, length(text) AS chars, least(200, length(text)) AS kept, round(least(200, length(text)) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0", lambda d: d.where("length(text) > 0").select("doc_id", F.length("text").cast("long").alias("chars"), F.least(F.lit(200), F.length("text")).cast("long").alias("kept"), F.round(F.least(F.lit(200), F.length("text")) / F.length("text"), 6).alias("ratio")))
_doc("dedupe_content_prefix", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(lower(text), 50)", lambda d: tables.first_rows(d.withColumn("_p", F.substring(F.lower("text"), 1, 50)), ["_p"], [F.col("doc_id")], 1).select("doc_id"))
_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> ''))"
_doc("token_set_size", f"SELECT doc_id, CAST(len({_TOK}) AS INT) AS n FROM documents", lambda d: d.select("doc_id", F.size(tokens(F.col("text"))).alias("n")))
_doc("word_tokens", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS INT) AS n FROM documents", lambda d: d.select("doc_id", F.size(word_tokens(F.col("text"))).alias("n")))
_doc(
    "jaccard_pairs",
    f"""WITH s AS (SELECT doc_id, unnest(w) AS w, len(w) AS n FROM (SELECT doc_id, {_TOK} AS w FROM documents)),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS size_a, any_value(b.n) AS size_b FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL), r AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort({_TOK})) AS rep FROM documents)
  SELECT a, b, CAST(common AS INT) AS both, CAST(size_a AS INT) AS size_a, CAST(size_b AS INT) AS size_b FROM p JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE x.rep = a AND (y.rep = b OR y.rep = a) AND 100 * common >= 90 * (size_a + size_b - common)""".replace("GROUP BY ALL", "GROUP BY a.doc_id, b.doc_id").replace("AS both", 'AS "both"'),
    lambda d: joins.jaccard_pairs(d.select(F.col("doc_id").alias("id"), "text"), 90),
)

_OVER = rf"""q AS (SELECT item_id AS query_id, unnest(w) AS w, len(w) AS n FROM (SELECT item_id, {_TOK} AS w FROM benchmark)),
  m AS (SELECT doc_id AS memory_id, unnest({_TOK}) AS w FROM documents),
  o AS (SELECT query_id, memory_id, any_value(n) AS n, count(*) AS overlap FROM q JOIN m USING (w) GROUP BY query_id, memory_id)"""


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return joins.keyword_overlap(asked, _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), "text"))


def _best_overlaps(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """(query_id, memory_id, overlap, query_size, rank): the ``k`` documents that share most tokens with an item."""
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("words"))
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), tokens(F.col("text")).alias("words"))
    found = sparse.lexical_top(asked, docs, k).join(asked.select("query_id", F.size("words").alias("query_size")), "query_id")
    return found.select("query_id", "memory_id", F.col("score").cast("long").alias("overlap"), "query_size", "rank")


def top_per_query(rows: DataFrame, score: str, k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "memory_id")))
    return ranked.where(F.col("rank") <= k)


def search_keyword_basic(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The best k documents of every question: overlap / question size >= 0.3, averaged with importance."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), sparse.weighed(tokens(F.col("text"))).alias("keys"), (scores.emotional_salience(F.col("text")) / 2).alias("base"))
    words = tokens(F.col("text"))
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), sparse.weighed(words, 0.5 / F.size(words)).alias("keys"))
    return sparse.sparse_top(asked, docs, k, digits=6, floor=0.15)


_add("keyword_overlap", f"WITH {_OVER} SELECT query_id, memory_id, CAST(n AS INT) AS query_size, overlap FROM o", _overlaps)
_add(
    "search_keyword_basic",
    f"""WITH {_OVER}, s AS (
  SELECT query_id, memory_id, round((overlap / n + greatest(0.1, least(1.0, 0.2 * {_mention_sql(lexicons.HIGH_EMOTION)} + 0.1 * {_mention_sql(lexicons.MEDIUM_EMOTION)}))) / 2, 6) AS score
  FROM o JOIN documents ON doc_id = memory_id WHERE overlap / n >= 0.3)
  SELECT * FROM (SELECT query_id, memory_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS INT) AS rank FROM s) WHERE rank <= 10""",
    search_keyword_basic,
)
_add(
    "topk_per_query",
    f"WITH {_OVER} SELECT * FROM (SELECT query_id, memory_id, overlap, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, memory_id) AS INT) AS rank FROM o) WHERE rank <= 5",
    lambda spark, d: _best_overlaps(spark, d, 5).select("query_id", "memory_id", "overlap", "rank"),
)
_add(
    "search_graph_text",
    f"WITH {_OVER} SELECT * FROM (SELECT query_id, memory_id, round(overlap / (n + 1), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(overlap / (n + 1), 6) DESC, memory_id) AS INT) AS rank FROM o) WHERE rank <= 10",
    lambda spark, d: _best_overlaps(spark, d, 10).select("query_id", "memory_id", F.round(F.col("overlap") / (F.col("query_size") + 1), 6).alias("score"), "rank"),
)
_add(
    "context_budget",
    f"""WITH {_OVER}, r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, memory_id) AS rank FROM o),
  c AS (SELECT query_id, memory_id, rank, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r JOIN documents ON doc_id = memory_id WHERE rank <= 20)
  SELECT query_id, memory_id, CAST(rank AS INT) AS rank, CAST(used AS BIGINT) AS used FROM c WHERE used <= 8000""",
    lambda spark, d: _best_overlaps(spark, d, 20)
    .join(_read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.length("text").cast("long").alias("chars")), "memory_id")
    .withColumn("used", F.sum("chars").over(Window.partitionBy("query_id").orderBy("rank")))
    .where("used <= 8000")
    .select("query_id", "memory_id", "rank", "used"),
)

_add(
    "context_budget_words",
    f"""WITH {_OVER}, r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, memory_id) AS rank FROM o),
  c AS (SELECT query_id, memory_id, rank, sum(1.3 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r JOIN documents ON doc_id = memory_id WHERE rank <= 20)
  SELECT query_id, memory_id, CAST(rank AS INT) AS rank, round(CAST(used AS DOUBLE), 6) AS used FROM c WHERE used <= 2000""",
    lambda spark, d: _best_overlaps(spark, d, 20)
    .join(_read(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), (1.3 * F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))).alias("words")), "memory_id")
    .withColumn("used", F.sum("words").over(Window.partitionBy("query_id").orderBy("rank")))
    .where("used <= 2000")
    .select("query_id", "memory_id", "rank", F.round("used", 6).alias("used")),
)

# ---- conversations as turns


def _turn(name: str, sql: str, build: Callable[[DataFrame], DataFrame]) -> None:
    _add(name, sql, lambda spark, d: build(_read(spark, d, "conversations")))


_turn("turns_from_chat", "SELECT conv_id AS session_id, turn AS seq, role AS speaker, text FROM conversations", lambda c: c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"), "text"))
_turn("stm_recent", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3", lambda c: tables.keep_last(c, ["conv_id"], [F.col("turn")], 3).select("conv_id", "turn"))
_turn("episodes_of_speaker", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn) AS r FROM conversations) WHERE r <= 2", lambda c: tables.first_rows(c.withColumn("_who", F.lower("role")), ["conv_id", "_who"], [F.col("turn")], 2).select("conv_id", "turn"))
_turn(
    "role_summary",
    "SELECT conv_id, string_agg(role || ': ' || n, ', ' ORDER BY f) AS summary FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY ALL) GROUP BY conv_id",
    lambda c: c.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("f")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "role", "n"))), lambda x: F.concat(x["role"], F.lit(": "), x["n"].cast("string"))), ", ").alias("summary")),
)
_turn(
    "session_transcript",
    "SELECT conv_id, string_agg('[' || role || ']: ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
    lambda c: c.withColumn("line", F.concat(F.lit("["), "role", F.lit("]: "), F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))))
    .groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("transcript")),
)
_turn("index_stats", "SELECT count(DISTINCT conv_id) AS sessions, count(DISTINCT role) AS speakers, count(*) AS turns FROM conversations", lambda c: c.agg(F.count_distinct("conv_id").alias("sessions"), F.count_distinct("role").alias("speakers"), F.count(F.lit(1)).alias("turns")))
_turn("sensory_filter", r"SELECT conv_id, turn FROM conversations WHERE length(trim(text)) >= 5 AND regexp_matches(text, '[A-Za-z]') AND NOT regexp_matches(lower(trim(text)), '^(" + "|".join(lexicons.STOP_PHRASES) + r")\b')", lambda c: c.where(scores.passes_sensory_filter(F.col("text"))).select("conv_id", "turn"))
_turn(
    "sensory_importance",
    f"SELECT conv_id, turn, round(least(1.0, 0.5 + CASE WHEN {_mention_sql(lexicons.FIRST_PERSON)} > 0 THEN 0.2 ELSE 0 END + CASE WHEN {_mention_sql(lexicons.EMPHATIC)} > 0 THEN 0.15 ELSE 0 END + CASE WHEN {_mention_sql(lexicons.TIME_WORDS)} > 0 THEN 0.1 ELSE 0 END + least(0.1, 0.02 * len(list_filter(regexp_split_to_array(text, " + r"'[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))))" + " + CASE WHEN len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) > 10 THEN 0.05 ELSE 0 END), 6) AS importance FROM conversations",
    lambda c: c.select("conv_id", "turn", F.round(scores.sensory_importance(F.col("text")), 6).alias("importance")),
)
_turn("keyword_capture", "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, text || CASE WHEN turn % 3 = 1 THEN ' I Always take tea' ELSE '' END AS text FROM conversations) WHERE role = 'assistant' AND length(text) > 100 AND " + _mention_sql(["prefer", "always", "never", "remember", "important"]) + " > 0", lambda c: c.withColumn("text", F.concat("text", F.when(F.col("turn") % 3 == 1, " I Always take tea").otherwise(""))).where((F.col("role") == "assistant") & (F.length("text") > 100) & (mentions(F.col("text"), ["prefer", "always", "never", "remember", "important"]) > 0)).select("conv_id", "turn"))

# ---- facts and graphs from the star schema

_ORDERS = "(SELECT o_orderkey AS fact_id, o_custkey AS subject, o_orderstatus AS object, o_orderdate AS dated FROM orders)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("dated"))


_add(
    "supersede_chain",
    f"""WITH c AS (SELECT *, lag(object) OVER (PARTITION BY subject ORDER BY dated, fact_id) AS prior FROM {_ORDERS}), k AS (SELECT * FROM c WHERE prior IS NULL OR prior <> object)
  SELECT fact_id, subject, object, lag(fact_id) OVER w AS supersedes, lead(fact_id) OVER w AS superseded_by, lead(fact_id) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY subject ORDER BY dated, fact_id)""",
    lambda spark, d: joins.supersede_chain(_history(spark, d), ["subject"], "object", ["dated", "fact_id"]).drop("dated"),
)
_add(
    "state_as_of",
    f"SELECT subject, arg_max(object, (dated, fact_id)) AS object FROM {_ORDERS} WHERE dated <= TIMESTAMP '1996-06-30' GROUP BY subject",
    lambda spark, d: joins.state_as_of(_history(spark, d), ["subject"], "dated", ["dated", "fact_id"], F.lit("1996-06-30").cast("timestamp_ntz")).select("subject", "object"),
)
_add(
    "fact_store_stats",
    f"SELECT count(*) AS total, count(*) FILTER (later IS NULL) AS current, count(*) FILTER (later IS NOT NULL) AS superseded, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM (SELECT *, lead(fact_id) OVER (PARTITION BY subject ORDER BY dated, fact_id) AS later FROM {_ORDERS})",
    lambda spark, d: _history(spark, d).withColumn("later", F.lead("fact_id").over(Window.partitionBy("subject").orderBy("dated", "fact_id"))).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("later").isNull()).alias("current"), F.count("later").alias("superseded"), F.count_distinct("subject").alias("subjects"), F.count_distinct("object").alias("objects")),
)
_EDGES = "(SELECT 's' || s_suppkey AS source, 'located_in' AS relation, 'n' || s_nationkey AS target FROM supplier UNION ALL SELECT 'c' || c_custkey, 'lives_in', 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def some(table: str, a: str, key: str, relation: str, b: str, to: str) -> DataFrame:
        return _read(spark, sf_dir, table).select(F.concat(F.lit(a), F.col(key).cast("string")).alias("source"), F.lit(relation).alias("relation"), F.concat(F.lit(b), F.col(to).cast("string")).alias("target"))

    return some("supplier", "s", "s_suppkey", "located_in", "n", "s_nationkey").unionAll(some("customer", "c", "c_custkey", "lives_in", "n", "c_nationkey")).unionAll(some("nation", "n", "n_nationkey", "part_of", "r", "n_regionkey"))


_add("concept_degree", f"SELECT node, count(*) AS degree FROM (SELECT source AS node FROM {_EDGES} UNION ALL SELECT target FROM {_EDGES}) GROUP BY node", lambda spark, d: graph.degree(edges(spark, d)))
_add("kg_match", f"SELECT source, relation, target FROM {_EDGES} WHERE source = 'n3' OR target = 'n3'", lambda spark, d: graph.match(edges(spark, d), entity="n3"))
_add(
    "vector_knn",
    """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS similarity FROM q CROSS JOIN embeddings)
  SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.1) WHERE rank <= 5""",
    lambda spark, d: (lambda e: joins.vector_knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 5, 0.1).withColumn("similarity", F.round("similarity", 6)))(_read(spark, d, "embeddings")),
)
def _norm_sql(text: str) -> str:
    """Lower case without articles (twice, as neighbours share a boundary) and punctuation, blanks squeezed."""
    bare = f"lower({text})"
    for _ in range(2):
        bare = rf"regexp_replace({bare}, '(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'), ' ')"


_add(
    "token_f1",
    rf"""WITH p AS (SELECT item_id, text FROM benchmark), n AS (SELECT item_id, list_distinct(list_filter(string_split({_norm_sql('text')}, ' '), lambda w: w <> '')) AS w FROM p),
  b AS (SELECT a.item_id, a.w AS x, b.w AS y FROM n a JOIN n b ON b.item_id = a.item_id + 1)
  SELECT item_id, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 2 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 6) AS f1 FROM b""",
    lambda spark, d: (lambda b: b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("truth")), "item_id").select("item_id", F.round(evaluation.token_f1(F.col("text"), F.col("truth")), 6).alias("f1")))(_read(spark, d, "benchmark")),
)


# ---- extraction from sentences with a known truth, and questions

_SAID = "(SELECT c_custkey, c_custkey % 9 + 1 AS years, CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(left(r_name, 1)) || lower(substr(r_name, 2)) END AS place, lower(c_mktsegment) AS thing FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence pair of every customer, built from its columns."""
    customer, nation, region = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    years = (F.col("c_custkey") % 9 + 1).cast("string")
    return shared.spread(rows.select("c_custkey", F.concat(F.lit("I moved from "), F.initcap("r_name"), F.lit(" "), years, F.lit(" years ago. I like "), F.lower("c_mktsegment"), F.lit(".")).alias("text")), "c_custkey")


_add(
    "resolve_first_person",
    f"SELECT c_custkey, 'Ann moved from ' || place || ' ' || years || ' years ago. Ann like ' || thing || '.' AS text FROM {_SAID}",
    lambda spark, d: said(spark, d).select("c_custkey", extract.resolve_first_person(F.col("text"), F.lit("Ann")).alias("text")),
)
_add(
    "strip_timestamps",
    f"SELECT c_custkey, 'I moved from ' || place || ' ' || years || ' years ago. I like ' || thing || '.' AS text FROM {_SAID}",
    lambda spark, d: said(spark, d).select("c_custkey", extract.strip_timestamps(F.concat(F.lit("[1:56 pm on 8 May, 2023] "), "text")).alias("text")),
)
_add(
    "parse_date_any", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    lambda spark, d: _read(spark, d, "orders").select("o_orderkey", extract.parse_date_any(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))).cast("string").alias("day")),
)
_add(
    "as_statement", "SELECT c_custkey, 'customer ' || c_custkey || ' lives in ' || c_nationkey AS statement FROM customer",
    lambda spark, d: _read(spark, d, "customer").select("c_custkey", extract.as_statement(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.lit("lives_in"), F.col("c_nationkey").cast("string")).alias("statement")),
)


def _intent_sql(table: str, key: str) -> str:
    parts = []
    for i, (name, weight, keywords, patterns) in enumerate(intents.INTENTS):
        total = _mention_sql(keywords) + "".join(f" + 1.5 * regexp_matches(lower(text), '{p}')::INT" for p in patterns)
        parts.append(f"SELECT {key}, '{name}' AS intent, {-i} AS o, {weight} * ({total}) AS score FROM {table}")
    return f"SELECT {key}, CASE WHEN max(score) > 0 THEN arg_max(intent, (score, o)) ELSE 'general' END AS intent, CAST(round(CASE WHEN max(score) > 0 THEN least(1.0, max(score) / 3) ELSE 0.3 END, 6) AS DOUBLE) AS confidence FROM ({' UNION ALL '.join(parts)}) GROUP BY {key}"


_turn("classify_intent", _intent_sql("conversations", "conv_id, turn"), lambda c: c.withColumn("i", intents.classify_intent(F.col("text"))).select("conv_id", "turn", "i.intent", F.round("i.confidence", 6).alias("confidence")))

# ---- lifecycle

_turn(
    "units_all_levels",
    """WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS follows FROM conversations)
  SELECT 'utterance' AS level, 'u' || conv_id || '_' || turn AS unit_id, 's' || conv_id AS parent_id, conv_id AS session_id FROM t
  UNION ALL SELECT 'turn', 't' || conv_id || '_' || turn, 's' || conv_id, conv_id FROM t WHERE role = 'user' AND follows = 'assistant'
  UNION ALL SELECT DISTINCT 'session', 's' || conv_id, NULL, conv_id FROM t""",
    lambda c: lifecycle.units_all_levels(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("speaker"))),
)
# ---- streams, each run over all events that are there

_add(
    "stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events",
    lambda spark, d: events.drain(events.dedupe(events.event_stream(spark, d), ["user_id", "event_type"], "60 days").select("user_id", "event_type"), events.work_folder(spark)),
)
_add(
    "stream_latest_fact",
    "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
    lambda spark, d: events.latest(events.event_stream(spark, d).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", events.work_folder(spark)),
)
_add(
    "stream_windowed_counts",
    "SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    lambda spark, d: events.drain(events.windowed_counts(events.event_stream(spark, d), "event_type", "1 day", "1 hour"), events.work_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")),
)
_add(
    "stream_closed_windows",
    "SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    lambda spark, d: events.drain(events.windowed_counts(events.event_stream(spark, d), "event_type", "1 hour", "10 minutes"), events.work_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")),
)
_add(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, TRUE)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    lambda spark, d: events.drain(events.sessions(events.event_stream(spark, d), "user_id", "6 hours", "10 minutes"), events.work_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")),
)

# ---- rollups, rankings and question terms


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every question: documents that share a token, scored by overlap / (n + 1), with how the text begins and its length, not itself."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), "lang", F.substring(F.lower("text"), 1, 50).alias("head"), F.length("text").alias("chars"))
    return _overlaps(spark, sf_dir).withColumn("score", F.round(F.col("overlap") / (F.col("query_size") + 1), 6)).join(docs, "memory_id")


def _best_scored(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The ``k`` best of ``_scored`` of every question; texts are joined to those only."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    return shared.cut(_best_overlaps(spark, sf_dir, k)).withColumn("score", F.round(F.col("overlap") / (F.col("query_size") + 1), 6)).join(docs, "memory_id")


_SCORED = f"WITH {_OVER}, s AS (SELECT query_id, memory_id, lang, text, round(overlap / (n + 1), 6) AS score FROM o JOIN documents ON doc_id = memory_id)"
_add(
    "per_tier_cap",
    f"""{_SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, memory_id) AS r FROM s)
  SELECT query_id, memory_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM t WHERE r <= 5) WHERE rank <= 10""",
    lambda spark, d: ranking.per_tier_cap(_scored(spark, d), "lang").select("query_id", "memory_id", "rank"),
)
_add(
    "dedupe_first",
    f"{_SCORED} SELECT query_id, memory_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, left(lower(text), 50) ORDER BY score DESC, memory_id) AS r FROM s) WHERE r = 1",
    lambda spark, d: ranking.dedupe_first(_scored(spark, d).withColumn("_s", -F.col("score")), "head", ["_s", "memory_id"]).select("query_id", "memory_id"),
)
_add(
    "diversity_bonus",
    f"{_SCORED} SELECT query_id, memory_id, round(score + CASE WHEN row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, memory_id) = 1 THEN 0.1 ELSE 0 END, 6) AS score FROM s",
    lambda spark, d: ranking.diversity_bonus(_scored(spark, d), "lang").select("query_id", "memory_id", F.round("score", 6).alias("score")),
)
_add(
    "mmr_rerank",
    rf"""WITH RECURSIVE {_SCORED.removeprefix("WITH ")}, cc AS MATERIALIZED (SELECT query_id, memory_id, score, {_TOK} AS w FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS r FROM s) WHERE r <= 20),
  k AS MATERIALIZED (SELECT a.query_id, a.memory_id, any_value(a.score) AS score, list(b.memory_id ORDER BY b.memory_id) AS ids, list(CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ELSE 0 END ORDER BY b.memory_id) AS near FROM cc a JOIN cc b ON a.query_id = b.query_id GROUP BY a.query_id, a.memory_id),
  z AS (SELECT query_id, []::BIGINT[] AS picked, 0::BIGINT AS memory_id, 0::DOUBLE AS value, 0 AS rank FROM (SELECT DISTINCT query_id FROM k) UNION ALL
    SELECT query_id, list_append(picked, memory_id), memory_id, score - 0.3 * penalty, rank + 1 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * score - 0.3 * penalty DESC, memory_id) AS r FROM (
      SELECT z.query_id, picked, k.memory_id, score, rank, coalesce(list_max(list_transform(picked, lambda p: near[list_position(ids, p)])), 0) AS penalty FROM z JOIN k ON k.query_id = z.query_id AND NOT list_contains(picked, k.memory_id))) WHERE r = 1)
  SELECT query_id, memory_id, round(value, 6) AS score, rank FROM z WHERE rank > 0""",
    lambda spark, d: ranking.mmr_rerank(_best_scored(spark, d, 20), most=20).withColumn("score", F.round("score", 6)),
)
_add(
    "rank_shift",
    f"{_SCORED} SELECT query_id, memory_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - row_number() OVER (PARTITION BY query_id ORDER BY score * (1 + 1.0 / length(text)) DESC, memory_id) AS INT) AS shift FROM s WHERE length(text) > 0",
    lambda spark, d: _scored(spark, d).where("chars > 0")
    .withColumn("shift", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")) - F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col("score") * (1 + 1.0 / F.col("chars"))), "memory_id")))
    .select("query_id", "memory_id", "shift"),
)
_add(
    "load_graph_tables",
    "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
    lambda spark, d: (lambda s, n, r: s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name"))(*(_read(spark, d, t) for t in ("supplier", "nation", "region"))),
)
_add(
    "evidence_join", "SELECT d.doc_id, quality, quality IS NOT NULL AS known FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    lambda spark, d: _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("known", F.col("quality").isNotNull()),
)
_add(
    "facts_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    lambda spark, d: _read(spark, d, "documents").select("doc_id").join(_read(spark, d, "labels").select("doc_id"), "doc_id", "left_anti"),
)
_doc("capitalised_names", r"SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND w NOT IN ('What', 'When', 'Where', 'Who', 'How', 'Why')))) AS INT) AS n FROM documents", lambda d: d.select("doc_id", F.size(F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b([A-Z][a-z]+)\b"), F.lit(1))), F.lit(["What", "When", "Where", "Who", "How", "Why"]))).alias("n")))
_doc("first_sentence_summary", "SELECT doc_id, left(split_part(text, '.', 1), 200) AS summary FROM documents", lambda d: d.select("doc_id", F.substring(F.split_part("text", F.lit("."), F.lit(1)), 1, 200).alias("summary")))
_doc(
    "latest_update_dedupe",
    rf"""WITH k AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')[1:10]))[1:5], '_') AS k FROM documents)
  SELECT max(doc_id) AS doc_id FROM k GROUP BY k""",
    lambda d: d.withColumn("k", F.array_join(F.slice(F.array_sort(F.array_distinct(F.slice(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), 1, 10))), 1, 5), "_")).groupBy("k").agg(F.max("doc_id").alias("doc_id")).select("doc_id"),
)
_doc("compression", "SELECT lang, count(*) AS n, round(sum(least(200, length(text)))::DOUBLE / sum(length(text)), 6) AS ratio FROM documents GROUP BY lang", lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.least(F.lit(200), F.length("text"))) / F.sum(F.length("text")), 6).alias("ratio")))
_mem(
    "duration_parts",
    "SELECT id, d // 365 AS years, d % 365 // 30 AS months, d % 365 % 30 // 7 AS weeks, d % 365 % 30 % 7 AS days FROM (SELECT id, id % 2000 AS d FROM MEM)",
    lambda m: m.select("id", scores.duration_parts(F.col("id") % 2000).alias("p")).select("id", "p.*"),
)
_mem("store_filters", "SELECT id, CASE WHEN importance >= 0.8 THEN 'long_term' WHEN importance >= 0.4 THEN 'short_term' ELSE 'none' END AS tier FROM MEM", lambda m: m.select("id", F.when(F.col("importance") >= 0.8, "long_term").when(F.col("importance") >= 0.4, "short_term").otherwise("none").alias("tier")))
_mem(
    "decay_pass",
    f"SELECT id, round(strength, 6) AS old, round({_clamp('strength * exp(-' + _slow('0.01', 'importance + 0.5') + ' * hours)')}, 6) AS strength FROM MEM",
    lambda m: m.select("id", F.round("strength", 6).alias("old"), F.round(scores.strength_now(F.col("strength"), F.col("importance"), F.col("access_count"), F.col("hours"), 0.01), 6).alias("strength")),
)
_turn("stm_by_role", "SELECT conv_id, turn FROM conversations WHERE role = 'user'", lambda c: c.where(tables.where_spec({"role": "user"})).select("conv_id", "turn"))
_TOPIC = "SELECT doc_id, coalesce(arg_max(topic, (n, -o)) FILTER (n > 0), 'general') AS topic FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic, {i} AS o, {_mention_sql(kw)} AS n FROM documents" for i, (t, kw) in enumerate(lexicons.TOPICS.items())) + ") GROUP BY doc_id"
_doc(
    "topic_digest",
    f"SELECT topic, string_agg(text, '; ' ORDER BY doc_id) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS r FROM documents JOIN ({_TOPIC}) USING (doc_id)) WHERE r <= 5 GROUP BY topic",
    lambda d: tables.first_rows(d.select("doc_id", "text", scores.topic_of(F.col("text")).alias("topic")), ["topic"], [F.col("doc_id")], 5).groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "; ").alias("digest")),
)
_doc("tier_stats", f"SELECT topic, count(*) AS items, count(DISTINCT source) AS speakers, count(DISTINCT lang) AS langs FROM documents JOIN ({_TOPIC}) USING (doc_id) GROUP BY topic", lambda d: d.withColumn("topic", scores.topic_of(F.col("text"))).groupBy("topic").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("source").alias("speakers"), F.count_distinct("lang").alias("langs")))
