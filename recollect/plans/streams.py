"""Registered streams with keyed state, and the log of changes between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.plans.catalog import MEM, _add, memories
from recollect.streaming import changes, events, tiers

# ---- the sensory buffer: fifteen agents, a month of events replayed in three minutes

LAPSE = 15_000


def _sensory(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = events.event_stream(spark, sf_dir)
    replayed = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / LAPSE))
    stream = stream.select((F.col("user_id") % 15).alias("agent"), replayed.alias("ts"), "event_id")
    with tiers.rocksdb(spark):
        return events.drain(tiers.sensory_stream(stream, seconds=60, most=100, late="5 seconds"), events.work_folder(spark))


_add(
    "stream_sensory",
    f"""WITH e AS (SELECT user_id % 15 AS agent, event_id, CAST(floor(floor(epoch(ts)) / {LAPSE}) AS BIGINT) AS "at" FROM events),
  n AS (SELECT *, lead("at", 100) OVER (PARTITION BY agent ORDER BY "at", event_id) AS pushed FROM e)
  SELECT agent, event_id, CASE WHEN pushed <= "at" + 60 THEN pushed ELSE "at" + 60 END AS left_at, CASE WHEN pushed <= "at" + 60 THEN 'overflow' ELSE 'expired' END AS reason
  FROM n WHERE "at" + 60 <= (SELECT max("at") FROM e) - 5""",
    _sensory,
)

# ---- short-term memory: a user's views and clicks access the topic, the others store an item


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic = (F.regexp_extract("props", "[0-9]+", 0).cast("long") % 4).cast("string")
    stream = events.event_stream(spark, sf_dir).select(
        F.col("user_id").alias("agent"), "ts", "event_id", topic.alias("topic"), F.least(F.lit(1000), F.floor(F.col("value") * 10)).alias("importance"), F.col("event_type").isin("click", "view").alias("access")
    )
    with tiers.rocksdb(spark):
        return events.drain(tiers.tier_stream(stream, capacity=20, decay=100, gain=200, late="1 hour"), events.work_folder(spark))


_ITEM = "STRUCT(id BIGINT, topic VARCHAR, imp BIGINT, act BIGINT, reh BIGINT, up BOOLEAN)"
_STEPS = f"""WITH RECURSIVE e AS (
    SELECT *, row_number() OVER (PARTITION BY agent ORDER BY "at", id) AS k, ("at" // 3600 + 1) * 3600 AS tick FROM (
      SELECT user_id AS agent, event_id AS id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4 AS VARCHAR) AS topic,
        least(1000, CAST(floor(value * 10) AS BIGINT)) AS imp, event_type IN ('click', 'view') AS access FROM events)
  ), aged AS (
    SELECT agent, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS tick, CAST(0 AS BIGINT) AS "at", CAST([] AS {_ITEM}[]) AS items, CAST(NULL AS BIGINT) AS evicted, CAST(0 AS BIGINT) AS accessed, CAST(NULL AS BIGINT) AS stored FROM (SELECT DISTINCT agent FROM e)
    UNION ALL
    SELECT agent, k, tick, "at",
      CASE WHEN access THEN list_transform(now, lambda x: {{'id': x.id, 'topic': x.topic, 'imp': x.imp, 'act': CASE WHEN x.topic = topic THEN least(1000, x.act + 200) ELSE x.act END, 'reh': x.reh + CASE WHEN x.topic = topic THEN 1 ELSE 0 END, 'up': x.up}})
        ELSE list_append(CASE WHEN out IS NULL THEN now ELSE list_concat(now[1:out - 1], now[out + 1:]) END, {{'id': id, 'topic': topic, 'imp': imp, 'act': CAST(1000 AS BIGINT), 'reh': CAST(0 AS BIGINT), 'up': imp >= 800}}) END,
      CASE WHEN out IS NOT NULL THEN now[out].id END, CASE WHEN access THEN len(list_filter(now, lambda x: x.topic = topic)) ELSE 0 END, CASE WHEN NOT access AND imp >= 800 THEN id END
    FROM (
      SELECT *, CASE WHEN NOT access AND len(now) >= 20 THEN list_position(list_transform(now, lambda x: x.act * x.imp), list_min(list_transform(now, lambda x: x.act * x.imp))) END AS out FROM (
        SELECT e.*, CASE WHEN aged.tick IN (0, e.tick) THEN items ELSE list_transform(items, lambda x: {{'id': x.id, 'topic': x.topic, 'imp': x.imp, 'act': greatest(0, x.act - 100 * ((e.tick - aged.tick) // 3600)), 'reh': x.reh, 'up': x.up OR (x.imp >= 600 AND x.reh >= 2)}}) END AS now
        FROM aged JOIN e ON e.agent = aged.agent AND e.k = aged.k + 1))
  ), done AS (SELECT * FROM aged WHERE k > 0 AND tick <= (SELECT max(epoch(ts)) FROM events) - 3600),
  ends AS (SELECT agent, tick, arg_max(items, k) AS items, CAST(sum(accessed) AS BIGINT) AS accessed FROM done GROUP BY agent, tick)"""
_add(
    "stream_stm",
    f"""{_STEPS} SELECT agent, tick, 'evicted' AS change, evicted AS event_id, "at", CAST(NULL AS BIGINT) AS items, CAST(NULL AS BIGINT) AS accessed FROM done WHERE evicted IS NOT NULL
  UNION ALL SELECT agent, tick, 'tick', NULL, tick, len(items), accessed FROM ends""",
    lambda spark, d: _tiers(spark, d).where("change <> 'promoted'").select("agent", "tick", "change", "event_id", "at", "items", "accessed"),
)
_add(
    "stream_tick",
    f"""{_STEPS} SELECT agent, tick, 'promoted' AS change, stored AS event_id, "at", CAST(NULL AS BIGINT) AS activation FROM done WHERE stored IS NOT NULL
  UNION ALL SELECT agent, tick, 'promoted', x.id, tick, NULL FROM (SELECT agent, tick, unnest(items) AS x FROM ends) WHERE NOT x.up AND x.imp >= 600 AND x.reh >= 2
  UNION ALL SELECT agent, tick, 'tick', NULL, tick, CAST(coalesce(list_sum(list_transform(items, lambda x: greatest(0, x.act - 100))), 0) AS BIGINT) FROM ends""",
    lambda spark, d: _tiers(spark, d).where("change <> 'evicted'").select("agent", "tick", "change", "event_id", "at", "activation"),
)

# ---- events between two versions


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Memories before and after a maintenance run: some rows come, some go, others age, are read, retyped, merged, promoted."""
    m = memories(spark, sf_dir).withColumns({"updated_at": F.col("created_at"), "merged_into": F.lit(None).cast("long"), "memory_type": F.when(F.col("memory_type") == "view", "short_term").otherwise(F.col("memory_type"))})
    i = F.col("id")
    after = m.where("id % 13 <> 0").withColumns({
        "updated_at": F.col("created_at") + F.expr("INTERVAL 2 HOURS"), "strength": F.when(i % 3 == 0, F.col("strength") * 0.5).otherwise(F.col("strength")), "access_count": F.col("access_count") + F.when(i % 11 == 0, 1).otherwise(0),
        "is_active": F.col("is_active") & (i % 10 != 0), "is_consolidated": F.col("is_consolidated") | (i % 4 == 0), "merged_into": F.when(i % 23 == 0, i + 1),
        "memory_type": F.when(i % 19 == 0, "retyped").otherwise(F.col("memory_type")),
    })
    return m.where("id % 17 <> 0"), after


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = events.work_folder(spark)
    before, after = versions(spark, sf_dir)
    log = changes.change_log(before, after, "consolidate")
    changes.publish(log, f"{folder}/log", 1)
    return changes.log_stream(log, f"{folder}/log")


_LOG = f"""m AS (SELECT * REPLACE (CASE memory_type WHEN 'view' THEN 'short_term' ELSE memory_type END AS memory_type) FROM {MEM}),
  o AS (SELECT * FROM m WHERE id % 17 <> 0),
  n AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN strength * 0.5 ELSE strength END AS strength, access_count + (id % 11 = 0)::BIGINT AS access_count, is_active AND id % 10 <> 0 AS is_active, is_consolidated OR id % 4 = 0 AS is_consolidated,
    CASE WHEN id % 19 = 0 THEN 'retyped' ELSE memory_type END AS memory_type, created_at + INTERVAL 2 HOUR AS created_at) FROM m WHERE id % 13 <> 0),
  j AS (SELECT o.*, n.* FROM o JOIN n ON o.id = n.id),
  l AS (
    SELECT 'memory_created' AS event, created_at AS "at", id AS memory_id, memory_type, CAST(NULL AS DOUBLE) AS old, strength AS new FROM n WHERE id % 17 = 0
    UNION ALL SELECT 'memory_deleted', created_at, id, memory_type, strength, NULL FROM o WHERE id % 13 = 0
    UNION ALL SELECT CASE WHEN n.strength < 0.1 THEN 'memory_garbage_collected' ELSE 'memory_deleted' END, n.created_at, n.id, n.memory_type, CASE WHEN n.strength >= 0.1 THEN o.strength END, NULL FROM o JOIN n USING (id) WHERE o.is_active AND NOT n.is_active
    UNION ALL SELECT 'memory_accessed', n.created_at, n.id, n.memory_type, o.access_count, n.access_count FROM o JOIN n USING (id) WHERE id % 11 = 0
    UNION ALL SELECT 'decay_updated', n.created_at, n.id, n.memory_type, o.strength, n.strength FROM o JOIN n USING (id) WHERE id % 3 = 0 AND o.strength > 0
    UNION ALL SELECT 'strength_below_threshold', n.created_at, n.id, n.memory_type, o.strength, n.strength FROM o JOIN n USING (id) WHERE o.strength >= 0.1 AND n.strength < 0.1
    UNION ALL SELECT CASE WHEN o.memory_type = 'short_term' THEN 'stm_promoted' ELSE 'episodic_promoted' END, n.created_at, n.id, n.memory_type, NULL, NULL FROM o JOIN n USING (id) WHERE NOT o.is_consolidated AND n.is_consolidated
    UNION ALL SELECT 'memory_merged', n.created_at, n.id, n.memory_type, NULL, n.id + 1 FROM o JOIN n USING (id) WHERE id % 23 = 0
    UNION ALL SELECT 'memory_updated', n.created_at, n.id, n.memory_type, NULL, NULL FROM o JOIN n USING (id) WHERE id % 19 = 0
  ), a AS (SELECT * FROM l UNION ALL SELECT 'consolidation_started', min("at"), NULL, NULL, NULL, NULL FROM l UNION ALL SELECT 'consolidation_completed', max("at"), NULL, NULL, NULL, count(*) FROM l)"""
_add("stream_events", f"WITH {_LOG} SELECT event, \"at\", memory_id, memory_type, round(old, 6) AS old, round(new, 6) AS new FROM a", lambda spark, d: events.drain(_logged(spark, d), events.work_folder(spark)).select("event", F.col("at").cast("timestamp_ntz").alias("at"), "memory_id", "memory_type", F.round("old", 6).alias("old"), F.round("new", 6).alias("new")))
_add(
    "stream_event_counts",
    f"WITH {_LOG} SELECT * FROM (SELECT event, time_bucket(INTERVAL 1 HOUR, \"at\") AS start, count(*) AS n FROM a GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(\"at\") FROM a) - INTERVAL 10 MINUTE",
    lambda spark, d: events.drain(changes.event_counts(_logged(spark, d)), events.work_folder(spark)).withColumn("start", F.col("start").cast("timestamp_ntz")),
)
