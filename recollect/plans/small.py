"""Registered queries of scores, filters, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import extract, scores
from recollect.functions.tokens import tokens
from recollect.operators import evaluation, facts, tables
from recollect.plans.catalog import _TOK, _add, _doc, _mem, _mention_sql, _norm_sql, _read, _turn
from recollect.plans.conflicts import _fact

# ---- scores

_doc("causal_significance", f"SELECT doc_id, round(greatest(0.2, least(1.0, 0.15 * {_mention_sql(scores.HIGH_CAUSAL)} + 0.08 * {_mention_sql(scores.MEDIUM_CAUSAL)})), 6) AS causal FROM documents", lambda d: d.select("doc_id", F.round(scores.causal_significance(F.col("text")), 6).alias("causal")))
_KINDS = list(scores.CONTENT_BOOST)
_mem(
    "content_boost",
    "SELECT id, " + ", ".join(f"CASE id % {len(_KINDS)} " + " ".join(f"WHEN {i} THEN {v[j]}" for i, v in enumerate(scores.CONTENT_BOOST.values())) + f" END::DOUBLE AS {n}" for j, n in enumerate(("emotional_salience", "novelty", "causal_significance"))) + " FROM MEM",
    lambda m: m.withColumn("kind", F.element_at(F.lit(_KINDS), (F.col("id") % len(_KINDS) + 1).cast("int"))).select("id", *[c.alias(n) for n, c in scores.content_boost(F.col("kind")).items()]),
)
_mem("mark_important", "SELECT id, round(greatest(0.0, least(1.0, importance * 3 - 1)), 6) AS user_marked FROM MEM", lambda m: m.select("id", F.round(scores.mark_important(F.col("importance") * 3 - 1), 6).alias("user_marked")))


def _plural_sql(n: str, unit: str) -> str:
    return f"({n}) || CASE WHEN ({n}) = 1 THEN ' {unit}' ELSE ' {unit}s' END"


_YEARS, _MONTHS = "d // 365", "d % 365 // 30"
_AUTO = f"CASE WHEN {_YEARS} > 0 AND {_MONTHS} > 0 THEN {_plural_sql(_YEARS, 'year')} || ' and ' || {_plural_sql(_MONTHS, 'month')} WHEN {_YEARS} > 0 THEN {_plural_sql(_YEARS, 'year')} WHEN {_MONTHS} > 0 THEN {_plural_sql(_MONTHS, 'month')} WHEN d > 0 THEN {_plural_sql('d', 'day')} ELSE 'today' END"
_mem(
    "format_duration",
    f"SELECT id, {_AUTO} AS auto, {_plural_sql(_YEARS, 'year')} AS years, {_plural_sql(f'{_YEARS} * 12 + {_MONTHS}', 'month')} AS months, {_plural_sql('d', 'day')} AS days FROM (SELECT id, id % 2000 AS d FROM MEM)",
    lambda m: m.select("id", *[scores.format_duration(F.col("id") % 2000, p).alias(p) for p in ("auto", "years", "months", "days")]),
)
_add(
    "multi_format_duration",
    f"SELECT o_orderkey, {_AUTO} AS duration, {_AUTO} || ' ago' AS ago, 'since ' || strftime(o_orderdate, '%B %Y') AS since, strftime(o_orderdate, '%d %B %Y') AS day FROM (SELECT *, date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') AS d FROM orders)",
    lambda spark, d: _read(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in scores.multi_format_duration(F.col("o_orderdate"), F.lit("2000-01-01").cast("date")).items()]),
)
_turn(
    "max_overlap_novelty",
    rf"""WITH t AS (SELECT conv_id, turn, {_TOK} AS w FROM conversations), p AS (SELECT b.conv_id, b.turn, max(len(list_intersect(a.w, b.w)) / greatest(len(a.w), len(b.w))) AS o FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) > 0 GROUP BY ALL)
  SELECT t.conv_id, t.turn, round(CASE WHEN o IS NULL THEN 0.8 ELSE greatest(0.1, 1 - o) END, 6) AS novelty FROM t LEFT JOIN p USING (conv_id, turn)""",
    lambda c: (lambda t: t.join(t.select("conv_id", F.col("turn").alias("before"), F.col("w").alias("v")).where("size(v) > 0"), "conv_id").where("before < turn").groupBy("conv_id", "turn").agg(F.max(F.size(F.array_intersect("w", "v")) / F.greatest(F.size("w"), F.size("v"))).alias("o"))
               .join(t, ["conv_id", "turn"], "right").select("conv_id", "turn", F.round(F.when(F.col("o").isNull(), 0.8).otherwise(F.greatest(F.lit(0.1), 1 - F.col("o"))), 6).alias("novelty")))(c.select("conv_id", "turn", tokens(F.col("text")).alias("w"))),
)

# ---- filters and updates

_mem("filter_memories", "SELECT id FROM MEM WHERE is_active AND memory_type IN ('click', 'view') AND user_id = 7", lambda m: m.where(F.col("is_active") & tables.where_spec({"memory_type": ["click", "view"], "user_id": 7})).select("id"))
_mem("query_by_scope", "SELECT id, created_at FROM MEM WHERE user_id = 7 AND memory_type = 'click' ORDER BY created_at DESC", lambda m: m.where(tables.where_spec({"user_id": 7, "memory_type": "click"})).orderBy(F.desc("created_at")).select("id", "created_at"))
_mem("hard_delete", "SELECT id FROM MEM WHERE strength >= 0.1", lambda m: tables.delete_many(m, m.where("strength < 0.1")).select("id"))
_mem("create_many", "SELECT id, memory_type FROM MEM UNION ALL SELECT id + 1000000000, 'copied' FROM MEM WHERE user_id = 7", lambda m: m.select("id", "memory_type").unionByName(m.where("user_id = 7").select((F.col("id") + 1000000000).alias("id"), F.lit("copied").alias("memory_type"))))
_mem("time_filter_span", "SELECT id FROM MEM WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-09'", lambda m: tables.query_by_time_range(m, "2024-01-05", "2024-01-09").select("id"))
_mem("evict_oldest", "SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) - 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS r FROM MEM) WHERE r > 5", lambda m: tables.evict_oldest(m, ["user_id"], ["created_at", "id"], 5).select("id", "seq"))
_mem(
    "evict_lowest_activation", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY round(strength * (importance + 0.1), 9) DESC, id) AS r FROM MEM) WHERE r <= 20",
    lambda m: tables.first_rows(m, ["user_id"], [F.round(F.col("strength") * (F.col("importance") + 0.1), 9).desc(), F.asc("id")], 20).select("id"),
)
_fact("facts_about", "SELECT fact_id FROM FACTS WHERE lower(subject) = 'c7' AND is_current", lambda f: facts.facts_about(f.withColumn("fact_type", F.col("predicate")), "C7").select("fact_id"))
_fact("facts_by_subject", "SELECT fact_id FROM FACTS WHERE contains(lower(subject), 'c1')", lambda f: f.where(F.contains(F.lower("subject"), F.lit("c1"))).select("fact_id"))
_fact("preferences", "SELECT fact_id, subject, object FROM FACTS WHERE predicate IN ('likes', 'Disliked', 'enjoys')", lambda f: f.where(F.col("predicate").isin("likes", "Disliked", "enjoys")).select("fact_id", "subject", "object"))
_fact(
    "fact_valid_at",
    "SELECT fact_id FROM (SELECT fact_id, created_at, lead(created_at) OVER (PARTITION BY subject, predicate ORDER BY created_at, fact_id) AS until FROM FACTS) WHERE created_at <= TIMESTAMP '1996-06-30' AND (until IS NULL OR until >= TIMESTAMP '1996-06-30')",
    lambda f: facts.valid_at(f.withColumn("valid_from", F.col("created_at")).withColumn("valid_until", F.lead("created_at").over(Window.partitionBy("subject", "predicate").orderBy("created_at", "fact_id"))), F.lit("1996-06-30").cast("timestamp_ntz")).select("fact_id"),
)
_fact(
    "merge_rule_and_given_facts",
    "SELECT fact_id FROM (SELECT fact_id, row_number() OVER (PARTITION BY lower(subject), lower(predicate), lower(object) ORDER BY fact_id % 2, fact_id) AS r FROM FACTS) WHERE r = 1",
    lambda f: facts.merge_sets(f.where("fact_id % 2 = 0"), f.where("fact_id % 2 = 1"), ["subject", "predicate", "object"]).select("fact_id"),
)
_fact(
    "facts_not_in_set",
    "SELECT fact_id FROM FACTS f WHERE fact_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM FACTS g WHERE g.fact_id % 2 = 0 AND g.subject = f.subject AND g.predicate = f.predicate AND g.object = f.object)",
    lambda f: f.where("fact_id % 2 = 1").join(f.where("fact_id % 2 = 0").select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_anti").select("fact_id"),
)
_fact(
    "fact_strengthen_all", "SELECT fact_id, round(least(1.0, confidence + 0.1), 6) AS confidence, access_count + 1 AS evidence, round(avg(least(1.0, confidence + 0.1)) OVER (PARTITION BY subject), 6) AS overall FROM FACTS",
    lambda f: f.select("fact_id", F.round(scores.fact_strengthen(F.col("confidence")), 6).alias("confidence"), (F.col("access_count") + 1).alias("evidence"), F.round(F.avg(scores.fact_strengthen(F.col("confidence"))).over(Window.partitionBy("subject")), 6).alias("overall")),
)
_doc("flatten_metadata", "SELECT doc_id, lang AS \"about.lang\", source AS \"about.more.source\", lang || ',' || source AS \"tags\" FROM documents", lambda d: facts.flatten_metadata(d.select("doc_id", F.struct(F.struct("lang", F.struct("source").alias("more")).alias("about"), F.array("lang", "source").alias("tags")).alias("meta")), "meta"))
_doc("embed_text_prep", "SELECT doc_id, sha256(left(CASE WHEN left(text, 20) <> '' THEN left(text, 20) || chr(10) || chr(10) ELSE '' END || text, 8000)) AS digest FROM documents", lambda d: d.select("doc_id", F.sha2(facts.embed_text(F.substring("text", 1, 20), F.col("text")).cast("binary"), 256).alias("digest")))
_add(
    "vector_table_ops",
    "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 99 ELSE label END AS label, CAST(len(embedding) AS INT) AS dims FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0",
    lambda spark, d: (lambda v: facts.vector_update(tables.delete_many(v, v.where("vec_id % 7 = 0"), "vec_id"), v.where("vec_id % 5 = 0").select("vec_id", F.col("embedding"), F.lit(99).alias("label"))).select("vec_id", "label", F.size("embedding").alias("dims")))(_read(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("label"))),
)
_add("vector_count_by_collection", "SELECT label, count(*) AS n FROM embeddings GROUP BY label", lambda spark, d: _read(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")))
_add(
    "load_v3_tables", "SELECT doc_id, label, vec_id IS NOT NULL AS has_vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE source = 'src3'",
    lambda spark, d: _read(spark, d, "documents").where("source = 'src3'").select("doc_id").join(_read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "vec_id"), "doc_id", "left").select("doc_id", "label", F.col("vec_id").isNotNull().alias("has_vector")),
)

# ---- set operations on words and sentences

_PAIR = rf"(SELECT a.conv_id, a.turn, a.text AS old, b.text AS fresh FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _pairs(c: DataFrame) -> DataFrame:
    line = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", F.col("text").alias("old"), F.lead("text").over(line).alias("fresh"), F.lead("turn").over(line).alias("next")).where("next = turn + 1").drop("next")


_turn(
    "sentence_union",
    f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(old || '.' || fresh, '[.!?]'), lambda s: trim(s, ' ')), lambda s: s <> ''))), '. ') || '.' AS text FROM {_PAIR}",
    lambda c: _pairs(c).select("conv_id", "turn", facts.sentence_union(F.col("old"), F.col("fresh")).alias("text")),
)
_STOPS = "['the', 'a', 'an', 'is', 'are', 'was', 'were', 'and', 'or', 'but']"
_turn(
    "new_words", f"SELECT conv_id, turn, CAST(len(list_filter(f, lambda w: NOT list_contains(o, w) AND NOT list_contains({_STOPS}, w))) AS INT) AS n FROM (SELECT conv_id, turn, {_TOK.replace('text', 'old')} AS o, {_TOK.replace('text', 'fresh')} AS f FROM {_PAIR})",
    lambda c: _pairs(c).select("conv_id", "turn", F.size(facts.new_words(F.col("fresh"), F.col("old"))).alias("n")),
)
_turn(
    "intersect_terms", f"SELECT conv_id, turn, array_to_string(list_sort(list_intersect(o, f)), ' ') AS shared FROM (SELECT conv_id, turn, {_TOK.replace('text', 'old')} AS o, {_TOK.replace('text', 'fresh')} AS f FROM {_PAIR})",
    lambda c: _pairs(c).select("conv_id", "turn", F.array_join(F.array_sort(F.array_intersect(tokens(F.col("old")), tokens(F.col("fresh")))), " ").alias("shared")),
)

# ---- what happens to a candidate, and feedback

_CITIES = "CASE WHEN conv_id % 4 = 1 AND turn = 0 THEN 'I live in Rome. ' WHEN conv_id % 4 = 1 AND turn = last THEN 'I live in Oslo. ' ELSE '' END"
_NEAR = rf"""m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, turn, last, CASE WHEN conv_id % 4 = 2 AND turn IN (0, last) THEN 'I said this before in the very same words.' ELSE {_CITIES} || text END AS text FROM conversations JOIN m USING (conv_id)),
  t AS (SELECT *, {_TOK} AS w, regexp_extract(lower(text), '\b(live|lives|living)\s+in\s+(\w+)\b', 0) AS home FROM p),
  s AS (SELECT b.conv_id AS id, a.turn AS other, len(list_intersect(a.w, b.w)) / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) AS similarity, len(list_filter(b.w, lambda x: NOT list_contains(a.w, x) AND NOT list_contains({_STOPS}, x))) AS fresh, a.home <> '' AND b.home <> '' AND a.home <> b.home AS against
    FROM t b JOIN t a ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE b.turn = b.last),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS r FROM s WHERE similarity > 0.1) WHERE r <= 5),
  act AS (SELECT id, arg_min(other, r) FILTER (similarity > 0.95) AS same, arg_min(other, r) FILTER (against) AS gone, arg_min(other, r) FILTER (r = 1 AND fresh >= 3) AS more FROM r GROUP BY id),
  d AS (SELECT m.conv_id AS id, CASE WHEN same IS NOT NULL THEN 'NOOP' WHEN gone IS NOT NULL THEN 'DELETE' WHEN more IS NOT NULL THEN 'UPDATE' ELSE 'ADD' END AS action, coalesce(same, gone, more) AS target FROM m LEFT JOIN act ON act.id = m.conv_id)"""


def _moved(c: DataFrame) -> DataFrame:
    """Turns; of every four conversations one begins and ends with another home, one with the same words."""
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    home = F.when((F.col("conv_id") % 4 == 1) & (F.col("turn") == 0), "I live in Rome. ").when((F.col("conv_id") % 4 == 1) & (F.col("turn") == F.col("last")), "I live in Oslo. ").otherwise("")
    again = (F.col("conv_id") % 4 == 2) & ((F.col("turn") == 0) | (F.col("turn") == F.col("last")))
    return c.join(last, "conv_id").select("conv_id", "turn", "last", F.when(again, "I said this before in the very same words.").otherwise(F.concat(home, "text")).alias("text"))


def _decided(c: DataFrame) -> DataFrame:
    """The last turn of every conversation against the turns before it."""
    t = _moved(c)
    last = t.where("turn = last").select(F.col("conv_id").alias("id"), F.col("text").alias("said"))
    t = t.where("turn < last")
    pairs = t.join(last, t["conv_id"] == last["id"])
    a, b = tokens(F.col("text")), tokens(F.col("said"))
    near = pairs.select("id", F.col("turn").alias("other"), (F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))).alias("similarity"), F.size(facts.new_words(F.col("said"), F.col("text"))).alias("fresh"), extract.contradicts(F.col("said"), F.col("text")).alias("contradicts"))
    return facts.decide(near, last)


_turn("manager_decide", f"WITH {_NEAR} SELECT * FROM d", _decided)
_turn(
    "operation_stats", f"WITH {_NEAR} SELECT action, (SELECT count(*) FROM d WHERE d.action = o.action) AS n FROM (VALUES ('ADD'), ('UPDATE'), ('DELETE'), ('NOOP')) o(action)",
    lambda c: c.sparkSession.createDataFrame([("ADD",), ("UPDATE",), ("DELETE",), ("NOOP",)], "action string").join(_decided(c).groupBy("action").agg(F.count(F.lit(1)).alias("k")), "action", "left").select("action", F.coalesce("k", F.lit(0)).alias("n")),
)
_UNION = "array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({0} || '.' || {1}, '[.!?]'), lambda s: trim(s, ' ')), lambda s: s <> ''))), '. ') || '.'"


def _applied(c: DataFrame) -> DataFrame:
    t, key = _moved(c), F.col("conv_id") * 100 + F.col("turn")
    decided = _decided(c).select("id", "action", (F.col("id") * 100 + F.col("target")).alias("target"))
    return facts.apply_decisions(t.where("turn < last").select(key.alias("memory_id"), "text"), t.where("turn = last").select(F.col("conv_id").alias("id"), key.alias("memory_id"), "text"), decided)


_turn(
    "manager_apply",
    f"""WITH {_NEAR}, u AS (SELECT id * 100 + target AS memory_id, text AS more FROM d JOIN p ON conv_id = id AND turn = last WHERE action = 'UPDATE'),
  n AS (SELECT conv_id * 100 + turn AS memory_id, CASE WHEN more IS NOT NULL THEN {_UNION.format('text', 'more')} ELSE text END AS text FROM p LEFT JOIN u ON u.memory_id = conv_id * 100 + turn WHERE turn < last AND conv_id * 100 + turn NOT IN (SELECT id * 100 + target FROM d WHERE action = 'DELETE')
    UNION ALL SELECT conv_id * 100 + turn, text FROM d JOIN p ON conv_id = id AND turn = last WHERE action IN ('ADD', 'DELETE'))
  SELECT memory_id, md5(text) AS text FROM n""",
    lambda c: _applied(c).select("memory_id", F.md5(F.col("text").cast("binary")).alias("text")),
)
_mem(
    "feedback_boost",
    "SELECT m.id, round(CASE WHEN m.memory_type IN ('click', 'view') THEN u.s WHEN r.rate IS NOT NULL THEN r.rate ELSE 1 END, 9) AS boost FROM MEM m LEFT JOIN (SELECT user_id, memory_type, avg(strength) AS s FROM MEM GROUP BY ALL) u ON u.user_id = m.user_id AND u.memory_type = m.memory_type LEFT JOIN (SELECT memory_type, avg(is_active::INT) AS rate FROM MEM WHERE memory_type <> 'purchase' GROUP BY memory_type) r ON r.memory_type = m.memory_type",
    lambda m: facts.feedback_boost(
        m.select("id", F.col("user_id").alias("query_key"), F.col("memory_type").alias("unit")),
        m.where("memory_type in ('click', 'view')").groupBy(F.col("user_id").alias("query_key"), F.col("memory_type").alias("unit")).agg(F.avg("strength").alias("score")),
        m.where("memory_type <> 'purchase'").groupBy(F.col("memory_type").alias("unit")).agg(F.avg(F.col("is_active").cast("int")).alias("rate")),
    ).select("id", F.round("boost", 9).alias("boost")),
)
_mem(
    "record_feedback",
    "SELECT user_id, memory_type, count(*) AS retrievals, count(*) FILTER (strength >= 0.2) AS used, round(avg(CASE WHEN strength >= 0.2 THEN 0.8 ELSE 0.2 END), 6) AS helpfulness, round(count(*) FILTER (strength >= 0.2) / count(*), 6) AS rate FROM MEM GROUP BY user_id, memory_type",
    lambda m: m.groupBy("user_id", "memory_type").agg(F.count(F.lit(1)).alias("retrievals"), F.count_if(F.col("strength") >= 0.2).alias("used"), F.round(F.avg(F.when(F.col("strength") >= 0.2, 0.8).otherwise(0.2)), 6).alias("helpfulness"), F.round(F.avg((F.col("strength") >= 0.2).cast("double")), 6).alias("rate")),
)

# ---- evaluation: each turn against the next one, and against itself for every third

_SAID = f"(SELECT conv_id, turn, conv_id % 5 AS category, old AS prediction, CASE WHEN turn % 3 = 0 THEN 'The ' || old || ' !' ELSE fresh END AS truth FROM {_PAIR})"
_SET = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_MET = f"(SELECT *, {_SET.format('p')} AS ps, {_SET.format('t')} AS ts, list_filter(string_split(p, ' '), lambda w: w <> '') AS pl, list_filter(string_split(t, ' '), lambda w: w <> '') AS tl FROM (SELECT *, {_norm_sql('prediction')} AS p, {_norm_sql('truth')} AS t FROM {_SAID}))"
_F1 = "CASE WHEN len(list_intersect(ps, ts)) = 0 THEN 0 ELSE 2 * len(list_intersect(ps, ts)) / (len(ps) + len(ts)) END"


def _said(c: DataFrame) -> DataFrame:
    return _pairs(c).select("conv_id", "turn", (F.col("conv_id") % 5).alias("category"), F.col("old").alias("prediction"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("The "), "old", F.lit(" !"))).otherwise(F.col("fresh")).alias("truth"))


_turn("contains_match", f"SELECT conv_id, turn, p <> '' AND t <> '' AND (contains(p, t) OR contains(t, p)) AS hit, p = t AS em FROM {_MET}", lambda c: _said(c).select("conv_id", "turn", evaluation.contains_match(F.col("prediction"), F.col("truth")).alias("hit"), evaluation.exact_match(F.col("prediction"), F.col("truth")).alias("em")))
_BOTH = "list_sum(list_transform(ps, lambda w: least(len(list_filter(pl, lambda x: x = w)), len(list_filter(tl, lambda x: x = w)))))"
_turn("multiset_f1", f"SELECT conv_id, turn, round(CASE WHEN coalesce({_BOTH}, 0) = 0 THEN 0 ELSE 2 * {_BOTH} / (len(pl) + len(tl)) END, 6) AS f1 FROM {_MET}", lambda c: _said(c).select("conv_id", "turn", F.round(evaluation.multiset_f1(F.col("prediction"), F.col("truth")), 6).alias("f1")))
_turn(
    "score_by_category", f"SELECT coalesce(CAST(category AS VARCHAR), 'all') AS category, count(*) AS n, round(avg({_F1}), 6) AS f1, round(avg((p = t)::INT), 6) AS em FROM {_MET} GROUP BY ROLLUP (category)",
    lambda c: evaluation.score_by_category(_said(c).withColumn("category", F.col("category").cast("string"))).withColumns({"f1": F.round("f1", 6), "em": F.round("em", 6)}),
)
_RUNS = "(SELECT user_id % 5 AS run, memory_type, avg(strength) * 10 AS score FROM MEM GROUP BY ALL)"


def _runs(m: DataFrame) -> DataFrame:
    return m.groupBy((F.col("user_id") % 5).alias("run"), "memory_type").agg((F.avg("strength") * 10).alias("score"))


_mem("aggregate_runs", f"SELECT memory_type, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most FROM {_RUNS} GROUP BY memory_type", lambda m: evaluation.aggregate_runs(_runs(m), ["memory_type"], "score").select("memory_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")]))
_SYS = "(SELECT memory_type, avg(strength) * 100 AS score FROM MEM WHERE {0} GROUP BY memory_type)"


def _system(m: DataFrame, where: str) -> DataFrame:
    return m.where(where).groupBy("memory_type").agg((F.avg("strength") * 100).alias("score"))


_mem(
    "compare_systems",
    f"SELECT coalesce(a.memory_type, b.memory_type) AS memory_type, round(coalesce(a.score, 0), 6) AS score_a, round(coalesce(b.score, 0), 6) AS score_b, round(coalesce(a.score, 0) - coalesce(b.score, 0), 6) AS delta, CASE WHEN abs(coalesce(a.score, 0) - coalesce(b.score, 0)) < 1 THEN 'tie' WHEN coalesce(a.score, 0) > coalesce(b.score, 0) THEN 'a' ELSE 'b' END AS winner FROM {_SYS.format('id % 2 = 0')} a FULL JOIN {_SYS.format('id % 2 = 1')} b ON a.memory_type = b.memory_type",
    lambda m: evaluation.compare_systems(_system(m, "id % 2 = 0"), _system(m, "id % 2 = 1"), "memory_type", "score").select("memory_type", *[F.round(c, 6).alias(c) for c in ("score_a", "score_b", "delta")], "winner"),
)
_mem("wins_ties", "SELECT memory_type, count(*) FILTER (strength > access_count / 100) AS a_better, count(*) FILTER (strength < access_count / 100) AS b_better, count(*) FILTER (strength = access_count / 100) AS ties, round(avg(strength), 6) AS mean_a, round(avg(access_count / 100), 6) AS mean_b FROM MEM GROUP BY memory_type", lambda m: evaluation.wins_ties(m.select("memory_type", F.col("strength").alias("score_a"), (F.col("access_count") / 100).alias("score_b")), "memory_type").withColumns({c: F.round(c, 6) for c in ("mean_a", "mean_b")}))
_mem("retrieval_by_age", "SELECT CAST(floor(hours / 168) AS BIGINT) AS bucket, round(avg(is_active::INT), 6) AS rate, count(*) AS n FROM MEM GROUP BY 1", lambda m: evaluation.retrieval_by_age(m, F.floor(F.col("hours") / 168), "is_active").withColumn("rate", F.round("rate", 6)))
_mem(
    "composite_score",
    "SELECT user_id, round(CASE WHEN p <= 1000 THEN 100 WHEN p <= 5000 THEN 80 - (p - 1000) / 100 WHEN p <= 10000 THEN 40 - (p - 5000) / 200 ELSE greatest(0, 20 - (p - 10000) / 1000) END * 0.2 + 0.3 * 100 * s + 0.15 * least(100, n / 10) + 0.15 * greatest(0, 100 - s * 100) + 0.2 * 100 * a, 2) AS score FROM (SELECT user_id, quantile_cont(strength, 0.95) * 20000 AS p, avg(strength) AS s, count(*) / 10 AS n, avg(is_active::INT) AS a FROM MEM GROUP BY user_id)".replace("least(100, n / 10)", "least(100, n * 10)"),
    lambda m: m.groupBy("user_id").agg((F.percentile("strength", 0.95) * 20000).alias("p"), F.avg("strength").alias("s"), (F.count(F.lit(1)) / 10).alias("n"), F.avg(F.col("is_active").cast("int")).alias("a")).select("user_id", evaluation.composite_score(F.col("s"), F.col("p"), F.col("n"), -F.col("s"), F.col("a")).alias("score")),
)
_mem(
    "session_recall", "SELECT user_id, round(len(list_intersect(f, w)) / len(w), 6) AS recall FROM (SELECT user_id, list(DISTINCT memory_type) FILTER (strength >= 0.5) AS f, list(DISTINCT memory_type) FILTER (access_count >= 5) AS w FROM MEM GROUP BY user_id) WHERE w IS NOT NULL AND f IS NOT NULL",
    lambda m: m.groupBy("user_id").agg(F.collect_set(F.when(F.col("strength") >= 0.5, F.col("memory_type"))).alias("f"), F.collect_set(F.when(F.col("access_count") >= 5, F.col("memory_type"))).alias("w")).where("size(f) > 0 and size(w) > 0").select("user_id", F.round(evaluation.session_recall(F.col("f"), F.col("w")), 6).alias("recall")),
)
_turn(
    "judge_verdict_parse", "SELECT conv_id, turn, turn % 2 = 0 AS correct, trim(split_part(text, chr(10), 1)) AS reason FROM (SELECT conv_id, turn, 'x' || trim(split_part(text, chr(10), 1)) AS text FROM conversations)",
    lambda c: c.withColumn("line", F.trim(F.concat(F.lit("x"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))))).select("conv_id", "turn", evaluation.verdict(F.concat(F.when(F.col("turn") % 2 == 0, "Verdict: Correct\n").otherwise("VERDICT: WRONG\n"), F.lit("Reason: "), "line")).alias("v")).select("conv_id", "turn", "v.correct", "v.reason"),
)
_turn(
    "yes_no_vote",
    "SELECT conv_id, CASE WHEN yes > nope THEN 'Yes' WHEN nope > yes THEN 'No' ELSE 'undecided' END AS vote FROM (SELECT conv_id, sum((turn % 2 = 0)::INT) AS yes, sum((turn % 2 = 1)::INT) AS nope FROM conversations GROUP BY conv_id)",
    lambda c: c.withColumn("said", F.when(F.col("turn") % 2 == 0, F.lit("yes it is so")).otherwise("it is wrong")).groupBy("conv_id").agg(F.sum(scores.speaks_for(F.col("said"))).alias("s")).select("conv_id", F.when(F.col("s") > 0, "Yes").when(F.col("s") < 0, "No").otherwise("undecided").alias("vote")),
)
_mem("type_summary", "SELECT user_id, string_agg(memory_type || ': ' || n, ', ' ORDER BY memory_type) AS summary FROM (SELECT user_id, memory_type, count(*) AS n FROM MEM GROUP BY ALL) GROUP BY user_id", lambda m: m.groupBy("user_id", "memory_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("memory_type", "n"))), lambda x: F.concat_ws(": ", x["memory_type"], x["n"].cast("string"))), ", ").alias("summary")))
_mem("timeline", "SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS INT) AS place FROM MEM WHERE memory_type = 'purchase'", lambda m: m.where("memory_type = 'purchase'").select("user_id", "id", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "id")).alias("place")))
_turn(
    "items_by_topic", "SELECT topic, conv_id, turn FROM (SELECT conv_id, turn, topic, row_number() OVER (PARTITION BY topic ORDER BY length(text) DESC, conv_id, turn) AS r FROM (SELECT *, CASE turn % 3 WHEN 0 THEN 'work' WHEN 1 THEN 'health' ELSE 'events' END AS topic FROM conversations)) WHERE r <= 10",
    lambda c: tables.first_rows(c.withColumn("topic", scores.topic_of(F.element_at(F.array(F.lit("my job at the office"), F.lit("the doctor and the medicine"), F.lit("we visited a party")), (F.col("turn") % 3 + 1).cast("int")))), ["topic"], [F.length("text").desc(), F.col("conv_id"), F.col("turn")], 10).select("topic", "conv_id", "turn"),
)
_turn("topic_context", "SELECT conv_id, turn, 'short' AS tier FROM conversations WHERE turn % 3 = 0 AND turn >= 4 UNION ALL SELECT conv_id, turn, 'long' FROM conversations WHERE turn % 3 = 0 AND turn < 4", lambda c: (lambda t: t.where("turn >= 4").select("conv_id", "turn", F.lit("short").alias("tier")).unionByName(t.where("turn < 4").select("conv_id", "turn", F.lit("long").alias("tier"))))(c.where("turn % 3 = 0")))
