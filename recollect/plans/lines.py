"""Registered searches inside words, recall by span, stored memories, and relations in turns and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import extract, questions
from recollect.operators import grams, spans
from recollect.plans import answers as answering
from recollect.plans import questions as asking
from recollect.plans.catalog import _TOK, _add, _read
from recollect.sources import memories as stored

# ---- keywords inside words: every other item also asks for a piece of its first long word

_PIECE = r"regexp_extract(lower(text), '([\p{L}\p{N}_]{6,})', 1)[2:5]"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = F.substring(F.regexp_extract(F.lower("text"), r"(?U)(\w{6,})", 1), 2, 4)
    return answering._asked(spark, sf_dir).withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat("text", F.lit(" "), piece)).otherwise(F.col("text")))


_SOUGHT = rf"""b AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text || ' ' || {_PIECE} ELSE text END AS text FROM benchmark),
  q AS (SELECT query_id, unnest(list_distinct(list_concat(list_filter(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> ''), lambda w: length(w) > 2 AND NOT list_contains({asking._list_sql(questions.STOP_KEYWORDS)}, w)), list_transform(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+')), lambda w: lower(w))))) AS k FROM b),
  t AS MATERIALIZED (SELECT conv_id * 100 + turn AS memory_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{3,}}'))) AS w FROM conversations)"""
_add(
    "search_episodes",
    f"""WITH {_SOUGHT}, ks AS MATERIALIZED (SELECT DISTINCT k FROM q), vs AS MATERIALIZED (SELECT DISTINCT w FROM t), held AS MATERIALIZED (SELECT k, w FROM ks CROSS JOIN vs WHERE contains(w, k)),
  m AS (SELECT memory_id, k, max(CASE WHEN w = k THEN 1.5 ELSE 1.0 END) AS s FROM t JOIN held USING (w) GROUP BY ALL), r AS (SELECT query_id, memory_id, CAST(sum(s) AS DOUBLE) AS score FROM q JOIN m USING (k) GROUP BY ALL) {answering._ranked('r')}""",
    lambda spark, d: grams.search_inside(_asked(spark, d), answering.items(spark, d)),
)
_add(
    "words_holding",
    f"WITH {_SOUGHT} SELECT DISTINCT k AS part, w AS word FROM (SELECT DISTINCT k FROM q) CROSS JOIN (SELECT DISTINCT w FROM t) WHERE contains(w, k)",
    lambda spark, d: grams.words_holding(_asked(spark, d).select(F.explode(questions.search_keywords(F.col("text"))).alias("part")), answering.items(spark, d).select(F.explode(F.array_distinct(grams.word_tokens(F.col("text")))).alias("word"))),
)

# ---- recall of turns at set places

_ITEMS = f"(SELECT conv_id * 10 + turn AS position, {_TOK} AS w FROM conversations)"
_add(
    "memory_span_recall",
    f"""WITH r AS (SELECT position, w, span, position // span AS band, position % span AS place FROM {_ITEMS}, (SELECT unnest([10, 50, 100]) AS span)),
  asked AS (SELECT span, band, place, position AS wanted, unnest(w[-8:]) AS word FROM r WHERE place IN (0, span // 4, span // 2, 3 * span // 4, span - 1)), held AS (SELECT span, band, position, unnest(w) AS word FROM r),
  n AS (SELECT span, band, place, wanted, position, count(*) AS n FROM held JOIN asked USING (span, band, word) GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY span, band, wanted ORDER BY n DESC, position) AS r FROM n),
  h AS (SELECT span, place, wanted, max((position = wanted)::BIGINT) AS hit FROM f WHERE r <= 5 GROUP BY ALL) SELECT span, place, count(*) AS asked, CAST(sum(hit) AS BIGINT) AS recalled, round(sum(hit) / count(*), 6) AS recall FROM h GROUP BY span, place""",
    lambda spark, d: spans.span_recall(_read(spark, d, "conversations").select((F.col("conv_id") * 10 + F.col("turn")).alias("position"), "text"), [10, 50, 100]).withColumn("recall", F.round("recall", 6)),
)

# ---- stored memories: a type by number, one row in ninety with broken JSON


def typed_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _read(spark, sf_dir, "events"), F.col("event_id")
    name = F.array(*map(F.lit, stored.TYPES))[(i % 4).cast("int")]
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    long = i.cast("long")
    own = {
        "short_term": F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("event_type").alias("content"))).alias("items"), F.lit(20).cast("long").alias("max_items"), text("s", F.col("user_id")).alias("session_id"), F.lit(None).cast("string").alias("current_task_id")),
        "episodic": F.struct(F.array(F.struct(F.col("event_type"), text("number ", i).alias("description"), (i % 3 == 0).alias("success"))).alias("episodes"), text("told by ", F.col("user_id")).alias("narrative"), F.array(F.lit("wait"), F.col("event_type")).alias("lessons_learned")),
        "semantic": F.struct(F.array(F.struct(text("u", F.col("user_id")).alias("subject"), F.lit("likes").alias("predicate"), F.col("event_type").alias("object"), (F.col("value") / 500).alias("confidence"))).alias("facts"), F.lit("shop").alias("knowledge_domain"), (F.col("value") / 1000).alias("overall_confidence")),
        "long_term": F.struct(F.array(long, long + 1).alias("derived_from"), (long % 9).alias("episode_count")),
    }
    importance = F.struct((F.col("value") / 500).alias("score"), *[F.lit(None).cast("double").alias(c) for c in ("novelty", "causal", "emotional", "frequency")])
    metadata = F.struct("user_id", F.lit("app").alias("scope"), F.lit("chat").alias("source"), F.array("event_type", F.lit("x")).alias("tags"))
    return e.select(i.alias("id"), name.alias("memory_type"), (i % 7 != 0).alias("is_active"), importance.alias("importance"), metadata.alias("metadata"), *[F.when(name == t, s).alias(t) for t, s in own.items()])


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.col("id") % 90 == 1
    return stored.pack_memories(typed_memories(spark, sf_dir)).withColumn("type_data_json", F.when(broken, F.substring("type_data_json", 1, 9)).otherwise(F.col("type_data_json")))


def _flat(rows: DataFrame) -> DataFrame:
    """The typed columns of every kind, one text each, for comparison."""
    return rows.select(
        "id", "memory_type", "is_active", F.round("importance.score", 6).alias("score"), "metadata.user_id", F.array_join("metadata.tags", "|").alias("tags"), F.col("short_term.session_id").alias("session_id"), F.col("short_term.items")[0]["content"].alias("said"),
        F.col("episodic.narrative").alias("narrative"), F.col("episodic.episodes")[0]["success"].alias("success"), F.array_join("episodic.lessons_learned", "|").alias("lessons"), F.col("semantic.facts")[0]["subject"].alias("subject"), F.round(F.col("semantic.facts")[0]["confidence"], 6).alias("confidence"),
        F.round("semantic.overall_confidence", 6).alias("overall"), F.col("long_term.derived_from")[1].alias("second"), F.col("long_term.episode_count").alias("episodes"), F.array_join("corrupt", "|").alias("corrupt"),
    )


_add(
    "read_memories",
    """SELECT event_id AS id, ['short_term', 'episodic', 'semantic', 'long_term'][event_id % 4 + 1] AS memory_type, event_id % 7 <> 0 AS is_active, round(value / 500, 6) AS score, user_id, event_type || '|x' AS tags,
  CASE WHEN k = 0 THEN 's' || user_id END AS session_id, CASE WHEN k = 0 THEN event_type END AS said, CASE WHEN k = 1 THEN 'told by ' || user_id END AS narrative, CASE WHEN k = 1 THEN event_id % 3 = 0 END AS success, CASE WHEN k = 1 THEN 'wait|' || event_type END AS lessons,
  CASE WHEN k = 2 THEN 'u' || user_id END AS subject, CASE WHEN k = 2 THEN round(value / 500, 6) END AS confidence, CASE WHEN k = 2 THEN round(value / 1000, 6) END AS overall, CASE WHEN k = 3 THEN event_id + 1 END AS second, CASE WHEN k = 3 THEN event_id % 9 END AS episodes,
  CASE WHEN event_id % 90 = 1 THEN 'type_data_json' ELSE '' END AS corrupt FROM (SELECT *, CASE WHEN event_id % 90 = 1 THEN -1 ELSE event_id % 4 END AS k FROM events)""",
    lambda spark, d: _flat(stored.read_memories(_stored(spark, d))),
)
_add(
    "pack_memory_json",
    """SELECT event_id AS id, (event_id % 7 <> 0)::INT AS is_active, '{"user_id":' || user_id || ',"scope":"app","source":"chat","tags":["' || event_type || '","x"]}' AS metadata_json,
  CASE event_id % 4 WHEN 0 THEN '{"items":[{"role":"user","content":"' || event_type || '"}],"max_items":20,"session_id":"s' || user_id || '"}' WHEN 1 THEN '{"episodes":[{"event_type":"' || event_type || '","description":"number ' || event_id || '","success":' || (event_id % 3 = 0) || '}],"narrative":"told by ' || user_id || '","lessons_learned":["wait","' || event_type || '"]}'
    WHEN 3 THEN '{"derived_from":[' || event_id || ',' || (event_id + 1) || '],"episode_count":' || (event_id % 9) || '}' END AS type_data_json FROM events WHERE event_id % 4 <> 2""",
    lambda spark, d: stored.pack_memories(typed_memories(spark, d)).where("memory_type <> 'semantic'").select("id", "is_active", "metadata_json", "type_data_json"),
)

# ---- relations of speakers, and facts in lines about entities

_MANY = [
    " I love tea. I like fish, I enjoy jam! I prefer bread. My favorite color is red.", " I went to Rome. I visited Oslo, we joined a club. She attended a talk. He started work. They finished early. We ended it.",
    " I am happy. I work at home, I live in Paris. My name is Ann. I have two cats.", " We met Anna and Boris with Carl near Dora, Emil, Fritz and Gustav. I was reading a book.", " She came from Madrid to Lisbon, then at Porto and in Faro.", "",
]


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.initcap("role").alias("speaker"), F.concat("text", F.get(F.array(*map(F.lit, _MANY)), ((F.col("conv_id") + F.col("turn")) % len(_MANY)).cast("int"))).alias("text"))


_QUOTED = ", ".join("'" + t.replace("'", "''") + "'" for t in _MANY)
_SHORT = lambda xs: f"list_transform({xs}, lambda x: left(trim(x), 50))"
_ALL = lambda p, g=1: f"regexp_extract_all(text, '{p}', {g})"
_DEEDS = "list_concat(" + ", ".join(f"list_transform(list_zip({_ALL(p)}, {_ALL(p, 2)}), lambda z: z[1] || ' ' || left(trim(z[2]), 50))" for p in extract.DEED_PATTERNS) + ")"
_LONG = lambda ps: f"list_filter({_SHORT('list_concat(' + ', '.join(map(_ALL, ps)) + ')')}, lambda x: length(x) > 2)"
_BARE = r"regexp_replace(text, '(^|[^\p{L}\p{M}\p{N}_])(in|at|to|from) [A-Z][a-z]+', '\1\2 0', 'g')"
_MONTHS = "january february march april may june july august september october november december".split()
_PEOPLE = rf"list_filter(regexp_split_to_array({_BARE}, '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND NOT list_contains({asking._list_sql(questions.NO_NAMES)}, w) AND NOT list_contains({asking._list_sql(_MONTHS)}, lower(w)) AND lower(w) <> lower(speaker))"
_PLACES = _ALL("(?:^|[^A-Za-z])(?:in|at|to|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)")
_add(
    "extract_relations",
    f"""WITH s AS (SELECT conv_id, turn, upper(left(role, 1)) || role[2:] AS speaker, text || [{_QUOTED}][(conv_id + turn) % {len(_MANY)} + 1] AS text FROM conversations),
  k AS ({" UNION ALL ".join(f"SELECT conv_id, turn, speaker, '{p}' AS predicate, {asking._ONCE.format('(' + v + ')')}[1:{extract.CAPS[p]}] AS os FROM s" for p, v in (("did", _DEEDS), ("mentioned", _PEOPLE), ("likes", _LONG(extract.TASTE_PATTERNS)), ("is/has", _LONG(extract.BEING_PATTERNS)), ("was_at", _PLACES)))})
  SELECT conv_id, turn, speaker AS subject, predicate, unnest(os) AS object FROM k""",
    lambda spark, d: _said(spark, d).select("conv_id", "turn", F.explode(extract.extract_relations(F.col("text"), F.col("speaker"))).alias("r")).select("conv_id", "turn", "r.*"),
)
_ABOUT = " {0} is kind, {0} was late. {0} likes tea.\n{0} works at home, and {0} went to Rome. {0} has a cat."
_ABOUT_SQL = "' ' || n || ' is kind, ' || n || ' was late. ' || n || ' likes tea.' || chr(10) || n || ' works at home, and ' || n || ' went to Rome. ' || n || ' has a cat.'"


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns that also tell of one of four people, and three of those."""
    c = _read(spark, sf_dir, "conversations")
    n = F.get(F.array(*map(F.lit, ["Ann", "Bob", "Cid", "Dee"])), (F.col("turn") % 4).cast("int"))
    parts = _ABOUT.split("{0}")
    told = F.concat("text", *[x for i, p in enumerate(parts) for x in ([F.lit(p)] if i == len(parts) - 1 else [F.lit(p), n])])
    return c.select("conv_id", "turn", told.alias("text")), spark.createDataFrame([("Ann",), ("Bob",), ("Dee",)], "entity string")


_VERBS = {"is": "(?:is|was)", "likes": "(?:likes?|loves?|enjoys?)", "works": r"(?:works?|worked)\s+(?:at|for|as)", "went": r"(?:went|goes)\s+to", "has": "(?:has|have|had)"}
_add(
    "facts_about_entity_lines",
    f"""WITH s AS (SELECT conv_id, turn, text || {_ABOUT_SQL} AS text FROM (SELECT *, ['Ann', 'Bob', 'Cid', 'Dee'][turn % 4 + 1] AS n FROM conversations)), l AS (SELECT conv_id, turn, unnest(ls) AS content, unnest(range(0, len(ls))) AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM s)),
  f AS ({" UNION ALL ".join(f"SELECT conv_id, turn, line, e AS entity, '{p}' AS predicate, unnest(regexp_extract_all(content, '(?i)' || e || '\\s+{v}\\s+(.+?)(?:\\.|,|$)', 1)) AS value FROM l, (SELECT unnest(['Ann', 'Bob', 'Dee']) AS e) WHERE contains(content, e)" for p, v in _VERBS.items())})
  SELECT conv_id, turn, CAST(line AS INT) AS line, entity, predicate, left(trim(value), 50) AS value FROM f""",
    lambda spark, d: (lambda s: extract.facts_about_lines(s[0], s[1], ["conv_id", "turn"]))(_spoken(spark, d)),
)
