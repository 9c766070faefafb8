"""Registered hybrid searches: benchmark items with planted hints over all documents, and the graph of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import hybrid, sparse
from recollect.plans import questions as asking
from recollect.plans.catalog import _add, _read
from recollect.sources.conversations import hash_embedding

HINTS = [" When did src3 write this on 7 May 2023?", " Who is it, src5?", " Where in Asia is the place?", " What do I like or prefer in France?", " and tell me about the life in Europe and Japan", ""]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, q): every benchmark item, most of them with a question behind."""
    i, hint = F.col("item_id"), F.lit(HINTS[-1])
    for n, text in enumerate(HINTS[:-1]):
        hint = F.when(i % len(HINTS) == n, F.lit(text)).otherwise(hint)
    return _read(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat("text", hint).alias("q"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a fourth of them with a date behind their text, a fifth with a liking."""
    i = F.col("doc_id")
    told = F.concat("text", F.when(i % 4 == 1, " We met on 7 May 2023.").otherwise(""), F.when(i % 5 == 2, " I love tea.").otherwise(""))
    return _read(spark, sf_dir, "documents").select(i.alias("memory_id"), told.alias("content"), F.when(i % 3 == 0, "7 May 2023").when(i % 3 == 1, "8 June 2022").alias("event_date"), F.col("source").alias("speaker"), (i % 10 / 10).alias("importance"), F.col("lang").alias("memory_type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.lower("n_name").alias("source"), F.lower("r_name").alias("target"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, memory_id): a document is about the nation and the region that its number falls to."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("memory_id"))
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    of = lambda names, key, name, n: docs.join(names, F.col("memory_id") % n == names[key]).select(F.lower(name).alias("entity"), "memory_id")
    return of(nation, "n_nationkey", "n_name", 25).unionByName(of(region, "r_regionkey", "r_name", 35))


_HINT = "CASE item_id % 6 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(HINTS)) + " END"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: length(w) >= 3))"


def _hash_sql(rows: str, key: str, text: str) -> str:
    """(key, bucket, weight) of the hashed embedding of every row."""
    words = rf"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: length(w) >= 3)[1:100]"
    return f"""(SELECT {key}, bucket, weight / sqrt(sum(weight * weight) OVER (PARTITION BY {key})) AS weight FROM (SELECT {key}, CAST('0x' || left(md5(w), 8) AS BIGINT) % 768 AS bucket, sum(1.0 / i) AS weight
    FROM (SELECT {key}, unnest({words}) AS w, unnest(range(1, len({words}) + 1)) AS i FROM {rows}) GROUP BY {key}, bucket))"""


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_CAPS = r"list_filter(regexp_split_to_array(q, '[^\p{L}\p{M}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]+'))"
_RUN = r"(' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) || ' ')"
_BASE = f"""asked AS MATERIALIZED (SELECT item_id AS query_id, text || {_HINT} AS q, lower(text || {_HINT}) AS l FROM benchmark),
  m AS MATERIALIZED (SELECT doc_id AS memory_id, text || CASE WHEN doc_id % 4 = 1 THEN ' We met on 7 May 2023.' ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN ' I love tea.' ELSE '' END AS content,
    CASE doc_id % 3 WHEN 0 THEN '7 May 2023' WHEN 1 THEN '8 June 2022' END AS event_date, source AS speaker, doc_id % 10 / 10 AS importance, lang FROM documents),
  mw AS MATERIALIZED (SELECT memory_id, unnest({_WORDS.format('content')}) AS w FROM m), mh AS MATERIALIZED {_hash_sql('m', 'memory_id', 'content')}"""


def _basic_sql(parts: str, name: str) -> str:
    """Scores of all memories for (pid, q) of a table, as tables whose names end alike."""
    return f"""w_{name} AS MATERIALIZED (SELECT pid, unnest({_WORDS.format('q')}) AS w FROM {parts}), n_{name} AS (SELECT pid, count(*) AS n FROM w_{name} GROUP BY pid), h_{name} AS MATERIALIZED {_hash_sql(parts, 'pid', 'q')},
  k_{name} AS (SELECT pid, memory_id, count(*) AS shared FROM w_{name} JOIN mw USING (w) GROUP BY ALL), s_{name} AS (SELECT h.pid, memory_id, sum(h.weight * mh.weight) AS near FROM h_{name} h JOIN mh USING (bucket) GROUP BY ALL),
  all_{name} AS (SELECT p.pid, m.memory_id, round(0.4 * coalesce(near, 0) + 0.3 * coalesce(shared, 0) / (coalesce(n, 0) + 1) + 0.01 * importance
    + CASE WHEN {_has('lower(q)', hybrid.TIME)} AND event_date IS NOT NULL THEN 0.05 + CASE WHEN contains({_RUN.format('q')}, {_RUN.format('event_date')}) THEN 0.03 ELSE 0 END ELSE 0 END
    + CASE WHEN {_has('lower(q)', hybrid.PERSON)} AND contains({_RUN.format('q')}, {_RUN.format('speaker')}) THEN 0.06 ELSE 0 END, 9) AS score
    FROM {parts} p CROSS JOIN m LEFT JOIN k_{name} k ON k.pid = p.pid AND k.memory_id = m.memory_id LEFT JOIN s_{name} s ON s.pid = p.pid AND s.memory_id = m.memory_id LEFT JOIN n_{name} n ON n.pid = p.pid),
  {name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, memory_id) AS place FROM all_{name} WHERE score > 0)"""


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, 6) for c in columns})


_add(
    "hash_embed",
    f"SELECT doc_id, bucket, round(weight, 6) AS weight FROM {_hash_sql('documents', 'doc_id', 'text')}",
    lambda spark, d: _read(spark, d, "documents").select("doc_id", F.explode(hash_embedding(F.col("text"))).alias("p")).select("doc_id", "p.bucket", F.round("p.weight", 6).alias("weight")),
)
_add(
    "lexical_top",
    f"WITH {_BASE}, w AS (SELECT query_id, unnest({_WORDS.format('q')}) AS w FROM asked), s AS (SELECT query_id, memory_id, CAST(count(*) AS DOUBLE) AS score FROM w JOIN mw USING (w) GROUP BY ALL) SELECT query_id, memory_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 10",
    lambda spark, d: sparse.lexical_top(asked(spark, d).select("query_id", hybrid.long_words(F.col("q")).alias("words")), memories(spark, d).select("memory_id", hybrid.long_words(F.col("content")).alias("words")), 10),
)
_add(
    "basic_search_v3",
    f"WITH {_BASE}, p AS (SELECT query_id AS pid, q FROM asked), {_basic_sql('p', 'b')} SELECT pid AS query_id, memory_id, round(score, 6) AS score, CAST(place AS INT) AS rank FROM b WHERE place <= 20",
    lambda spark, d: _rounded(hybrid.basic_search(asked(spark, d), memories(spark, d), 20), "score"),
)
_PARTS = f"""parts AS MATERIALIZED (SELECT query_id, query_id * 100 + seq AS pid, part AS q, seq FROM (SELECT query_id, unnest(ps) AS part, unnest(range(0, len(ps))) AS seq FROM (SELECT query_id, (CASE {asking._PARTS_SQL}
    WHEN contains(l, ' and ') AND length(q) > 30 AND len({asking._HALVES}) = 2 AND len(list_filter({asking._HALVES}, lambda p: length(p) > 10)) = 2 THEN {{'kind': '', 'reasoning': TRUE, 'parts': list_transform({asking._HALVES}, lambda p: rtrim(p, '?') || '?')}} ELSE {{'kind': '', 'reasoning': FALSE, 'parts': [q]}} END).parts AS ps FROM asked)))"""
_GRAPH = f"""e AS (SELECT lower(n_name) AS x, lower(r_name) AS y FROM nation JOIN region ON r_regionkey = n_regionkey), ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  ix AS (SELECT entity, memory_id, row_number() OVER (PARTITION BY entity ORDER BY memory_id) AS m FROM (SELECT lower(n_name) AS entity, doc_id AS memory_id FROM documents JOIN nation ON doc_id % 25 = n_nationkey UNION SELECT lower(r_name), doc_id FROM documents JOIN region ON doc_id % 35 = r_regionkey)),
  named AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS nth FROM (SELECT query_id, lower(n) AS entity, spot FROM (SELECT query_id, unnest(ns) AS n, unnest(range(0, len(ns))) AS spot FROM (SELECT query_id, {asking._ONCE.format(f"list_filter({_CAPS}, lambda w: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, w))")} AS ns FROM asked))) WHERE entity IN (SELECT x FROM ways)),
  seeds AS (SELECT DISTINCT entity AS seed FROM named WHERE nth <= 3), h1 AS (SELECT seed, node, r FROM (SELECT seed, y AS node, row_number() OVER (PARTITION BY seed ORDER BY y) AS r FROM seeds JOIN ways ON x = seed) WHERE r <= 10),
  h2 AS (SELECT seed, node, r FROM (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY node) AS r FROM (SELECT DISTINCT h1.seed, y AS node FROM h1 JOIN ways ON x = h1.node WHERE y <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 z WHERE z.seed = h1.seed AND z.node = y))) WHERE r <= 10),
  near AS (SELECT seed, node, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS n FROM (SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2)),
  around AS (SELECT query_id, nth * 10000 + n * 100 + m AS place, memory_id FROM named JOIN near ON seed = named.entity JOIN ix ON ix.entity = node WHERE nth <= 3 AND n <= 5 AND m <= 3)"""


def _rerank_sql(found: str, k: int, name: str = "reranked") -> str:
    tests = f"""CASE WHEN {_has('l', hybrid.TIME_AGAIN)} AND regexp_matches(content, '(^|[^0-9A-Za-z_])[0-9]{{4}}([^0-9A-Za-z_]|$)') THEN 1 ELSE 0 END AS dated, CASE WHEN {_has('l', hybrid.TIME_AGAIN)} AND {_has('lower(content)', hybrid.MONTHS)} THEN 1 ELSE 0 END AS month,
    CASE WHEN {_has('l', hybrid.PERSON)} AND speaker <> '' AND contains(l, lower(speaker)) THEN 1 ELSE 0 END AS spoke, CASE WHEN {_has('l', hybrid.PLACE)} AND {_has('lower(content)', hybrid.NEAR)} THEN 1 ELSE 0 END AS placed, CASE WHEN {_has('l', hybrid.TASTE)} AND {_has('lower(content)', hybrid.LIKING)} THEN 1 ELSE 0 END AS liked"""
    return f"""qw_{name} AS MATERIALIZED (SELECT query_id, unnest({_WORDS.format('q')}) AS w FROM asked), qn_{name} AS (SELECT query_id, count(*) AS n FROM qw_{name} GROUP BY 1), qh_{name} AS MATERIALIZED {_hash_sql('asked', 'query_id', 'q')},
  f_{name} AS MATERIALIZED ({found}),
  o_{name} AS (SELECT query_id, memory_id, count(*) AS shared FROM f_{name} JOIN qw_{name} USING (query_id) JOIN mw USING (memory_id, w) GROUP BY ALL), c_{name} AS (SELECT f.query_id, f.memory_id, sum(qh.weight * mh.weight) AS near FROM f_{name} f JOIN qh_{name} qh USING (query_id) JOIN mh ON mh.memory_id = f.memory_id AND mh.bucket = qh.bucket GROUP BY ALL),
  t_{name} AS (SELECT f.*, {tests}, coalesce(near, 0) AS near, coalesce(shared, 0) / (coalesce(n, 0) + 1) AS shared FROM f_{name} f JOIN asked USING (query_id) JOIN m USING (memory_id) LEFT JOIN qn_{name} USING (query_id) LEFT JOIN o_{name} USING (query_id, memory_id) LEFT JOIN c_{name} USING (query_id, memory_id)),
  {name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT query_id, memory_id, initial, round(0.35 * near + 0.25 * shared + 0.2 * initial + 0.2 * (0.2 * dated + 0.15 * month + 0.25 * spoke + 0.1 * placed + 0.15 * liked), 9) AS score,
    CASE WHEN liked = 1 THEN 'preference_language' WHEN placed = 1 THEN 'location_indicator' WHEN spoke = 1 THEN 'speaker_match' WHEN month = 1 THEN 'has_month' WHEN dated = 1 THEN 'has_date' ELSE '' END AS reason FROM t_{name})) WHERE rank <= {k})"""


def _found_sql(k: int) -> str:
    return f"SELECT query_id, memory_id, arg_min(score, (kind, place)) AS initial FROM (SELECT query_id, seq AS kind, place, memory_id, score FROM b JOIN parts USING (pid) WHERE place <= {2 * k} UNION ALL SELECT query_id, 1000, place, memory_id, 0.3 FROM around) GROUP BY query_id, memory_id"


_LIST = "query_id, memory_id, round(initial, 6) AS initial, round(score, 6) AS score, reason, CAST(rank AS INT) AS rank"
_add(
    "search_v3",
    f"WITH {_BASE}, {_PARTS}, {_basic_sql('parts', 'b')}, {_GRAPH}, {_rerank_sql(_found_sql(15), 15)} SELECT {_LIST} FROM reranked",
    lambda spark, d: _rounded(hybrid.search(asked(spark, d), memories(spark, d), edges(spark, d), index(spark, d)), "initial", "score"),
)
_add(
    "rerank_v3",
    f"WITH {_BASE}, {_rerank_sql('SELECT query_id, memory_id, (memory_id % 7) / 10 AS initial FROM asked JOIN m ON memory_id % (SELECT count(*) FROM asked) = query_id % (SELECT count(*) FROM asked)', 10)} SELECT {_LIST} FROM reranked",
    lambda spark, d: (lambda a, m: _rounded(hybrid.rerank(a, (lambda n: m.select((F.col("memory_id") % n).alias("part"), "memory_id", (F.col("memory_id") % 7 / 10).alias("score")).join(a.select("query_id", (F.col("query_id") % n).alias("part")), "part").drop("part"))(a.count()), m, 10), "initial", "score"))(asked(spark, d), memories(spark, d)),
)
_EXPANDED = f"list_concat([q], list_concat(list_filter([{asking._OTHER}], lambda x: x IS NOT NULL), flatten(list_transform({_CAPS}[1:2], lambda n: ['What about ' || n || '?', 'Tell me about ' || n])))[1:3])"
_add(
    "search_expanded",
    f"""WITH {_BASE}, wordings AS MATERIALIZED (SELECT query_id, query_id * 100 + seq AS pid, q, seq FROM (SELECT query_id, unnest(ws) AS q, unnest(range(0, len(ws))) AS seq FROM (SELECT query_id, {_EXPANDED} AS ws FROM asked))), {_basic_sql('wordings', 'b')},
  f AS (SELECT query_id, memory_id, arg_min(score, seq) AS score FROM b JOIN wordings USING (pid) WHERE place <= 15 GROUP BY ALL) SELECT query_id, memory_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM f) WHERE rank <= 15""",
    lambda spark, d: _rounded(hybrid.search_expanded(asked(spark, d), memories(spark, d)), "score"),
)
_HYPE = "CASE WHEN contains(l, 'how long') OR contains(l, 'how many years') OR contains(l, 'how many months') THEN 'how_long' WHEN regexp_matches(l, '^when|what time|what date') THEN 'when' WHEN regexp_matches(l, '^who|whom') THEN 'who' WHEN regexp_matches(l, '^where|what place') THEN 'where' WHEN regexp_matches(l, '^(is|are|was|were|did|does|do|would|could) ') THEN 'yes_no' ELSE 'what' END"
_MADE_UP = f"replace(CASE {_HYPE} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in questions.HYPOTHETICAL.items()) + f" END, '{{person}}', coalesce(list_filter({asking._ONCE.format(_CAPS)}, lambda w: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, w))[1], '{{person}}'))"
_add(
    "search_hyde",
    f"""WITH {_BASE}, p AS (SELECT query_id AS pid, q FROM asked), {_basic_sql('p', 'b')}, made AS (SELECT query_id AS pid, {_MADE_UP} AS q FROM asked), mk AS {_hash_sql('made', 'pid', 'q')},
  near AS (SELECT pid, memory_id, round(sum(mk.weight * mh.weight), 9) AS score FROM mk JOIN mh USING (bucket) GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, memory_id) AS place FROM near WHERE score > 0) WHERE place <= 15),
  f AS (SELECT pid, memory_id, arg_min(score, kind) AS score FROM (SELECT pid, memory_id, score, 0 AS kind FROM best UNION ALL SELECT pid, memory_id, score, 1 FROM b WHERE place <= 15) GROUP BY ALL)
  SELECT pid AS query_id, memory_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, memory_id) AS rank FROM f) WHERE rank <= 15""",
    lambda spark, d: _rounded(hybrid.search_hypothetical(asked(spark, d), memories(spark, d)), "score"),
)
_add("search_with_reasoning", None, lambda spark, d: _rounded(hybrid.search_with_reasoning(asked(spark, d), memories(spark, d), edges(spark, d), index(spark, d)), "score"))
