"""Registered retrieval over several kinds at once: facts about customers, turns that speak of them, paths between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import mixed
from recollect.plans import chains as chained
from recollect.plans import graphs as graphed
from recollect.plans import questions as asking
from recollect.plans import retrieval as searching
from recollect.plans.catalog import _TOK, _add, _read

WORDINGS = ["When did {N} meet {F}?", "How do {N} and {F} both like {S}?", "Where does {N} live?", "What do I know of {N} in {R}?", "Why does {N} like {S}?", "how long has {N} known {F}?", "Explain the connection of {N} to {F}"]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chained.asked(spark, sf_dir, WORDINGS)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, each told by a customer whose number is fifty times the conversation's; every third dates itself."""
    c = _read(spark, sf_dir, "conversations")
    who = F.concat(F.lit("Z"), F.translate((F.col("conv_id") * 50).cast("string"), "0123456789", "abcdefghij"))
    text = F.concat(F.when(F.col("turn") % 3 == 0, "It was yesterday. ").otherwise(""), who, F.lit(" told me this. "), "text")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("memory_id"), text.alias("text"), "turn", (1 - F.col("turn") / 10).alias("activation"), (F.col("conv_id") % 10 / 10).alias("importance"), F.col("turn").alias("rehearsals"))


def _retrieved(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    a, i, e = asked(spark, sf_dir), items(spark, sf_dir), graphed._person_edges(spark, sf_dir)
    seeds = a.select("query_id", F.explode(questions.names(F.col("q"))).alias("node")).join(e.select(F.col("source").alias("node")).distinct(), "node", "left_semi")
    return mixed.retrieve(a, searching.facts(spark, sf_dir), {"short": i.where("turn >= 4"), "long": i.where("turn < 4")}, e, seeds, k)


def _swaps() -> str:
    swap = lambda when, old, new: f"CASE WHEN {when} THEN replace(l, '{old}', '{new}') END"
    out = [swap(f"contains(l, '{w}')", w, s) for w, ss in mixed.SYNONYMS.items() for s in ss]
    out += [swap(f"starts_with(l, '{w}')", w, s) for w, ss in mixed.STARTS.items() for s in ss]
    return ", ".join(out + [swap(f"contains(l, '{w}')", w, s) for w, ss in mixed.INSIDE.items() for s in ss])


_RUN = r"(' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g')) || ' ')"
_NOUN = "upper('z') || translate(CAST(conv_id * 50 AS VARCHAR), '0123456789', 'abcdefghij')"


def _worded_sql(most: int) -> str:
    return f"""{chained.asked_sql(WORDINGS)}, f AS MATERIALIZED (SELECT *, list_distinct(string_split(lower(content), ' ')) AS w FROM (SELECT *, subject || ' ' || predicate || ' ' || object AS content FROM {searching._FACT_SQL})),
  ways AS MATERIALIZED (SELECT query_id, seq, q, list_distinct(string_split(lower(q), ' ')) AS t FROM (SELECT query_id, unnest(ws) AS q, unnest(range(0, len(ws))) AS seq FROM (SELECT query_id, list_concat([q], list_filter([{_swaps()}], lambda x: x IS NOT NULL)[1:3]) AS ws FROM asked))),
  tri AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seq ORDER BY score DESC, fact_id) AS place FROM (
    SELECT query_id, seq, fact_id, content, round(len(list_intersect(t, w)) / (len(t) + 1) + CASE WHEN contains({_RUN.format('q')}, {_RUN.format('subject')}) THEN 0.3 ELSE 0 END + CASE WHEN contains({_RUN.format('q')}, {_RUN.format('object')}) THEN 0.2 ELSE 0 END, 9) AS score
    FROM ways CROSS JOIN f WHERE is_current) WHERE score > 0) WHERE place <= {most})"""


_add(
    "search_triplets_by_text",
    f"WITH {_worded_sql(20)} SELECT query_id, fact_id, round(score, 6) AS score, CAST(place AS INT) AS rank FROM tri WHERE seq = 0 AND place <= 10",
    lambda spark, d: mixed.search_triplets(asked(spark, d), searching.facts(spark, d)).withColumn("score", F.round("score", 6)),
)
def _retrieved_sql(k: int) -> str:
    """The results of retrieval as the table ``retrieved``."""
    return f"""WITH {_worded_sql(2 * k)}, i AS MATERIALIZED (SELECT *, {_TOK} AS w FROM (SELECT conv_id * 100 + turn AS memory_id, conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'It was yesterday. ' ELSE '' END || {_NOUN} || ' told me this. ' || text AS text FROM conversations)),
  it AS (SELECT query_id, seq, memory_id, CASE WHEN turn >= 4 THEN 'short' ELSE 'long' END AS tier, text, round(0.3 * (1 - turn / 10) + 0.3 * (conv_id % 10 / 10) + 0.3 * len(list_intersect(t, w)) / (len(t) + 1) + 0.1 * least(1.0, ln(1 + turn) / 3.0), 6) AS score FROM ways JOIN i ON list_has_any(t, w)),
  each AS (SELECT *, row_number() OVER (PARTITION BY query_id, seq, tier ORDER BY score DESC, memory_id) AS r FROM it), best AS (SELECT *, row_number() OVER (PARTITION BY query_id, seq ORDER BY score DESC, memory_id) AS place FROM each WHERE r <= {2 * k}),
  a AS (SELECT query_id, q, l, list_distinct(string_split(l, ' ')) AS t FROM asked WHERE regexp_matches(l, '{'|'.join(mixed.SEVERAL_STEPS)}')), e AS (SELECT fact_id, subject AS source, predicate AS relation, object AS target, w FROM f WHERE is_current),
  b0 AS (SELECT query_id, n AS node, []::BIGINT[] AS path, [n] AS visited, 1.0::DOUBLE AS score FROM (SELECT query_id, unnest(list_filter({asking._CAPS}, lambda x: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, x))) AS n FROM a) WHERE n IN (SELECT source FROM e)),
  {graphed._grown_sql(1, 'b0')}, {graphed._grown_sql(2, 'b1')}, {graphed._grown_sql(3, 'b2')}, u AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3),
  paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS r FROM u) WHERE r <= 5),
  steps AS (SELECT query_id, path, score, unnest(path) AS fact_id, unnest(range(0, len(path))) AS at_step FROM paths),
  every AS (SELECT query_id, 'graph' AS kind, 'graph' AS source, CAST(fact_id AS VARCHAR) AS source_id, any_value(content) AS content, arg_min(score, seq) AS score, 0.05 AS bonus, 0 AS o FROM tri GROUP BY query_id, fact_id
    UNION ALL SELECT query_id, 'tier', 'tiered_' || tier, CAST(memory_id AS VARCHAR), any_value(text), arg_min(score, seq), 0, 1 FROM best WHERE place <= {2 * k} GROUP BY query_id, memory_id, tier
    UNION ALL SELECT query_id, 'path', 'coe_path', array_to_string(path, '>'), string_agg(content, ' -> ' ORDER BY at_step), any_value(score), 0.1, 2 FROM steps JOIN f USING (fact_id) GROUP BY query_id, path),
  scored AS (SELECT query_id, kind, source, source_id, content, o, round(score + bonus + 0.3 * len(list_intersect(t, {_TOK.replace('text', 'content')})) / (len(t) + 1) + CASE WHEN (regexp_matches(l, '^({'|'.join(mixed.TIME_STARTS)})') OR regexp_matches(l, '{'|'.join(mixed.TIME_INSIDE)}')) AND (regexp_matches(lower(content), '{'|'.join(mixed.TIME_WORDS)}') OR regexp_matches(content, '[0-9]{{4}}')) THEN 0.5 ELSE 0 END, 6) AS score
    FROM every JOIN (SELECT query_id, l, list_distinct(string_split(l, ' ')) AS t FROM asked) USING (query_id)),
  once AS (SELECT *, row_number() OVER (PARTITION BY query_id, left(lower(content), 50) ORDER BY score DESC, o, source_id) AS r FROM scored),
  retrieved AS MATERIALIZED (SELECT query_id, kind, source, source_id, content, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o, source_id) AS rank FROM once WHERE r = 1) WHERE rank <= {k})"""


_add("retrieve_v5", f"{_retrieved_sql(10)} SELECT * FROM retrieved", _retrieved)
_KEPT = "list_reduce(ls, lambda have, x: CASE WHEN x.head THEN {'used': have.used, 'out': have.out || chr(10) || x.line} WHEN have.used + length(x.line) < 8000 THEN {'used': have.used + length(x.line), 'out': have.out || chr(10) || x.line} ELSE have END, {'used': CAST(0 AS BIGINT), 'out': ''})"
_add(
    "build_context_v5",
    f"""{_retrieved_sql(15)}, n AS (SELECT query_id, kind, CASE kind WHEN 'graph' THEN 0 WHEN 'path' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY query_id, kind ORDER BY rank) AS n, '- ' || CASE kind WHEN 'path' THEN array_to_string(string_split(content, ' -> ')[1:3], ' -> ') ELSE content END AS line FROM retrieved),
  l AS (SELECT query_id, o, n, FALSE AS head, line FROM n WHERE n <= CASE kind WHEN 'path' THEN 3 ELSE 10 END UNION ALL SELECT DISTINCT query_id, o, 0, TRUE, CASE kind WHEN 'graph' THEN 'FACTS:' WHEN 'path' THEN chr(10) || 'REASONING PATHS:' ELSE chr(10) || 'MEMORIES:' END FROM n),
  g AS (SELECT query_id, list({{'head': head, 'line': line}} ORDER BY o, n) AS ls FROM l GROUP BY query_id) SELECT query_id, ({_KEPT}).out[2:] AS context FROM g""",
    lambda spark, d: mixed.build_context(_retrieved(spark, d, 15)),
)
