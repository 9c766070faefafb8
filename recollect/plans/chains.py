"""Registered chains of evidence: questions about two customers each, over the facts about all of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import chains, retrieval
from recollect.plans import questions as asking
from recollect.plans import retrieval as searching
from recollect.plans.catalog import _add, _read

WORDINGS = [
    "Would {N} likely move because {F} likes {S}?", "What do {N} and {F} like in {R}?", "Where does {N} live?", "Does {N} know {F}?", "Compare {N} and {F}", "Is {N} friend material given that {F} lives in {R}?",
    "Did {N} visit {R} and what does {F} like about the place?", "Why did nobody answer?", "Tell me what {N} likes and tell me what {N} likes", "Describe the friends of me and {F}",
]
_FRIEND = "upper('z') || translate(CAST(query_id + 1 AS VARCHAR), '0123456789', 'abcdefghij')"


def _cases(wordings: list[str]) -> str:
    out = []
    for i, w in enumerate(wordings):
        pieces = [{"N": "who", "F": _FRIEND, "R": "place", "S": "thing"}[p] if k % 2 else f"'{p}'" for k, p in enumerate(re.split(r"\{([NFRS])\}", w))]
        out.append(f"WHEN {i} THEN " + " || ".join(x for x in pieces if x != "''"))
    return f"CASE query_id // 50 % {len(wordings)} " + " ".join(out) + " END"


def asked_sql(wordings: list[str]) -> str:
    return f"asked AS (SELECT query_id, q, lower(q) AS l FROM (SELECT query_id, {_cases(wordings)} AS q FROM {asking.PEOPLE} WHERE query_id % 50 = 0))"


_ASKED = asked_sql(WORDINGS)


def asked(spark: SparkSession, sf_dir: str, wordings: list[str] = WORDINGS) -> DataFrame:
    """(query_id, q): a question of every customer whose id is divisible by 50, about it and the next one."""
    k = F.col("query_id")
    friend = F.concat(F.lit("Z"), F.translate((k + 1).cast("string"), "0123456789", "abcdefghij"))
    out = F.when(F.lit(False), F.lit(""))
    for i, w in enumerate(wordings):
        pieces = [{"N": F.col("who"), "F": friend, "R": F.col("place"), "S": F.col("thing")}[p] if n % 2 else F.lit(p) for n, p in enumerate(re.split(r"\{([NFRS])\}", w))]
        out = out.when(F.floor(k / 50) % len(wordings) == i, F.concat(*pieces))
    return asking.people(spark, sf_dir).where("query_id % 50 = 0").select("query_id", out.alias("q"))


def _filled(template: str, pattern: str) -> str:
    pieces = re.split(r"\{(\d)\}", template)
    group = lambda p: f"regexp_extract(l, '{pattern}', {int(p) + 1})"
    return " || ".join((f"(upper(left({group(p)}, 1)) || {group(p)}[2:])" if p == "0" else group(p)) if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces))


_NAMED = f"list_filter({asking._ONCE.format(asking._CAPS)}, lambda w: NOT list_contains({asking._list_sql(questions.NO_NAMES)}, w))"
_STEPS = "CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN [{', '.join(_filled(t, p) for t in ts)}]".replace("]+)'s", "]+)''s") for p, ts in questions.STEPS) + f" ELSE list_concat(list_transform({_NAMED}[1:3], lambda n: 'What do we know about ' || n || '?'), [q]) END"
_ABOUT = """about AS (SELECT e, fact_id, row_number() OVER (PARTITION BY e ORDER BY fact_id) AS nth FROM (SELECT lower(subject) AS e, fact_id FROM f WHERE is_current UNION SELECT lower(object), fact_id FROM f WHERE is_current))"""
_EVIDENCE = f"""WITH RECURSIVE {_ASKED}, f AS MATERIALIZED (SELECT *, list_distinct(string_split(lower(subject || ' ' || predicate || ' ' || object), ' ')) AS w, subject || ' ' || predicate || ' ' || object AS content FROM {searching._FACT_SQL}), {_ABOUT},
  steps AS MATERIALIZED (SELECT query_id, part, step, list_transform({_NAMED.replace('q,', 'part,').replace('(q', '(part')}, lambda x: lower(x)) AS es FROM (SELECT query_id, unnest(d) AS part, unnest(range(0, len(d))) AS step FROM (SELECT query_id, {_STEPS} AS d FROM asked))),
  scored AS (SELECT query_id, step, fact_id, len(list_intersect(list_distinct(string_split(lower(part), ' ')), w)) / (len(list_distinct(string_split(lower(part), ' '))) + 1) + CASE WHEN contains(lower(part), lower(subject)) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(part), predicate) THEN 0.2 ELSE 0 END AS score
    FROM steps JOIN f ON list_has_any(string_split(lower(part), ' '), w) WHERE is_current),
  hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY round(score, 6) DESC, fact_id) AS rank FROM scored) WHERE rank <= 5),
  named AS (SELECT query_id, step, unnest(es) AS e, unnest(range(0, len(es))) AS place FROM steps),
  kg AS MATERIALIZED (SELECT query_id, step, place, nth, e, fact_id FROM named JOIN about USING (e) WHERE nth <= 3),
  per AS MATERIALIZED (SELECT s.query_id, s.step, coalesce(any_value(h.es), []) AS hs, coalesce(any_value(k.es), []) AS ks FROM steps s
    LEFT JOIN (SELECT query_id, step, flatten(list([lower(subject), lower(object)])) AS es FROM hits JOIN f USING (fact_id) GROUP BY ALL) h USING (query_id, step) LEFT JOIN (SELECT query_id, step, list(e) AS es FROM kg GROUP BY ALL) k USING (query_id, step) GROUP BY ALL),
  seen AS (SELECT query_id, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS es FROM asked UNION ALL SELECT query_id, step + 1, list_distinct(list_concat(es, list_concat(hs, ks))) FROM seen JOIN per USING (query_id, step)),
  e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, step ORDER BY kind, a, b) AS nth FROM (
    SELECT query_id, step, 0 AS kind, rank AS a, 0 AS b, fact_id, CAST(NULL AS VARCHAR) AS entity, 'search' AS source, CAST(score AS DOUBLE) AS confidence FROM hits
    UNION ALL SELECT query_id, step, 1, place, kg.nth, fact_id, e, 'graph', 0.8 FROM kg JOIN seen USING (query_id, step) WHERE NOT list_contains(es, e))),
  evidence AS MATERIALIZED (SELECT e.*, part, content FROM e JOIN steps USING (query_id, step) JOIN f USING (fact_id))"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.evidence_chain(asked(spark, sf_dir), searching.facts(spark, sf_dir))


_add(
    "evidence_chain",
    f"{_EVIDENCE} SELECT query_id, CAST(step AS INT) AS step, part, CAST(nth AS INT) AS nth, fact_id, entity, source, round(confidence, 6) AS confidence, content FROM evidence",
    lambda spark, d: _evidence(spark, d).withColumn("confidence", F.round("confidence", 6)),
)
_SAYS = lambda words: f"len(list_filter(list(content), lambda c: regexp_matches(lower(c), '{'|'.join(words)}')))"
_add(
    "evidence_step_answers",
    f"""{_EVIDENCE}, p AS (SELECT query_id, step, part, array_to_string(list_transform(list(content ORDER BY nth)[1:3], lambda c: left(c, 100)), ' ') AS joined, {_SAYS(chains.TRUE)} AS good, {_SAYS(chains.FALSE)} AS bad FROM evidence GROUP BY ALL)
  SELECT query_id, CAST(step AS INT) AS step, part, CASE WHEN contains(lower(part), 'what do we know') THEN left(joined, 200) WHEN regexp_matches(lower(part), '^(is|are|does|did|would|could) ') AND good > bad THEN 'Evidence suggests yes.'
    WHEN regexp_matches(lower(part), '^(is|are|does|did|would|could) ') AND bad > good THEN 'Evidence suggests no.' ELSE left(joined, 150) END AS answer FROM p""",
    lambda spark, d: chains.step_answers(_evidence(spark, d)),
)
_add(
    "evidence_answers",
    f"""{_EVIDENCE}, p AS (SELECT query_id, count(*) AS n, sum(confidence * (1 + step / 2)) / sum(1 + step / 2) AS trust, {_SAYS(chains.FOR)} AS good, {_SAYS(chains.AGAINST)} AS bad, list(content ORDER BY step, nth) AS cs, arg_min(content, (-confidence, step, nth)) AS best FROM evidence GROUP BY query_id)
  SELECT query_id, CAST(coalesce(n, 0) AS INT) AS pieces, round(coalesce(trust, 0.0), 6) AS confidence, CASE WHEN n IS NULL THEN 'Insufficient information to answer.'
    WHEN regexp_matches(l, 'would|could|might|likely') THEN CASE WHEN good > bad THEN 'Yes, likely based on the evidence.' WHEN bad > good THEN 'No, unlikely based on the evidence.' ELSE 'Cannot determine with confidence.' END
    WHEN regexp_matches(l, 'what|which|describe') THEN array_to_string(list_transform(list_filter(cs[1:5], lambda c: length(c) > 10)[1:3], lambda c: left(trim(c), 100)), '; ') ELSE left(best, 150) END AS answer FROM asked LEFT JOIN p USING (query_id)""",
    lambda spark, d: chains.chain_answers(asked(spark, d), _evidence(spark, d)).withColumn("confidence", F.round("confidence", 6)),
)

# ---- steps that only count what is new, and the graph where a step adds nothing

_HYPE = "CASE WHEN contains(l, 'how long') OR contains(l, 'how many years') OR contains(l, 'how many months') THEN 'how_long' WHEN regexp_matches(l, '^when|what time|what date') THEN 'when' WHEN regexp_matches(l, '^who|whom') THEN 'who' WHEN regexp_matches(l, '^where|what place') THEN 'where' WHEN regexp_matches(l, '^(is|are|was|were|did|does|do|would|could) ') THEN 'yes_no' ELSE 'what' END"
_MADE_UP = f"replace(CASE {_HYPE} " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in questions.HYPOTHETICAL.items()) + f" END, '{{person}}', coalesce({_NAMED}[1], '{{person}}'))"
_OTHER_WORDS = f"list_concat(list_filter([{asking._OTHER}], lambda x: x IS NOT NULL), flatten(list_transform({asking._CAPS}[1:2], lambda n: ['What about ' || n || '?', 'Tell me about ' || n])))[1:2]"
_PARTS = searching._HOPS.split(",\nhop_hits")[0].replace("FROM a)", "FROM asked)")
_FOUND = f"""WITH RECURSIVE {_ASKED}, {_PARTS}, ways AS MATERIALIZED (SELECT query_id AS question, hop, part, list_distinct(list_concat([q, {_MADE_UP}], {_OTHER_WORDS})) AS ws FROM (SELECT *, part AS q, lower(part) AS l FROM hops)),
  worded AS (SELECT question * 1000 + hop * 10 + way AS query_id, w AS q, lower(w) AS l FROM (SELECT question, hop, unnest(ws) AS w, unnest(range(0, len(ws))) AS way FROM ways)),
  {searching._BASE.replace(f'FROM {asking.ASKED} WHERE query_id % 50 = 0', 'FROM worded').removeprefix('WITH ')},
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fact_id ORDER BY o, rank) AS r FROM (
    SELECT *, 0 AS o FROM ({searching._top_sql('keyword', 20)}) UNION ALL SELECT *, 1 FROM ({searching._top_sql('entity', 20)}) UNION ALL SELECT *, 2 FROM ({searching._top_sql('graph', 10)}) UNION ALL SELECT *, 3 FROM ({searching._top_sql('temporal', 40)}))) WHERE r = 1),
  boosted AS (SELECT query_id, fact_id, score + CASE WHEN row_number() OVER (PARTITION BY query_id, coalesce(fact_type, 'unknown') ORDER BY o, rank) = 1 THEN 0.1 ELSE 0 END AS score FROM fused LEFT JOIN f USING (fact_id)),
  direct AS MATERIALIZED (SELECT query_id // 1000 AS question, query_id // 10 % 100 AS hop, list(DISTINCT fact_id) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fact_id) AS rank FROM boosted) WHERE rank <= 10 GROUP BY ALL),
  {_ABOUT}, named AS (SELECT question, hop, unnest(es) AS e, unnest(range(0, len(es))) AS place FROM (SELECT question, hop, {asking._ENTITIES} AS es FROM (SELECT question, hop, part AS q, lower(part) AS l FROM ways))),
  beside AS (SELECT DISTINCT question, hop, place, CASE WHEN lower(subject) = e THEN lower(object) ELSE lower(subject) END AS o FROM named JOIN f ON lower(subject) = e OR lower(object) = e WHERE lower(subject) <> lower(object)),
  around AS (SELECT question, hop, place, list(fact_id ORDER BY fact_id)[1:12] AS g FROM (SELECT DISTINCT question, hop, place, fact_id FROM beside JOIN about ON about.e = o AND nth <= 12) GROUP BY ALL),
  per AS MATERIALIZED (SELECT w.question, w.hop, coalesce(any_value(d), []) AS d, coalesce(any_value(gs), []) AS gs FROM ways w LEFT JOIN direct USING (question, hop) LEFT JOIN (SELECT question, hop, list(g ORDER BY place) AS gs FROM around GROUP BY ALL) x USING (question, hop) GROUP BY ALL),
  run AS (SELECT query_id AS question, CAST(0 AS BIGINT) AS hop, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS added, '' AS source FROM asked
    UNION ALL SELECT question, hop + 1, list_concat(seen, CASE WHEN len(fresh) > 0 THEN fresh ELSE coalesce(near, []) END), CASE WHEN len(fresh) > 0 THEN fresh ELSE coalesce(near, []) END, CASE WHEN len(fresh) > 0 THEN 'search' ELSE 'graph' END
      FROM (SELECT question, hop, seen, list_filter(d, lambda x: NOT list_contains(seen, x)) AS fresh, list_filter(list_transform(gs, lambda g: list_filter(g, lambda x: NOT list_contains(seen, x))), lambda g: len(g) > 0)[1] AS near FROM run JOIN per USING (question, hop)))"""
_add(
    "reasoning_chain_v4",
    f"{_FOUND} SELECT query_id, CAST(step AS INT) AS step, part, fact_id, source FROM (SELECT question AS query_id, hop - 1 AS step, unnest(added) AS fact_id, source FROM run) r JOIN hops ON hops.query_id = r.query_id AND hops.hop = r.step".replace("SELECT query_id, CAST(step", "SELECT r.query_id, CAST(step"),
    lambda spark, d: chains.reasoning_chain(asked(spark, d), searching.facts(spark, d), searching.states(spark, d), near=12),
)
_STOP = asking._list_sql(chains.BRIDGE_STOP)
_add(
    "bridge_hop",
    f"""WITH {_ASKED}, f AS MATERIALIZED (SELECT *, subject || ' ' || predicate || ' ' || object AS content, list_distinct(string_split(lower(subject || ' ' || predicate || ' ' || object), ' ')) AS w FROM {searching._FACT_SQL}),
  s AS (SELECT query_id, fact_id, len(list_intersect(list_distinct(string_split(l, ' ')), w)) / (len(list_distinct(string_split(l, ' '))) + 1) + CASE WHEN contains(l, lower(subject)) THEN 0.3 ELSE 0 END + CASE WHEN contains(l, predicate) THEN 0.2 ELSE 0 END AS score FROM asked JOIN f ON list_has_any(string_split(l, ' '), w) WHERE is_current),
  k AS (SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(string_split(l, ' '), lambda x: x <> '' AND NOT list_contains({_STOP}, x))))[1:3], ' ') AS q FROM asked WHERE query_id NOT IN (SELECT query_id FROM s WHERE score >= 0.6)),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, fact_id) AS rank FROM (SELECT query_id, q, fact_id, content, len(list_intersect(list_distinct(string_split(q, ' ')), w)) / (len(list_distinct(string_split(q, ' '))) + 1) + CASE WHEN contains(q, lower(subject)) THEN 0.3 ELSE 0 END + CASE WHEN contains(q, predicate) THEN 0.2 ELSE 0 END AS score
    FROM k JOIN f ON list_has_any(string_split(q, ' '), w) WHERE is_current AND q <> ''))
  SELECT query_id, any_value(q) AS terms, string_agg(left(content, 200), ' | ' ORDER BY rank) FILTER (rank <= 3) AS evidence, round(CAST(least(1.0, avg(score) * CASE WHEN count(*) >= 3 THEN 1.1 ELSE 1 END) * 0.7 AS DOUBLE), 6) AS confidence FROM h WHERE rank <= 6 GROUP BY query_id""",
    lambda spark, d: (lambda a, f: chains.bridge_hop(a, retrieval.search_facts(a, f).where("score >= 0.6"), f).withColumn("confidence", F.round("confidence", 6)))(asked(spark, d), searching.facts(spark, d)),
)


def _matched_lines(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Every document is the context of the item that its number falls to."""
    contexts = docs.select((F.col("doc_id") % items.count()).alias("query_id"), F.col("doc_id").alias("key"), "text")
    return chains.context_lines_match(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), contexts)


_LONG = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 4))"
_add(
    "context_lines_match",
    f"""WITH a AS (SELECT item_id AS query_id, {_LONG.format('text')} AS w FROM benchmark), l AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id AS key, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
  m AS (SELECT query_id, key, CAST(line AS INT) AS line, content, CAST(len(list_intersect({_LONG.format('content')}, w)) AS INT) AS shared FROM l JOIN a USING (query_id) WHERE trim(content) <> '')
  SELECT *, round(CAST(least(1.0, shared * 0.2) AS DOUBLE), 6) AS confidence FROM m WHERE shared >= 2""",
    lambda spark, d: _matched_lines(_read(spark, d, "benchmark"), _read(spark, d, "documents")).withColumn("confidence", F.round("confidence", 6)),
)
