"""Registered queries about questions: one of every customer, in twelve wordings, and the benchmark items."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import intents, questions
from recollect.operators import shared
from recollect.plans.catalog import _add, _mention_sql, _read

WORDINGS = [
    "When did {N} visit {R} and leave home?", "How long has {N} been living in {R}?", "Where does {N} live?", "Who is the friend of {N} and me?", "What does {N} like about the work in {R}?", "How many years ago did {N} move from {R}?",
    "Does {N} prefer {S} or {R}?", "Compare the {S} in {R} and the life of {N}", "Why did {N} move after the trip to {R}?", "How often does {N} go to the family in {R} and what does the hobby of {N} cost in time that is free?",
    "What happened before {N} went to {R}?", "Would {N} likely work in {R} if the job was {S}?",
]
_NAME_SQL = "upper('z') || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij')"
_REGION_SQL = "CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(left(r_name, 1)) || lower(substr(r_name, 2)) END"


def _worded_sql() -> str:
    cases = []
    for i, w in enumerate(WORDINGS):
        pieces = [{"N": "who", "R": "place", "S": "thing"}[p] if k % 2 else f"'{p}'" for k, p in enumerate(re.split(r"\{([NRS])\}", w))]
        cases.append(f"WHEN {i} THEN " + " || ".join(pieces))
    return f"CASE query_id % {len(WORDINGS)} " + " ".join(cases) + " END"


PEOPLE = f"(SELECT c_custkey AS query_id, {_NAME_SQL} AS who, {_REGION_SQL} AS place, lower(c_mktsegment) AS thing FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"
ASKED = f"(SELECT query_id, who, place, thing, {_worded_sql()} AS q, lower({_worded_sql()}) AS l FROM {PEOPLE})"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, who, place, thing) of every customer; the name is the key in letters."""
    customer, nation, region = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    who = F.concat(F.lit("Z"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    rows = shared.spread(rows.select("c_custkey", "r_name", "c_mktsegment"), "c_custkey")
    return rows.select(F.col("c_custkey").alias("query_id"), who.alias("who"), F.initcap("r_name").alias("place"), F.lower("c_mktsegment").alias("thing"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, who, place, thing, q): a question of every customer."""
    out = F.when(F.lit(False), F.lit(""))
    for i, w in enumerate(WORDINGS):
        pieces = [F.col({"N": "who", "R": "place", "S": "thing"}[p]) if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{([NRS])\}", w))]
        out = out.when(F.col("query_id") % len(WORDINGS) == i, F.concat(*pieces))
    return people(spark, sf_dir).withColumn("q", out)


def _ask(name: str, sql: str, build) -> None:
    _add(name, sql.replace("ASKED", ASKED), lambda spark, d: build(shared.spread(asked(spark, d), "query_id")))


def _list_sql(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any_sql(words: list[str]) -> str:
    return _mention_sql(words).replace("lower(text)", "l") + " > 0"


def _listed(name: str, how, sql: str) -> None:
    """A list of texts of every question, as one text."""
    _ask(name, f"SELECT query_id, array_to_string({sql}, ' | ') AS found FROM ASKED", lambda a: a.select("query_id", F.array_join(how(F.col("q")), " | ").alias("found")))


_listed("key_terms", questions.key_terms, f"list_filter(regexp_split_to_array(l, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list_sql(questions.STOP_TERMS)}, w))[1:10]")
_WORDS = "list_filter(regexp_split_to_array(q, '[^A-Za-z0-9_]+'), lambda w: w <> '')"
_CAPS = f"list_filter({_WORDS}, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_listed("search_keywords", questions.search_keywords, _ONCE.format(f"list_concat(list_filter(list_transform({_WORDS}, lambda w: lower(w)), lambda w: length(w) > 2 AND NOT list_contains({_list_sql(questions.STOP_KEYWORDS)}, w)), list_transform({_CAPS}, lambda w: lower(w)))"))
_ENTITIES = f"list_concat(list_transform(list_filter({_ONCE.format(_CAPS)}, lambda w: NOT list_contains({_list_sql(questions.NO_NAMES)}, w)), lambda w: lower(w)), CASE WHEN list_has_any(string_split(l, ' '), {_list_sql(questions.SELF)}) THEN ['user'] ELSE [] END)"
_listed("query_entities", questions.entities, _ENTITIES)
_ask(
    "query_flags", "SELECT query_id, " + ", ".join(f"{_any_sql(v)} AS is_{k}" for k, v in questions.FLAGS.items()) + f", regexp_matches(l, '{'|'.join(questions.MULTI_HOP)}') AS is_multi_hop FROM ASKED",
    lambda a: a.select("query_id", *[c.alias(n) for n, c in questions.flags(F.col("q")).items()]),
)
_ask("question_type", "SELECT query_id, CASE " + " ".join(f"WHEN regexp_matches(l, '{p}') THEN '{n}'" for n, ps in questions.TYPES for p in ps) + " ELSE 'what' END AS kind FROM ASKED", lambda a: a.select("query_id", questions.question_type(F.col("q")).alias("kind")))
_ask("temporal_question_type", "SELECT query_id, CASE " + " ".join(f"WHEN {_any_sql(ws)} THEN '{n}'" for n, ws in questions.TIME_TYPES) + " ELSE 'other' END AS kind FROM ASKED", lambda a: a.select("query_id", questions.temporal_type(F.col("q")).alias("kind")))


def _filled_sql(template: str, pattern: str) -> str:
    pieces = re.split(r"\{(\d)\}", template)
    return " || ".join(f"regexp_extract(l, '{pattern}', {int(p) + 1})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(pieces))


_HALVES = "list_transform(string_split(q, ' and '), lambda p: trim(p))"
_PARTS_SQL = " ".join(f"WHEN regexp_matches(l, '{p}') THEN {{'kind': '{k}', 'reasoning': TRUE, 'parts': [{', '.join(_filled_sql(t, p) for t in ts)}]}}" for p, ts, k in questions.PARTS)
_ask(
    "decompose_v3",
    f"""SELECT query_id, d.kind AS kind, d.reasoning AS reasoning, unnest(d.parts) AS part, unnest(range(0, len(d.parts))) AS seq FROM (SELECT query_id, CASE {_PARTS_SQL}
  WHEN contains(l, ' and ') AND length(q) > 30 AND len({_HALVES}) = 2 AND len(list_filter({_HALVES}, lambda p: length(p) > 10)) = 2 THEN {{'kind': 'multi-hop', 'reasoning': TRUE, 'parts': list_transform({_HALVES}, lambda p: rtrim(p, '?') || '?')}}
  WHEN {_any_sql(questions.HOP_WORDS)} OR {_any_sql(questions.TIME_HINTS)} THEN {{'kind': CASE WHEN {_any_sql(questions.TIME_HINTS)} THEN 'temporal' ELSE 'multi-hop' END, 'reasoning': {_any_sql(questions.HOP_WORDS)}, 'parts': [q]}}
  ELSE {{'kind': 'simple', 'reasoning': FALSE, 'parts': [q]}} END AS d FROM ASKED)""",
    lambda a: a.withColumn("d", questions.decompose(F.col("q"))).select("query_id", "d.kind", "d.reasoning", F.posexplode("d.parts").alias("seq", "part")),
)
_listed(
    "decompose_rag", questions.decompose_long,
    "CASE WHEN len(string_split(q, ' ')) > 15 THEN list_concat(CASE WHEN contains(l, ' and ') THEN string_split(q, ' and ') ELSE [] END, list_transform(regexp_extract_all(q, '(?:the\\s+)?\\w+\\s+(?:of|from|at|in)\\s+(?:the\\s+)?(.+?)(?:\\s+(?:that|who|which)|$)', 1), lambda y: 'What is ' || y || '?'))[1:4] ELSE [q] END",
)
_KNOWN = "regexp_extract(q, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b', 1)"
_listed(
    "follow_up_queries", questions.follow_ups,
    f"""list_filter([CASE WHEN {_KNOWN} <> '' THEN 'What do we know about ' || {_KNOWN} || '?' END, CASE WHEN {_KNOWN} <> '' THEN 'What has ' || {_KNOWN} || ' done recently?' END, CASE WHEN {_any_sql(['when', 'time', 'date'])} THEN 'What dates or times are mentioned?' END,
  CASE WHEN {_any_sql(['did', 'went', 'attended', 'visited'])} THEN 'What events or activities occurred?' END, CASE WHEN {_any_sql(['like', 'prefer', 'favorite', 'enjoy'])} THEN 'What preferences have been mentioned?' END], lambda x: x IS NOT NULL)[1:3]""",
)
_OTHER = ", ".join(f"CASE WHEN regexp_matches(l, '\\b{w}\\b') THEN regexp_replace(l, '\\b{w}\\b', '{s}', 'g') END" for w, ss in questions.SYNONYMS.items() for s in ss)
_listed("expand_query", questions.expand, f"list_concat([q], list_concat(list_filter([{_OTHER}], lambda x: x IS NOT NULL), flatten(list_transform({_CAPS}[1:2], lambda n: ['What about ' || n || '?', 'Tell me about ' || n])))[1:3])")
_add(
    "benchmark_key_terms",
    f"SELECT item_id, CAST(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_list_sql(questions.STOP_TERMS)}, w))[1:10]) AS INT) AS n FROM benchmark",
    lambda spark, d: _read(spark, d, "benchmark").select("item_id", F.size(questions.key_terms(F.col("text"))).alias("n")),
)


def _score_sql(i: int) -> str:
    _, weight, keywords, patterns = intents.INTENTS[i]
    return f"{weight} * ({_mention_sql(keywords).replace('lower(text)', 'l')}" + "".join(f" + 1.5 * regexp_matches(l, '{p}')::INT" for p in patterns) + ")"


_INTENTS_SQL = "[" + ", ".join(f"{{'s': CAST({_score_sql(i)} AS DOUBLE), 'o': {-i}, 'n': '{name}'}}" for i, (name, *_) in enumerate(intents.INTENTS)) + "]"
_BEST = f"list_reverse_sort(list_filter({_INTENTS_SQL}, lambda x: x.s > 0))"
INTENT = f"(SELECT query_id, CASE WHEN len(b) > 0 THEN b[1].n ELSE 'general' END AS intent, array_to_string(list_transform(list_filter(b[2:], lambda x: x.s > 0.5)[1:2], lambda x: x.n), ' | ') AS secondary FROM (SELECT query_id, {_BEST} AS b FROM ASKED))"



_ask(
    "intent_plan",
    f"SELECT query_id, intent, secondary, CASE intent {' '.join(f'''WHEN '{k}' THEN '{' | '.join(t)}' ''' for k, (t, _) in intents.PROFILES.items())} END AS tiers, CASE intent {' '.join(f'''WHEN '{k}' THEN {w[2]}::DOUBLE ''' for k, (_, w) in intents.PROFILES.items())} END AS similarity FROM {INTENT}",
    lambda a: a.withColumn("p", intents.plan(F.col("q"))).select("query_id", "p.intent", F.array_join("p.secondary", " | ").alias("secondary"), F.array_join("p.tiers", " | ").alias("tiers"), F.col("p.similarity").alias("similarity")),
)
