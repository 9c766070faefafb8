"""Registered dated lines: documents as contexts of benchmark items, most of their lines with a date or a speaker in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import dated
from recollect.plans.catalog import _add, _read

FRONTS = ["[7 May 2023] ", "(Date: May 8, 2023) ", "Ann: we met on 9 June 2022, ", "in 2021 it was ", "[no date] ", "- [Bob]: ", ""]


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, key, text): every document belongs to the item that its number falls to."""
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark").count()
    fronts = F.array(*map(F.lit, FRONTS))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(fronts, ((F.col("doc_id") + i * 3) % len(FRONTS)).cast("int")), x))
    return docs.select((F.col("doc_id") % items).alias("query_id"), F.col("doc_id").alias("key"), F.array_join(lines, "\n").alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    return _read(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.concat("text", F.when(i % 3 == 0, " When did Ann say so?").when(i % 3 == 1, " And Bob?").otherwise("")).alias("q"))


def _date_sql(x: str) -> str:
    plain = rf"regexp_replace(trim({x}), '\s+', ' ', 'g')"
    got = lambda p: f"regexp_extract({plain}, '{p}', 1)"
    year = rf"CASE WHEN regexp_full_match({plain}, '[0-9]{{4}}') AND {plain} <> '0000' THEN make_date(CAST({plain} AS INT), 6, 15) END"
    return (
        rf"coalesce(CAST(try_strptime({got('^([0-9]{1,2} [A-Za-z]+ [0-9]{4})')}, '%d %B %Y') AS DATE), CAST(try_strptime(replace({got('^([A-Za-z]+ [0-9]{1,2},? [0-9]{4})')}, ',', ''), '%B %d %Y') AS DATE), "
        rf"CAST(try_strptime({got('^([0-9]{4}-[0-9]{2}-[0-9]{2})')}, '%Y-%m-%d') AS DATE), CAST(try_strptime('15 ' || {got('^([A-Za-z]+ [0-9]{4})')}, '%d %B %Y') AS DATE), {year})"
    )


_WRITTEN = [r"\[([^\]]+)\]", r"\(Date:\s*([^)]+)\)", r"([0-9]{1,2}\s+\w+\s+[0-9]{4})", r"(\w+\s+[0-9]{1,2},?\s+[0-9]{4})", r"([0-9]{4})"]
_LINES = (
    f"""c AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id AS key, unnest(ls) AS raw, unnest(range(0, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  l AS (SELECT query_id, key, line, ['{"', '".join(FRONTS)}'][(key + line * 3) % {len(FRONTS)} + 1] || raw AS content FROM c),
  w AS (SELECT *, {", ".join(f"regexp_extract(content, '{p}', 1) AS w{i}" for i, p in enumerate(_WRITTEN))} FROM l WHERE trim(content) <> ''),
  p AS (SELECT *, {", ".join(f"{_date_sql(f'w{i}')} AS d{i}" for i in range(5))} FROM w),
  lines AS MATERIALIZED (SELECT query_id, key, line, content, coalesce(d0, d1, d2, d3, d4) AS day, CASE WHEN d0 IS NOT NULL THEN w0 WHEN d1 IS NOT NULL THEN w1 WHEN d2 IS NOT NULL THEN w2 WHEN d3 IS NOT NULL THEN w3 WHEN d4 IS NOT NULL THEN w4 ELSE '' END AS date_text,
    nullif(regexp_extract(content, '^-?\\s*\\[?([A-Z][a-z]+)\\]?:', 1), '') AS speaker, last_value(coalesce(d0, d1, d2, d3, d4) IGNORE NULLS) OVER (PARTITION BY query_id, key ORDER BY line ROWS UNBOUNDED PRECEDING) AS carried FROM p)"""
)
_NUMBER = lambda d: f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS INT)"


def _shown(rows: DataFrame) -> DataFrame:
    number = lambda d: (F.year(d) * 10000 + F.month(d) * 100 + F.day(d)).cast("int")
    return rows.select("key", "line", F.md5(F.col("content").cast("binary")).alias("content"), number(F.col("day")).alias("day"), "date_text", "speaker", number(F.col("carried")).alias("carried"))


_add(
    "events_from_context",
    f"WITH {_LINES} SELECT key, CAST(line AS INT) AS line, md5(content) AS content, {_NUMBER('day')} AS day, date_text, speaker, {_NUMBER('carried')} AS carried FROM lines",
    lambda spark, d: _shown(dated.dated_lines(contexts(spark, d), ["query_id", "key"])),
)
_LONG = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: length(w) >= 4))"
_ASKED = "a AS (SELECT item_id AS query_id, q, lower(q) AS l FROM (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' When did Ann say so?' WHEN 1 THEN ' And Bob?' ELSE '' END AS q FROM benchmark))"


def _answers_sql(told: str) -> str:
    return f"""WITH {_LINES}, {_ASKED}, t AS (SELECT *, {told} AS told FROM lines),
  s AS (SELECT query_id, key, line, told, len(list_intersect({_LONG.format('content')}, {_LONG.format('q')})) + CASE WHEN contains(l, lower(speaker)) THEN 3 ELSE 0 END AS s FROM t JOIN a USING (query_id) WHERE told IS NOT NULL),
  b AS (SELECT query_id, arg_max(told, (s, -key, -line)) AS told, max(s) AS s FROM s WHERE s > 0 GROUP BY query_id)
  SELECT query_id, told AS answer, round(coalesce(least(0.9, 0.4 + s * 0.1), 0.0), 6) AS confidence FROM a LEFT JOIN b USING (query_id)"""


def _answered(spark: SparkSession, sf_dir: str, carried: bool) -> DataFrame:
    rows = dated.dated_lines(contexts(spark, sf_dir), ["query_id", "key"])
    return dated.answer_point_in_time(asked(spark, sf_dir), rows, carried).withColumn("confidence", F.round("confidence", 6))


_add("answer_point_in_time", _answers_sql("nullif(date_text, '')"), lambda spark, d: _answered(spark, d, False))
_add("answer_carried_date", _answers_sql("CASE WHEN date_text <> '' THEN date_text ELSE ltrim(strftime(carried, '%d %B %Y'), '0') END"), lambda spark, d: _answered(spark, d, True))
