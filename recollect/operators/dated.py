"""Dated lines of contexts, and answers about a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DAY, _MONTH_DAY, _ISO, _MONTH = r"^(\d{1,2} [A-Za-z]+ \d{4})", r"^([A-Za-z]+ \d{1,2},? \d{4})", r"^(\d{4}-\d{2}-\d{2})", r"^([A-Za-z]+ \d{4})"
_WHITE = r"[\t\n\f\r ]"  # white space within a line's date; at the ends of a text blanks of any width (Zs) go


def leading_date(text: Column) -> Column:
    """The date that a text begins with: ``7 May 2023``, ``May 7, 2023``, ISO, ``May 2023``, or that it is, a bare year; there is no year 0000."""
    return F.get(F.transform(F.array(_plain(text)), _parsed), F.lit(0))


def _plain(text: Column) -> Column:
    return F.initcap(F.regexp_replace(F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", ""), f"{_WHITE}+", " "))


def _parsed(plain: Column) -> Column:
    """Each form is parsed in its own format only, and only where it stands: a text that does not parse costs an exception."""
    found = lambda p: F.regexp_extract(plain, p, 1)
    forms = [
        (_DAY, "d MMMM yyyy", found(_DAY)), (_MONTH_DAY, "MMMM d yyyy", F.replace(found(_MONTH_DAY), F.lit(","), F.lit(""))),
        (_ISO, "yyyy-MM-dd", found(_ISO)), (_MONTH, "d MMMM yyyy", F.concat(F.lit("15 "), found(_MONTH))),
    ]
    days = [F.when(plain.rlike(p), F.try_to_date(x, form)) for p, form, x in forms]
    return F.coalesce(*days, F.when(plain.rlike(r"^\d{4}\z") & (plain != "0000"), F.make_date(plain.try_cast("int"), F.lit(6), F.lit(15))))


def dated_lines(contexts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, content, day, date_text, speaker, carried): the lines of a context that are not blank.

    A line's date stands in brackets, behind ``(Date:``, or anywhere in it, in this order; ``date_text`` is how
    it is written there.  ``speaker`` begins the line.  ``carried`` is the date of
    the line or else of the last dated line above it in the same context.
    """
    rows = contexts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "content")).where(~F.col("content").rlike(r"^\p{Zs}*\z"))
    line = F.col("content")
    written = [F.regexp_extract(line, p, 1) for p in (r"\[([^\]]+)\]", rf"\(Date:{_WHITE}*([^)]+)\)", rf"(\d{{1,2}}{_WHITE}+\w+{_WHITE}+\d{{4}})", rf"(\w+{_WHITE}+\d{{1,2}},?{_WHITE}+\d{{4}})", r"(\d{4})")]
    # array elements, so that each step is worked out once and not again wherever it is used
    tries = F.transform(F.transform(F.array(*written), lambda w: F.struct(w.alias("w"), _plain(w).alias("p"))), lambda t: F.struct(_parsed(t["p"]).alias("day"), t["w"].alias("date_text")))
    dated = F.when(line.rlike(r"\d{4}"), F.filter(tries, lambda t: t["day"].isNotNull()))
    rows = rows.withColumn("_d", F.get(dated, F.lit(0)))
    speaker = F.nullif(F.regexp_extract(line, rf"^-?{_WHITE}*\[?([A-Z][a-z]+)\]?:", 1), F.lit(""))
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*keys, "line", "content", F.col("_d.day").alias("day"), F.coalesce("_d.date_text", F.lit("")).alias("date_text"), speaker.alias("speaker"), F.last("_d.day", ignorenulls=True).over(before).alias("carried"))


def answer_point_in_time(asked: DataFrame, events: DataFrame, carried: bool = False) -> DataFrame:
    """(query_id, answer, confidence): the date of the line that shares most words of four letters with the question, 3 more for its speaker.

    ``events`` are dated lines with a ``query_id`` and further ``key``; of equal lines the first counts.  Only lines
    with a date of their own answer, or with ``carried`` also those below one, by that day.
    Questions without such a line have a null answer and no confidence.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b(\w{4,})\b"), F.lit(1)))
    told = F.date_format("carried", "d MMMM yyyy") if carried else F.nullif("date_text", F.lit(""))
    rows = events.withColumn("_told", F.when(F.col("date_text") != "", F.col("date_text")).otherwise(told) if carried else told).where("_told is not null")
    rows = rows.join(asked.select("query_id", F.lower("q").alias("_low"), words(F.col("q")).alias("_w")), "query_id")
    score = F.size(F.array_intersect(words(F.col("content")), F.col("_w"))) + F.when(F.contains("_low", F.lower("speaker")), 3).otherwise(0)
    rows = rows.withColumn("_s", score).where("_s > 0")
    best = rows.groupBy("query_id").agg(F.max_by(F.struct("_told", "_s"), F.struct("_s", (-F.col("key")).alias("k"), (-F.col("line")).alias("l"))).alias("b"))
    out = asked.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.col("b._told").alias("answer"), F.coalesce(F.least(F.lit(0.9), 0.4 + F.col("b._s") * 0.1), F.lit(0.0)).alias("confidence"))
