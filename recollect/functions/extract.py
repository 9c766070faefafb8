"""Rules that turn turns of text into typed rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STAMP = r"\[?\(?\b\d{1,2}:\d{2}\s*(?:am|pm)?\s+on\s+\d{1,2}\s+\w+,?\s+\d{4}\)?\]?"

_END = r"(?=[.,!?;]|$)"
_THING = r"([a-z0-9][a-z0-9' -]*?)"
# A word's beginning is tested behind its letters: most places of a text fail at the first letter, and a test of \b costs more.
_I, _MY, _FOR = r"i(?<=\bi)", r"my(?<=\bmy)", r"for(?<=\bfor)"
#: (pattern with one group, the object; the relation it states, no other pattern does; its type; whether "and" and commas part it).
FACT_PATTERNS = [
    (rf"{_I} (?:really |absolutely )?(?:love|like|enjoy) ([a-z][a-z0-9' ,-]*?)(?=[.!?;]|$)", "likes", "preference", True),
    (rf"{_I} (?:really )?(?:hate|dislike|can't stand) ([a-z][a-z' ,-]*?)(?=[.!?;]|$)", "dislikes", "preference", True),
    (rf"{_MY} favorite [a-z]+ is {_THING}{_END}", "favorite", "preference", False),
    (rf"{_I} moved from {_THING}(?= \d+ (?:years?|months?|weeks?|days?) ago|[.,!?;]|$)", "moved_from", "state_change", False),
    (rf"{_I} (?:live in|moved to) {_THING}(?= \d+ | since |[.,!?;]|$)", "lives_in", "location", False),
    (rf"{_I} work (?:at|for) {_THING}(?= as |[.,!?;]|$)", "works_at", "work", False),
    (rf"{_I} work (?:(?:at|for) [a-z0-9' -]*?)?\s?as an? {_THING}{_END}", "works_as", "work", False),
    (rf"{_I}(?: am|'m) an? {_THING}{_END}", "is_a", "identity", False),
    (rf"{_I}(?: am|'m) (single|married|engaged|divorced|vegetarian|vegan)\b", "status", "status", False),
    (rf"{_I}(?: am|'m) married to {_THING}{_END}", "married_to", "relationship", False),
    (rf"{_I}(?: have|'ve) been friends with {_THING}(?= for |[.,!?;]|$)", "friends_with", "relationship", False),
    (rf"{_MY} (?:friend|wife|husband|brother|sister|mother|father|son|daughter) ([a-z]+)\b", "knows", "relationship", False),
    (rf"{_MY} name is {_THING}{_END}", "name", "attribute", False),
    (rf"{_I} have (?:a|an|two|three) {_THING}{_END}", "has", "attribute", False),
    (rf"{_I} (?:went to|visited|attended) {_THING}(?= yesterday| last |[.,!?;]|$)", "visited", "event", False),
    (rf"{_FOR} (\d+ (?:years?|months?|weeks?|days?))\b", "lasts", "temporal", False),
]
LONGEST = 60  # characters of an object


def strip_timestamps(text: Column) -> Column:
    """The text without clock stamps such as ``[1:56 pm on 8 May, 2023]``, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?i){_STAMP}", " "), r"\s+", " "))


def clean_format(text: Column) -> Column:
    """The text without a leading ``Name:`` and without blanks before punctuation."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*\p{Lu}\p{L}+:\s+", ""), r"\s+([.,!?;:])", "$1")


def resolve_first_person(text: Column, speaker: Column) -> Column:
    """I, me and myself become the speaker, my and mine the speaker's."""
    named = F.regexp_replace(text, F.lit(r"(?i)\b(?:my|mine)\b"), F.concat(speaker, F.lit("'s")))
    return F.regexp_replace(named, F.lit(r"\bI\b|(?i)\b(?:me|myself)\b"), speaker)


def extract_facts(turns: DataFrame, text: str = "text") -> DataFrame:
    """The turn's columns with (relation, fact_type, object) for every match of a pattern, in lower case, each once.

    What is liked or disliked is parted at commas and "and"; objects of one or over 60 characters drop.
    """
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))

    def facts(pattern: str, relation: str, kind: str, parted: bool) -> Column:
        found = F.regexp_extract_all("_low", F.lit(pattern), F.lit(1))
        if parted:
            found = F.flatten(F.transform(found, lambda o: F.split(o, r"\s*,\s*(?:and\s+)?|\s+and\s+")))
        kept = F.filter(F.array_distinct(F.transform(found, lambda o: F.trim(o))), lambda o: F.length(o).between(2, LONGEST))
        return F.transform(kept, lambda o: F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("fact_type"), o.alias("object")))

    said = turns.withColumn("_low", lower).withColumn("_fact", F.explode(F.concat(*[facts(*p) for p in FACT_PATTERNS])))
    return said.select(*turns.columns, "_fact.relation", "_fact.fact_type", "_fact.object")


def duration_days(text: Column) -> Column:
    """Days of the first ``N years/months/weeks/days`` at 365, 30, 7 and 1; null without one."""
    pattern = r"(?i)\b(\d+)\s+(year|month|week|day)s?\b"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    days = F.when(unit == "year", 365).when(unit == "month", 30).when(unit == "week", 7).when(unit == "day", 1)
    return F.regexp_extract(text, pattern, 1).try_cast("int") * days


def parse_date_any(text: Column) -> Column:
    """A date from ``7 May 2023``, ``May 7, 2023``, ISO, ``May 2023`` (the 15th) or a year (15 June)."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    tries = [F.try_to_date(plain, f) for f in ("d MMMM yyyy", "MMMM d yyyy", "yyyy-MM-dd")]
    month = F.try_to_date(F.concat(F.lit("15 "), plain), "d MMMM yyyy")
    year = F.when(plain.rlike(r"^\d{4}$"), F.make_date(plain.try_cast("int"), F.lit(6), F.lit(15)))
    return F.coalesce(*tries, month, year)


def as_statement(subject: Column, relation: Column, target: Column) -> Column:
    """A sentence for a fact."""
    return F.concat_ws(" ", subject, F.replace(relation, F.lit("_"), F.lit(" ")), target)


_UNITS = {"year": 365, "month": 30, "week": 7, "day": 1}
# Words for numbers in spans of time.
VAGUE = {"a couple of": 2, "a couple": 2, "a few": 3, "several": 5, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "few": 3, "couple of": 2}
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_MONTH = "january|february|march|april|may|june|july|august|september|october|november|december"
_COUNT = r"(\d+|" + "|".join(sorted(VAGUE, key=len, reverse=True)) + r")"
_SPAN = _COUNT + r"\s+(year|month|week|day)s?"


def _count(word: Column) -> Column:
    out = word.try_cast("int")
    for name, n in VAGUE.items():
        out = F.when(word == name, F.lit(n)).otherwise(out)
    return out


def _unit_days(unit: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, days in _UNITS.items():
        out = F.when(unit == name, F.lit(days)).otherwise(out)
    return out


def duration(text: Column, as_of: Column) -> Column:
    """struct(kind, days, start) of the first form that a text has, of: N units ago, since [Month] Year, for / been / over / about / nearly N units, in Year, last year or month.

    N may be a number or a few, several, a couple; years, months and weeks have 365, 30 and 7 days.
    """
    low = F.lower(F.coalesce(text, F.lit("")))

    def spanned(kind: str, pattern: str) -> tuple[Column, Column]:
        days = _count(F.regexp_extract(low, pattern, 1)) * _unit_days(F.regexp_extract(low, pattern, 2))
        return low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), days.alias("days"), F.date_sub(as_of.cast("date"), days).alias("start"))

    def dated(kind: str, pattern: str, start: Column) -> tuple[Column, Column]:
        return low.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.datediff(as_of.cast("date"), start).alias("days"), start.alias("start"))

    month, year = rf"\bsince ({_MONTH}) (\d{{4}})\b", r"\bsince (\d{4})\b"
    first = F.try_to_date(F.concat(F.lit("1 "), F.initcap(F.regexp_extract(low, month, 1)), F.lit(" "), F.regexp_extract(low, month, 2)), "d MMMM yyyy")
    forms = [
        spanned("ago", rf"\b{_SPAN} ago\b"), dated("since", month, first), dated("since", year, F.make_date(F.regexp_extract(low, year, 1).try_cast("int"), F.lit(1), F.lit(1))),
        spanned("for", rf"\bfor (?:over |about |nearly |almost )?{_SPAN}\b"), spanned("for", rf"\b(?:been|over|about|nearly) {_SPAN}\b"),
        dated("in", r"\bin (\d{4})\b", F.make_date(F.regexp_extract(low, r"\bin (\d{4})\b", 1).try_cast("int"), F.lit(1), F.lit(1))),
    ]
    out = F.when(F.lit(False), forms[0][1])
    for test, value in forms:
        out = out.when(test, value)
    for word, days in (("year", 365), ("month", 30)):
        out = out.when(F.contains(low, F.lit(f"last {word}")), F.struct(F.lit("ago").alias("kind"), F.lit(days).alias("days"), F.date_sub(as_of.cast("date"), days).alias("start")))
    return out


def durations_all(text: Column) -> Column:
    """array<struct(kind, value, unit)> of every span in a text, those with "ago" first, then "for", then the others."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(kind: str, before: str, after: str) -> Column:
        hits = F.regexp_extract_all(low, F.lit(rf"{before}{_SPAN}{after}"), F.lit(0))
        span = rf"{_SPAN}"
        return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), _count(F.regexp_extract(h, span, 1)).alias("value"), F.regexp_extract(h, span, 2).alias("unit")))

    return F.concat(found("ago", r"\b", r" ago\b"), found("for", r"\bfor ", r"\b(?! ago)"), found("span", r"(?<!\bfor )(?<!\bfor a )\b", r"\b(?! ago)"))


def relative_date(text: Column, as_of: Column) -> Column:
    """The date of yesterday, tomorrow, last week, N days ago, last Friday ... counted from ``as_of``; the longest phrase first."""
    low, day = F.lower(F.coalesce(text, F.lit(""))), as_of.cast("date")
    out = F.when(F.contains(low, F.lit("day before yesterday")), F.date_sub(day, 2)).when(F.contains(low, F.lit("yesterday")), F.date_sub(day, 1)).when(F.contains(low, F.lit("today")), day).when(F.contains(low, F.lit("tomorrow")), F.date_add(day, 1))
    for word, days in (("week", 7), ("month", 30), ("year", 365)):
        out = out.when(F.contains(low, F.lit(f"last {word}")), F.date_sub(day, days))
    ago = rf"\b{_SPAN} ago\b"
    out = out.when(low.rlike(ago), F.date_sub(day, _count(F.regexp_extract(low, ago, 1)) * _unit_days(F.regexp_extract(low, ago, 2))))
    for i, name in enumerate(WEEKDAYS):
        back = F.pmod(F.weekday(day) - i, F.lit(7))
        out = out.when(F.contains(low, F.lit(f"last {name}")), F.date_sub(day, F.when(back == 0, 7).otherwise(back)))
    return out


def normalise_date(text: Column, as_of: Column) -> Column:
    """A relative or absolute date of a text as ``d Month yyyy``."""
    absolute = F.coalesce(parse_date_any(F.regexp_extract(text, rf"(?i)\b(\d{{1,2}} (?:{_MONTH}),? \d{{4}})\b", 1)), parse_date_any(F.regexp_extract(text, rf"(?i)\b((?:{_MONTH}) \d{{1,2}},? \d{{4}})\b", 1)), F.try_to_date(F.regexp_extract(text, r"\b(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd"))
    return F.date_format(F.coalesce(absolute, relative_date(text, as_of)), "d MMMM yyyy")


def rewrite_dates(text: Column, as_of: Column) -> Column:
    """The text with yesterday, last year and next month put as a date, a year and a month."""
    day = as_of.cast("date")
    for word, value in (("yesterday", F.date_format(F.date_sub(day, 1), "d MMMM yyyy")), ("last year", F.date_format(F.add_months(day, -12), "yyyy")), ("next month", F.date_format(F.add_months(day, 1), "MMMM yyyy"))):
        text = F.regexp_replace(text, F.lit(rf"(?i)\b{word}\b"), value)
    return text


def dates_match(a: Column, b: Column, days: int = 1) -> Column:
    """Whether two written dates lie within some days, or one text holds the other."""
    x, y = parse_date_any(a), parse_date_any(b)
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(F.datediff(x, y)) <= days).otherwise(F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)))


# Standard words and the single words that they stand for.
TERMS = {
    "hiking": ["hike", "hikes", "hiked", "trekking", "trek"], "running": ["run", "runs", "ran", "jogging", "jog"], "swimming": ["swim", "swims", "swam"], "reading": ["read", "reads"],
    "cooking": ["cook", "cooks", "cooked"], "painting": ["paint", "paints", "painted"], "camping": ["camp", "camps", "camped"], "traveling": ["travel", "travels", "traveled", "travelling"],
    "loves": ["love", "adore", "adores", "adored"], "likes": ["like", "enjoy", "enjoys", "enjoyed"], "dislikes": ["dislike", "hate", "hates", "hated"], "single": ["unmarried"], "married": ["wed", "wedded", "spouse"],
    "years": ["year", "yrs", "yr"], "months": ["month", "mo"], "weeks": ["week", "wk"], "days": ["day"],
}


def standardise_terms(text: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """Words replaced by their standard form; a capital and the punctuation behind a word stay."""
    table = F.create_map(*[F.lit(x) for standard, words in (terms or TERMS).items() for w in words for x in (w, standard)])

    def one(w: Column) -> Column:
        bare, tail = F.regexp_replace(w, r"[.,!?;:]+$", ""), F.regexp_extract(w, r"([.,!?;:]+)$", 1)
        found = F.try_element_at(table, F.lower(bare))
        return F.when(found.isNull(), w).otherwise(F.concat(F.when(bare.rlike("^[A-Z]"), F.initcap(found)).otherwise(found), tail))

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def resolve_third_person(turns: DataFrame, women: list[str], men: list[str]) -> DataFrame:
    """turns(session_id, seq, speaker, text) with she / her and he / him / his put as the last such name before.

    The last woman or man named in an earlier turn of the session, other than the speaker; without one nothing changes.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)

    def named(names: list[str]) -> Column:
        found = F.filter(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1)), lambda w: w.isin(names) & (w != F.col("speaker")))
        return F.last(F.try_element_at(found, F.lit(-1)), ignorenulls=True).over(before)

    rows = turns.withColumns({"_she": named(women), "_he": named(men)})
    text = F.col("text")
    for name, subject, owner in (("_she", r"\b[Ss]he\b", r"\b[Hh]er\b"), ("_he", r"\b(?:[Hh]e|[Hh]im)\b", r"\b[Hh]is\b")):
        put = F.regexp_replace(F.regexp_replace(text, F.lit(owner), F.concat(F.col(name), F.lit("'s"))), F.lit(subject), F.col(name))
        text = F.when(F.col(name).isNull(), text).otherwise(put)
    return rows.withColumn("text", text).drop("_she", "_he")


def extract_entities(text: Column) -> Column:
    """array<struct(kind, name)>: people (capitalised, not at a place), dates, times and places of a text, each once."""
    from recollect.functions.questions import NO_NAMES

    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("name")))

    place = r"\b(?:in|at|to|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)\b"
    people = F.filter(found("person", r"(?<!\b(?:in|at|to) )(?<!\bfrom )\b([A-Z][a-z]+)\b"), lambda e: ~e["name"].isin(NO_NAMES) & ~e["name"].rlike(f"(?i)^(?:{_MONTH})$"))
    every = F.concat(people, found("date", rf"(?i)\b(\d{{1,2}} (?:{_MONTH}),? \d{{4}})\b"), found("time", r"(?i)\b(\d{1,2}:\d{2}(?: ?[ap]m)?)\b"), found("location", place))
    return F.array_distinct(every)


def event_type(text: Column) -> Column:
    """What a session was about, from its text: error, task_completion, discovery, decision, feedback or conversation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # Substrings of each type, the first that fits counts.
    return (
        F.when(low.rlike("error|exception|bug|crash|failed"), "error").when(low.rlike("fixed|solved|resolved|done|complete"), "task_completion").when(low.rlike("learned|discovered|found out|realized"), "discovery")
        .when(low.rlike("decided|chose|will use|going with"), "decision").when(low.rlike("feedback|suggest|recommend|think"), "feedback").otherwise("conversation")
    )


def list_lines(text: Column) -> Column:
    """Lines of a listing without bullets, numbers and comments."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.regexp_replace(F.trim(s), r"^(?:[-*•]+|\d+[.)])\s*", ""))
    return F.filter(lines, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))


def answer_clean(text: Column) -> Column:
    """The first line of an answer without lead-ins, quotes and stamps."""
    bare = F.trim(F.split_part(strip_stamp(text), F.lit("\n"), F.lit(1)))
    bare = F.regexp_replace(bare, r"(?i)^(?:the answer is|answer|based on [^,]*,|according to [^,]*,)[:\s]*", "")
    return F.regexp_replace(F.trim(bare), "^[\"']+|[\"']+$", "")


def strip_stamp(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?i){_STAMP}\s*", "")


def context_clean(text: Column) -> Column:
    """A context without clock stamps and speakers, ``(Date: x)`` as ``[x]``, blanks squeezed."""
    dated = F.regexp_replace(strip_stamp(text), r"\(Date: ([^)]*)\)", "[$1]")
    return F.trim(F.regexp_replace(F.regexp_replace(dated, r"(?m)^[A-Z][a-z]+: ", ""), r"[ \t]+", " "))


# What two texts may say differently, and a negation with what it negates.
STATES = [r"\b(is|am)\s+(single|married|divorced|engaged)\b", r"\b(live|lives|living)\s+in\s+(\w+)\b", r"\b(work|works)\s+(at|for)\s+(\w+)\b"]
LIKES, HATES = r"\b(?:like|love|enjoy)s?\s+(\w+)\b", r"\b(?:hate|dislike|avoid)s?\s+(\w+)\b"
NEGATED = [("not ", "is "), ("don't ", "do "), ("doesn't ", "does "), ("no longer ", "still ")]


def contradicts(new: Column, old: Column) -> Column:
    """Whether a text contradicts another: another state, place or job, a liking against a dislike of one thing, or a negation about one subject."""
    a, b = F.lower(F.coalesce(new, F.lit(""))), F.lower(F.coalesce(old, F.lit("")))
    out = F.lit(False)
    for p in STATES:
        out = out | (a.rlike(p) & b.rlike(p) & (F.regexp_extract(a, p, 0) != F.regexp_extract(b, p, 0)))
    for x, y in ((a, b), (b, a)):
        out = out | (x.rlike(LIKES) & y.rlike(HATES) & (F.regexp_extract(x, LIKES, 1) == F.regexp_extract(y, HATES, 1)))

    def subjects(t: Column) -> Column:
        own = F.lower(t).rlike("i |i'm|my |me ")
        return F.concat(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1)), F.when(own, F.array(F.lit("User"))).otherwise(F.array().cast("array<string>")))

    shared = F.size(F.array_intersect(subjects(new), subjects(old))) > 0
    for neg, pos in NEGATED:
        out = out | (F.contains(a, F.lit(neg)) & F.contains(b, F.lit(pos)) & shared)
    return out


# Words that tell what somebody did, does, likes, is or has.
DEEDS = ["went to", "attended", "visited", "joined", "started", "finished", "completed", "began", "ended"]
DOINGS = ["watching", "playing", "reading", "writing", "cooking", "running", "swimming", "hiking"]
TASTES = ["love", "like", "enjoy", "prefer", "hate", "dislike"]
BEINGS = ["am", "work", "live", "have", "own", "study", "teach"]
OWN = ["name", "job", "age", "hobby", "pet", "car"]
#: How many relations of each kind a turn gives at most.
CAPS = {"did": 5, "mentioned": 5, "likes": 3, "is/has": 3, "was_at": 3}
_REST = r"\s+(.+?)(?:\.|,|!|\?|$)"
DEED_PATTERNS = [rf"(?i)\b({'|'.join(words)}){_REST}" for words in (DEEDS, DOINGS)]
TASTE_PATTERNS = [rf"(?i)\bI\s+(?:{'|'.join(TASTES)}){_REST}", r"(?i)\bmy\s+favorite\s+(.+?)\s+is\s+.+?(?:\.|,|!|\?|$)"]
BEING_PATTERNS = [rf"(?i)\bI\s+(?:{'|'.join(BEINGS)}){_REST}", rf"(?i)\bmy\s+(?:{'|'.join(OWN)})\s+is{_REST}"]


def extract_relations(text: Column, speaker: Column) -> Column:
    """array<struct(subject, predicate, object)>: what the speaker of a text did, mentioned, likes, is or has, and where they were.

    Each kind is a slice of the distinct matches in their order, so a turn gives at most ``CAPS`` of it;
    objects are cut at 50 characters.  A null text or speaker gives none.
    """
    said = F.coalesce(text, F.lit(""))
    every = lambda p, group=1: F.regexp_extract_all(said, F.lit(p), F.lit(group))
    short = lambda c: F.substring(F.trim(c), 1, 50)
    deeds = F.concat(*[F.zip_with(every(p), every(p, 2), lambda a, b: F.when(F.trim(b) != "", F.concat(a, F.lit(" "), short(b)))) for p in DEED_PATTERNS])
    long = lambda patterns: F.filter(F.transform(F.concat(*[every(p) for p in patterns]), short), lambda x: F.length(x) > 2)
    known = extract_entities(said)
    named = lambda kind: F.transform(F.filter(known, lambda e: e["kind"] == kind), lambda e: e["name"])
    people = F.filter(named("person"), lambda n: F.lower(n) != F.lower(speaker))
    kinds = {"did": F.array_compact(deeds), "mentioned": people, "likes": long(TASTE_PATTERNS), "is/has": long(BEING_PATTERNS), "was_at": named("location")}

    def told(predicate: str, values: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(values), 1, CAPS[predicate]), lambda v: F.struct(speaker.alias("subject"), F.lit(predicate).alias("predicate"), v.alias("object")))

    return F.when(text.isNotNull() & speaker.isNotNull(), F.concat(*[told(p, v) for p, v in kinds.items()])).otherwise(F.array().cast("array<struct<subject: string, predicate: string, object: string>>"))


# Predicates of an entity and the words for them.
ENTITY_VERBS = {"is": r"(?:is|was)", "likes": r"(?:likes?|loves?|enjoys?)", "works": r"(?:works?|worked)\s+(?:at|for|as)", "went": r"(?:went|goes)\s+to", "has": r"(?:has|have|had)"}


#: How many entities are broadcast to the lines at most.
BROADCAST_NAMES = 200_000


def facts_about_lines(contexts: DataFrame, entities: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, entity, predicate, value): what the lines of contexts say of entities that they name, by five patterns.

    ``entities`` has (entity), single words; a line meets an entity by an equi-join on its words.  At most
    ``BROADCAST_NAMES`` entities go to the lines; more are shuffled with them, as the lines are never
    broadcast, however small their files look.  Values are cut at 50 characters.
    """
    names = entities.select("entity", F.lower("entity").alias("_w")).distinct()
    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    lines = contexts.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "content"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)(\w+)"), F.lit(1)))
    met = lines.withColumn("_w", F.explode(words)).join(F.broadcast(names) if few else names.hint("merge"), "_w")
    found = [_values(F.concat(F.lit(r"(?i)\b\Q"), "entity", F.lit(rf"\E\s+{verb}\s+(.+?)(?:\.|,|$)")), predicate) for predicate, verb in ENTITY_VERBS.items()]
    return met.select(*keys, "line", "entity", F.explode(F.concat(*found)).alias("f")).select(*keys, "line", "entity", "f.predicate", "f.value")


def _values(pattern: Column, predicate: str) -> Column:
    return F.transform(F.regexp_extract_all("content", pattern, F.lit(1)), lambda v: F.struct(F.lit(predicate).alias("predicate"), F.substring(F.trim(v), 1, 50).alias("value")))
