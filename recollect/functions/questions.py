"""What a question asks for: terms, flags, types, and simpler or further questions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.tokens import mentions_any

# Words left out of key terms.
STOP_TERMS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "and", "but", "if", "or", "because", "until", "while", "about", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "i", "me", "my", "myself", "we", "our", "ours",
    "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs",
]
# Words left out of search keywords.
STOP_KEYWORDS = ["what", "when", "where", "who", "how", "why", "which", "did", "does", "is", "are", "was", "were", "the", "a", "an", "in", "on", "at", "to", "for", "of", "and", "or", "has", "have", "had", "do", "be", "been", "being", "their", "they", "them", "his", "her", "its", "'s"]
# Capitalised words that are no names.
NO_NAMES = ["What", "When", "Where", "Who", "How", "Why", "Which", "The", "And", "But", "This", "That"]
# Words that speak of the user.
SELF = ["me", "my", "mine", "myself"]
# What makes each flag.
FLAGS = {
    "temporal": ["how long", "ago", "since", "when", "duration", "years", "months", "days", "time"],
    "person": ["who", "whom", "whose"],
    "location": ["where", "location", "place"],
    "preference": ["like", "prefer", "favorite", "enjoy"],
}
# Patterns of questions that need several steps.
MULTI_HOP = ["why", "how", "explain", "compare", "relationship between", "connection", "what do .* have in common", "both", "all", "which .* also"]
# Types of questions and their patterns, the first that fits counts.
TYPES = [
    ("when", [r"\bwhen\b", r"\bwhat time\b", r"\bwhat date\b", r"\bhow long ago\b"]),
    ("who", [r"\bwho\b", r"\bwhom\b", r"\bwhose\b"]),
    ("where", [r"\bwhere\b", r"\bwhat place\b", r"\bwhich location\b"]),
    ("what", [r"^what\b", r"\bwhat is\b", r"\bwhat are\b", r"\bwhat did\b", r"\bwhat does\b"]),
    ("how_many", [r"\bhow many\b", r"\bhow much\b", r"\bhow long\b"]),
    ("yes_no", [r"^(?:is|are|was|were|did|does|do|has|have|had|will|would|could|can)\b"]),
]
# Types of questions about time, by substring, the first that fits counts.
TIME_TYPES = [
    ("duration", ["how long", "how many years", "how many months", "how many days", "how many weeks", "for how long"]),
    ("relative_time", ["how long ago", "years ago", "months ago", "days ago", "weeks ago", "since when"]),
    ("point_in_time", ["when did", "when was", "what date", "what time", "on what day", "which year", "which month"]),
    ("ordering", ["before", "after", "first", "last", "earlier", "later", "previous", "next", "preceding", "following"]),
    ("frequency", ["how often", "how frequently", "how many times"]),
]
# Compound questions, their parts and their type.
PARTS = [
    (r"when did (.+) and (.+)", ["When did {0}?", "When did {1}?"], "temporal"),
    (r"what did (.+) do (?:before|after) (.+)", ["What did {0} do?", "When did {1} happen?"], "temporal"),
    (r"how long (?:has|had) (.+) (?:been|had) (.+)", ["When did {0} start {1}?", "What is the current state?"], "temporal"),
    (r"how did (.+) lead to (.+)", ["What is {0}?", "What is {1}?", "How are they connected?"], "multi-hop"),
    (r"why did (.+) after (.+)", ["Why did {0}?", "What happened with {1}?"], "multi-hop"),
    (r"what (?:caused|led to) (.+)", ["What is {0}?", "What events preceded it?"], "multi-hop"),
    (r"would (.+) likely (.+) if (.+)", ["What are {0}'s preferences?", "What would happen if {2}?"], "multi-hop"),
    (r"is (.+) likely to (.+)", ["What is {0}?", "What are their tendencies?"], "multi-hop"),
    (r"(?:compare|difference between) (.+) and (.+)", ["What is {0}?", "What is {1}?", "How do they differ?"], "comparison"),
    (r"both (.+) and (.+)", ["What about {0}?", "What about {1}?"], "comparison"),
]
# Words that hint at several steps, or at time.
HOP_WORDS = ["because", "therefore", "thus", "hence", "consequently", "as a result", "due to", "led to", "caused", "after", "before", "while", "during", "between", "both", "either", "neither", "compared to", "similar to", "different from", "would", "could", "should", "might", "likely", "probably"]
TIME_HINTS = ["when", "what time", "what date", "how long", "since", "before", "after", "during", "while", "until", "ago", "yesterday", "today", "tomorrow", "last", "next", "week", "month", "year", "day", "hour", "minute"]
# The first two synonyms of a word.
SYNONYMS = {"like": ["enjoy", "love"], "work": ["job", "career"], "go": ["visit", "travel"], "live": ["reside", "stay"], "friend": ["companion", "pal"], "family": ["relatives", "kin"], "hobby": ["interest", "pastime"]}

_NAME = r"\b([A-Z][a-z]+)\b"


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _matches(text: Column, pattern: str) -> Column:
    return _low(text).rlike(pattern)


def key_terms(text: Column, most: int = 10) -> Column:
    """The first words of more than two letters that are no stop words, in order."""
    words = F.filter(F.split(_low(text), r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP_TERMS))
    return F.slice(words, 1, most)


def names(text: Column) -> Column:
    """Capitalised words that are no question words, each once."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NAME), F.lit(1))), F.lit(NO_NAMES))


def search_keywords(text: Column) -> Column:
    """Words of more than two letters without stop words, and names, in lower case, each once."""
    words = F.regexp_extract_all(_low(text), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_KEYWORDS))
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_NAME), F.lit(1))
    return F.array_distinct(F.concat(kept, F.transform(every, F.lower)))


def entities(text: Column) -> Column:
    """Names in lower case, and ``user`` if the question speaks of me."""
    own = F.size(F.array_intersect(F.split(_low(text), r"\s+"), F.lit(SELF))) > 0
    return F.array_union(F.transform(names(text), F.lower), F.when(own, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>")))


def flags(text: Column) -> dict[str, Column]:
    """Whether a question is about time, a person, a place, a preference, or needs several steps."""
    out = {f"is_{k}": mentions_any(text, v) for k, v in FLAGS.items()}
    return out | {"is_multi_hop": _matches(text, "|".join(MULTI_HOP))}


def question_type(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit("what"))
    for name, patterns in TYPES:
        out = out.when(_matches(text, "|".join(patterns)), F.lit(name))
    return out.otherwise("what")


def temporal_type(text: Column) -> Column:
    out = F.when(F.lit(False), F.lit("other"))
    for name, words in TIME_TYPES:
        out = out.when(mentions_any(text, words), F.lit(name))
    return out.otherwise("other")


def _filled(template: str, text: Column, pattern: str) -> Column:
    pieces = re.split(r"\{(\d)\}", template)
    return F.concat(*[F.regexp_extract(text, pattern, int(p) + 1) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def decompose(text: Column) -> Column:
    """struct(kind, reasoning, parts): simpler questions of a compound one, else the question itself."""
    low, whole = _low(text), F.array(text)
    halves = F.split(text, " and ")

    def made(kind, reasoning, parts) -> Column:
        return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (F.lit(reasoning) if isinstance(reasoning, bool) else reasoning).alias("reasoning"), parts.alias("parts"))

    out = F.when(text.isNull(), made("simple", False, F.array().cast("array<string>")))
    for pattern, templates, kind in PARTS:
        out = out.when(low.rlike(pattern), made(kind, True, F.array(*[_filled(t, low, pattern) for t in templates])))
    two = F.contains(low, F.lit(" and ")) & (F.length(text) > 30) & (F.size(halves) == 2) & F.forall(halves, lambda p: F.length(F.trim(p)) > 10)
    out = out.when(two, made("multi-hop", True, F.transform(halves, lambda p: F.when(F.endswith(F.trim(p), F.lit("?")), F.trim(p)).otherwise(F.concat(F.trim(p), F.lit("?"))))))
    hops, timed = mentions_any(text, HOP_WORDS), mentions_any(text, TIME_HINTS)
    out = out.when(hops | timed, made(F.when(timed, "temporal").otherwise("multi-hop"), hops, whole))
    return out.otherwise(made("simple", False, whole))


def decompose_long(text: Column, threshold: int = 15, most: int = 4) -> Column:
    """Parts of a question of over ``threshold`` words: its halves at "and", and what each "X of Y" is."""
    nested = F.regexp_extract_all(text, F.lit(r"(?i)(?:the\s+)?\w+\s+(?:of|from|at|in)\s+(?:the\s+)?(.+?)(?:\s+(?:that|who|which)|$)"), F.lit(1))
    halves = F.when(F.contains(_low(text), F.lit(" and ")), F.filter(F.transform(F.split(text, r"(?i)\s+and\s+"), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    parts = F.concat(halves, F.transform(nested, lambda y: F.concat(F.lit("What is "), y, F.lit("?"))))
    long = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) > threshold
    return F.when(long & (F.size(parts) > 0), F.slice(parts, 1, most)).otherwise(F.array(text))


def follow_ups(text: Column, most: int = 3) -> Column:
    """Further questions by name, time, event and preference."""
    name = F.regexp_extract(text, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1)
    asked = [
        F.when(name != "", F.concat(F.lit("What do we know about "), name, F.lit("?"))), F.when(name != "", F.concat(F.lit("What has "), name, F.lit(" done recently?"))),
        F.when(mentions_any(text, ["when", "time", "date"]), F.lit("What dates or times are mentioned?")), F.when(mentions_any(text, ["did", "went", "attended", "visited"]), F.lit("What events or activities occurred?")),
        F.when(mentions_any(text, ["like", "prefer", "favorite", "enjoy"]), F.lit("What preferences have been mentioned?")),
    ]
    return F.slice(F.array_compact(F.array(*asked)), 1, most)


def expand(text: Column, most: int = 3) -> Column:
    """The question, then ``most`` other wordings: with synonyms, and about its names."""
    low = _low(text)
    other = []
    for word, synonyms in SYNONYMS.items():
        for s in synonyms:
            changed = F.regexp_replace(low, rf"\b{word}\b", s)
            other.append(F.when(F.contains(low, F.lit(word)) & (changed != low), changed))
    every = F.slice(F.regexp_extract_all(text, F.lit(_NAME), F.lit(1)), 1, 2)
    about = F.flatten(F.transform(every, lambda n: F.array(F.concat(F.lit("What about "), n, F.lit("?")), F.concat(F.lit("Tell me about "), n))))
    return F.concat(F.array(text), F.slice(F.concat(F.array_compact(F.array(*other)), about), 1, most))


# Compound questions about evidence and their steps; {0} is capitalised.
STEPS = [
    (r"what (?:is|are) ([a-z]+)'s ([a-z]+) (?:that|who|which) (.+)", ["Who {2}?", "What is {0}'s {1}?"]),
    (r"would ([a-z]+) (.+) (?:because|since|given) (.+)", ["What do we know about {0}?", "Does {2} apply to {0}?", "Would {0} {1}?"]),
    (r"what (?:personality|traits?|characteristics?) .+ ([a-z]+) .+ based on (.+)", ["What do we know about {0}?", "What {1}?", "What traits does this suggest?"]),
    (r"(?:is|would|could) ([a-z]+) (?:be )?(?:considered )?(?:a |an )?([a-z]+).+(?:given|since|because) (.+)", ["What do we know about {0}?", "What is {2}?", "Is {0} a {1}?"]),
]
# Hypothetical answers by type of question.
HYPOTHETICAL = {
    "when": ["The event happened on {date}.", "This occurred in {year}.", "{person} did this on {date}."],
    "who": ["{person} is the person who did this.", "The answer is {person}.", "{person} was responsible for this."],
    "where": ["This happened in {location}.", "The location was {location}.", "{person} went to {location}."],
    "what": ["{person} {action}.", "The answer is {thing}.", "{person} has {thing}."],
    "how_long": ["It has been {duration}.", "This lasted for {duration}.", "The duration was {duration}."],
    "yes_no": ["Yes, this is true because {reason}.", "No, this is not the case because {reason}."],
}


def evidence_steps(text: Column, most: int = 3) -> Column:
    """Sub-questions of a compound question, else what is known about each of its names, then the question itself."""
    low = _low(text)
    out = F.when(F.lit(False), F.array(text))
    for pattern, templates in STEPS:
        filled = []
        for t in templates:
            pieces = re.split(r"\{(\d)\}", t)
            filled.append(F.concat(*[(F.initcap(F.regexp_extract(low, pattern, 1)) if p == "0" else F.regexp_extract(low, pattern, int(p) + 1)) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]))
        out = out.when(low.rlike(pattern), F.array(*filled))
    known = F.transform(F.slice(names(text), 1, most), lambda n: F.concat(F.lit("What do we know about "), n, F.lit("?")))
    return out.otherwise(F.concat(known, F.array(text)))


def hypothetical_type(text: Column) -> Column:
    low = _low(text)
    return (
        F.when(mentions_any(text, ["how long", "how many years", "how many months"]), "how_long").when(low.rlike("^when|what time|what date"), "when").when(low.rlike("^who|whom"), "who")
        .when(low.rlike("^where|what place"), "where").when(low.rlike("^(?:is|are|was|were|did|does|do|would|could) "), "yes_no").otherwise("what")
    )


def hypothetical_answers(text: Column) -> Column:
    """Made-up answers of the question's type, with its first name for the person; other gaps stay marked."""
    kind, who = hypothetical_type(text), F.coalesce(F.try_element_at(names(text), F.lit(1)), F.lit("{person}"))
    table = F.create_map(*[x for k, v in HYPOTHETICAL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.transform(F.try_element_at(table, kind), lambda t: F.replace(t, F.lit("{person}"), who))
