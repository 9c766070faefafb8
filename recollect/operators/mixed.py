"""One list of results of several kinds: triplets, remembered turns and paths through the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import tokens
from recollect.operators import answers, graph, retrieval
from recollect.operators.hybrid import KEYS, bare_words, has_any, word_runs
from recollect.operators.shared import cut, spread
from recollect.operators.sparse import classed_top, relevance_keys

# Two synonyms of a word, and other forms of a question.
SYNONYMS = {"like": ["enjoy", "prefer"], "live": ["reside", "stay"], "work": ["job", "employed"], "friend": ["buddy", "pal"]}
STARTS = {"what": ["which"], "where": ["what location"]}
INSIDE = {"how long": ["duration", "time period"]}
# Patterns of questions that need several steps.
SEVERAL_STEPS = ["why", "how", "explain", "compare", "relationship between", "connection", "what do .* have in common", "both", "all", "which .* also"]
# How questions about time begin, and what they hold.
TIME_STARTS = ["when", "how long", "what time", "what date", "what year"]
TIME_INSIDE = ["duration", "period", "since when", "until when"]
# Words that date a text.
TIME_WORDS = """yesterday today tomorrow ago since until during january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday morning afternoon evening night year month week day""".split() + ["last week", "last month", "last year"]
#: Order of the kinds among equal scores.
KINDS = ["graph", "tier", "path"]


def wordings(q: Column, most: int = 3) -> Column:
    """The question, then up to ``most`` others with synonyms or in another form, in lower case."""
    low = F.lower(F.coalesce(q, F.lit("")))
    swap = lambda old, new, when: F.when(when, F.replace(low, F.lit(old), F.lit(new)))
    other = [swap(w, s, F.contains(low, F.lit(w))) for w, ss in SYNONYMS.items() for s in ss]
    other += [swap(w, s, F.startswith(low, F.lit(w))) for w, ss in STARTS.items() for s in ss]
    other += [swap(w, s, F.contains(low, F.lit(w))) for w, ss in INSIDE.items() for s in ss]
    return F.concat(F.array(F.coalesce(q, F.lit(""))), F.slice(F.array_compact(F.array(*other)), 1, most))


def needs_steps(q: Column) -> Column:
    return F.coalesce(F.lower(q).rlike("|".join(SEVERAL_STEPS)), F.lit(False))


def about_time(q: Column) -> Column:
    low = F.lower(F.coalesce(q, F.lit("")))
    return low.rlike("^(?:" + "|".join(TIME_STARTS) + ")") | has_any(q, TIME_INSIDE)


def is_dated(text: Column) -> Column:
    return has_any(text, TIME_WORDS) | F.coalesce(text, F.lit("")).rlike(r"\d{4}")


def search_triplets(asked: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, fact_id, score, rank): overlap / (n + 1), + .3 if the question names the subject, + .2 the object.

    Names are looked for as runs of up to four whole words, punctuation aside.
    """
    q = F.col("q")
    words = F.transform(relevance_keys(tokens(q)), lambda e: F.struct(F.concat(F.lit("w:"), e["key"]).alias("key"), e["weight"].alias("weight")))
    rows = spread(facts.where("is_current"), "fact_id")
    ends = rows.select(F.explode(F.array(F.concat(F.lit("s:"), bare_words(rows["subject"])), F.concat(F.lit("o:"), bare_words(rows["object"])))).alias("key")).distinct()
    runs = F.concat(_prefixed("s:", word_runs(q), 0.3), _prefixed("o:", word_runs(q), 0.2))
    # most runs of words name nothing
    named = asked.select("query_id", F.explode(runs).alias("e")).select("query_id", "e.key", "e.weight").join(ends, "key").groupBy("query_id").agg(F.collect_list(F.struct("key", "weight")).alias("_named"))
    keyed = asked.select("query_id", words.alias("_words")).join(named, "query_id", "left").select("query_id", F.concat(F.col("_words").cast(KEYS), F.coalesce(F.col("_named").cast(KEYS), F.array().cast(KEYS))).alias("keys"))
    held = F.concat(_prefixed("w:", tokens(retrieval.statement(rows)), 1.0), _prefixed("s:", F.array(bare_words(rows["subject"])), 1.0), _prefixed("o:", F.array(bare_words(rows["object"])), 1.0))
    return classed_top(keyed, rows.select(F.col("fact_id").alias("memory_id"), held.cast(KEYS).alias("keys")), k).withColumnRenamed("memory_id", "fact_id")


def _prefixed(kind: str, values: Column, weight: float) -> Column:
    return F.transform(values, lambda v: F.struct(F.concat(F.lit(kind), v).alias("key"), F.lit(weight).alias("weight")))


def retrieve(asked: DataFrame, facts: DataFrame, tiers: dict[str, DataFrame], edges: DataFrame, seeds: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, kind, source, source_id, content, score, rank): the best ``k`` results of a question, of whatever kind.

    ``graph``: facts by their words; ``tier``: items of a tier; both for every wording of the
    question, a result keeping the score of the first wording that finds it.  ``path``: chains of
    edges, for questions that need several steps.  Then all gain .3 of their share of the question's words,
    paths .1, facts .05, dated results of questions about time .5.  Of results that begin alike (50
    characters) the best stays.  All candidates of a question are bounded (8 k + 5) before their texts are joined.
    """
    worded = asked.select("query_id", F.posexplode(wordings(F.col("q"))).alias("seq", "q")).select(F.struct("query_id", "seq").alias("query_id"), "q")
    worded = cut(worded)
    first = F.min_by("score", "query_id.seq").alias("score")
    said = facts.select("fact_id", retrieval.statement(facts).alias("content"))
    triplets = search_triplets(worded, facts, 2 * k).groupBy("query_id.query_id", "fact_id").agg(first).join(said, "fact_id")
    triplets = triplets.select("query_id", F.lit("graph").alias("kind"), F.lit("graph").alias("source"), F.col("fact_id").cast("string").alias("source_id"), "content", "score")
    found = answers.search_tiers(worded.withColumnRenamed("q", "text"), tiers, 2 * k, 2 * k)
    found = found.groupBy("query_id.query_id", "memory_id", "tier").agg(first)
    texts = None
    for items in tiers.values():
        some = items.select("memory_id", F.col("text").alias("content"))
        texts = some if texts is None else texts.unionByName(some)
    turns = found.join(texts, "memory_id").select("query_id", F.lit("tier").alias("kind"), F.concat(F.lit("tiered_"), "tier").alias("source"), F.col("memory_id").cast("string").alias("source_id"), "content", "score")
    deep = asked.where(needs_steps(F.col("q")))
    paths = graph.beam(edges, deep, seeds.join(deep.select("query_id"), "query_id", "left_semi"))
    steps = paths.select("query_id", "path", "score", F.posexplode("path").alias("at", "fact_id")).join(said, "fact_id")
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), " -> ")
    chains = steps.groupBy("query_id", "path", "score").agg(told.alias("content"))
    chains = chains.select("query_id", F.lit("path").alias("kind"), F.lit("coe_path").alias("source"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("source_id"), "content", "score")
    rows = triplets.unionByName(turns).unionByName(chains).join(asked.select("query_id", "q"), "query_id")
    words = tokens(F.col("q"))
    bonus = (
        F.size(F.array_intersect(words, tokens(F.col("content")))) / (F.size(words) + 1) * 0.3 + F.when(F.col("kind") == "path", 0.1).when(F.col("kind") == "graph", 0.05).otherwise(0.0)
        + F.when(about_time(F.col("q")) & is_dated(F.col("content")), 0.5).otherwise(0.0)
    )
    rows = rows.withColumn("score", F.round(F.col("score") + bonus, 6)).withColumns({"_kind": F.array_position(F.lit(KINDS), F.col("kind")), "_alike": F.substring(F.lower("content"), 1, 50)})
    order = [F.desc("score"), F.asc("_kind"), F.asc("source_id")]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_alike").orderBy(*order))).where("_r = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return rows.select("query_id", "kind", "source", "source_id", "content", "score", "rank")


# Headings of a context, in their order, and how many results each has.
PARTS = {"graph": ("FACTS:", 10), "path": ("\nREASONING PATHS:", 3), "tier": ("\nMEMORIES:", 10)}


def build_context(found: DataFrame, limit: int = 8000, edges: int = 3) -> DataFrame:
    """(query_id, context): results of ``retrieve`` as text: facts, paths (their first ``edges`` steps), remembered turns, each one line.

    A line goes in while all lines together stay under ``limit`` characters; one that
    does not fit is left out and the next one tried.  Headings stand over every kind that was found.
    """
    caps = F.lit(0)
    order = F.lit(len(PARTS))
    for i, (kind, (_, most)) in enumerate(PARTS.items()):
        caps, order = F.when(F.col("kind") == kind, most).otherwise(caps), F.when(F.col("kind") == kind, i).otherwise(order)
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank"))
    rows = found.withColumns({"_o": order, "_n": place}).where(F.col("_n") <= caps)
    shown = F.when(F.col("kind") == "path", F.array_join(F.slice(F.split("content", " -> "), 1, edges), " -> ")).otherwise(F.col("content"))
    # lines and headings both come from these rows, which are searched for once
    rows = cut(rows.select("query_id", F.struct("_o", "_n", F.lit(False).alias("head"), F.concat(F.lit("- "), shown).alias("line")).alias("l"), "kind"))
    title = F.element_at(F.create_map(*[F.lit(x) for k, (t, _) in PARTS.items() for x in (k, t)]), F.col("kind"))
    heads = rows.select("query_id", "kind", "l._o").distinct().select("query_id", F.struct("_o", F.lit(0).alias("_n"), F.lit(True).alias("head"), title.alias("line")).alias("l"))
    lines = rows.select("query_id", "l").unionByName(heads).groupBy("query_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))

    def add(have: Column, x: Column) -> Column:
        size = F.length(x["line"])
        grown = F.struct((have["used"] + size).alias("used"), F.array_append(have["out"], x["line"]).alias("out"))
        return F.when(x["head"], F.struct(have["used"].alias("used"), F.array_append(have["out"], x["line"]).alias("out"))).when(have["used"] + size < limit, grown).otherwise(have)

    return lines.select("query_id", F.aggregate("ls", start, add, lambda have: F.array_join(have["out"], "\n")).alias("context"))
