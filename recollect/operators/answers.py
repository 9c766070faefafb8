"""Searches over turns by tier, and answers put together from what searches found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import questions, scores
from recollect.functions.tokens import tokens
from recollect.operators.ranking import top
from recollect.operators.shared import cut, spread
from recollect.operators.sparse import lexical_top, relevance_keys, sparse_top, weighed


def search_items(asked: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, memory_id, score, rank): items that share a word with a question, by activation, importance, relevance and rehearsals.

    ``asked`` has (query_id, text), ``items`` (memory_id, text, activation, importance, rehearsals); filter them before.
    """
    known = scores.item_score(F.col("activation"), F.col("importance"), F.lit(0.0), F.col("rehearsals"))
    items = spread(items.select("memory_id", "text", "activation", "importance", "rehearsals"), "memory_id")
    held = items.select("memory_id", weighed(tokens(F.col("text"))).alias("keys"), known.alias("base"))
    return sparse_top(asked.select("query_id", relevance_keys(tokens(F.col("text")), 0.3).alias("keys")), held, k, digits=6)


def search_tiers(asked: DataFrame, tiers: dict[str, DataFrame], each: int = 5, overall: int = 10) -> DataFrame:
    """The best ``each`` of every tier, then the best ``overall``: (query_id, memory_id, tier, score, rank)."""
    found = None
    for name, items in tiers.items():
        rows = search_items(asked, items, each).drop("rank").withColumn("tier", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return top(found, "score", overall).select("query_id", "memory_id", "tier", "score", "rank")


#: What each level of a unit adds to its score.
LEVELS = {"utterance": 0.0, "turn": 0.1, "session": 0.15, "topic": 0.2}


def unit_candidates(asked: DataFrame, units: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, memory_id, level, score, rank): overlap / (n + 1) + the level's boost + .2 mean feedback.

    ``units`` has (memory_id, level, text, feedback).
    """
    boost = F.lit(0.0)
    for level, by in LEVELS.items():
        boost = F.when(F.col("level") == level, F.lit(by)).otherwise(boost)
    held = units.select("memory_id", weighed(tokens(F.col("text"))).alias("keys"), (boost + 0.2 * F.coalesce("feedback", F.lit(0.0))).alias("base"))
    found = sparse_top(asked.select("query_id", relevance_keys(tokens(F.col("text"))).alias("keys")), held, k, digits=6)
    return found.join(units.select("memory_id", "level"), "memory_id").select("query_id", "memory_id", "level", "score", "rank")


def best_line(asked: DataFrame, texts: DataFrame, most: int = 80) -> DataFrame:
    """(query_id, line): of all lines of all texts (memory_id, text) the one that shares most words with the question, cut.

    Of equals the first by text and place; a question without any has "Not mentioned".
    """
    lines = texts.select("memory_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    # one text that orders lines by memory and place; only the best line of a question is looked up again
    shift = F.lit(str(2**63)).cast("decimal(20,0)")
    name = F.concat(F.lpad((F.col("memory_id").cast("decimal(20,0)") + shift).cast("string"), 20, "0"), F.lpad(F.col("place").cast("string"), 10, "0"))
    best = lexical_top(asked.select("query_id", tokens(F.col("text")).alias("words")), lines.select(name.alias("memory_id"), tokens(F.col("line")).alias("words")), 1)
    found = best.select("query_id", (F.substring("memory_id", 1, 20).cast("decimal(20,0)") - shift).cast("long").alias("memory_id"), F.substring("memory_id", 21, 10).cast("int").alias("place"))
    first = cut(found).join(texts, "memory_id").select("query_id", F.substring(F.get(F.split("text", "\n"), F.col("place")), 1, most).alias("line"))
    return asked.select("query_id").join(first, "query_id", "left").select("query_id", F.coalesce("line", F.lit("Not mentioned")).alias("line"))


def answer_from_facts(asked: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """(query_id, answer): the objects of all preferences found if the question asks for them, else the first fact's object."""
    rows = found.join(facts.select("fact_id", "object", F.col("fact_type").alias("kind")), "fact_id")
    liked = F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "preference", F.col("object")))), ", ")
    both = rows.groupBy("query_id").agg(liked.alias("liked"), F.min_by("object", "rank").alias("first"))
    asks = questions.flags(F.col("q"))["is_preference"]
    return asked.join(both, "query_id").select("query_id", F.when(asks & (F.col("liked") != ""), F.col("liked")).otherwise(F.col("first")).alias("answer"))


def answer_duration(asked: DataFrame, states: DataFrame) -> DataFrame:
    """(query_id, answer) for questions about time: the span of the named subject's state with most shared words.

    ``states`` has (fact_id, subject, description, days); "ago" is added if the question has it.
    """
    named = asked.where(questions.flags(F.col("q"))["is_temporal"]).select("query_id", "q", F.lower(F.try_element_at(questions.names(F.col("q")), F.lit(1))).alias("who"))
    rows = states.withColumn("who", F.lower("subject")).join(named, "who")
    shared = F.size(F.array_intersect(tokens(F.col("q")), tokens(F.col("description"))))
    best = rows.withColumn("n", shared).groupBy("query_id", "q").agg(F.max_by("days", F.struct("n", -F.col("fact_id"))).alias("days"))
    text = scores.format_duration(F.col("days"))
    return best.select("query_id", F.when(F.contains(F.lower("q"), F.lit("ago")), F.concat(text, F.lit(" ago"))).otherwise(text).alias("answer"))


def pair_scores(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) in either order with the score of ``known`` (a, b, score) in either order, or null."""
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_low": F.least("a", "b"), "_high": F.greatest("a", "b")})

    score = keyed(known).groupBy("_low", "_high").agg(F.max("score").alias("score"))
    return keyed(pairs).join(score, ["_low", "_high"], "left").drop("_low", "_high")


def entity_memories(rows: DataFrame, names: Column, each: int = 3) -> DataFrame:
    """(entity, memory_id): the first ``each`` memories of every name in lower case."""
    said = rows.select("memory_id", F.explode(F.array_distinct(F.transform(names, F.lower))).alias("entity"))
    line = Window.partitionBy("entity").orderBy("memory_id")
    return said.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= each).select("entity", "memory_id")


def speaker_boost(found: DataFrame, asked: DataFrame, by: float = 0.2) -> DataFrame:
    """``score`` + ``by`` for rows whose speaker (``speaker``) the question (query_id, text) names."""
    said = asked.select("query_id", F.explode(tokens(F.col("text"))).alias("_word")).distinct()
    hits = found.join(said, (found["query_id"] == said["query_id"]) & (F.lower(found["speaker"]) == said["_word"]), "left").drop(said["query_id"])
    return hits.withColumn("score", F.col("score") + F.when(F.col("_word").isNotNull(), by).otherwise(0.0)).drop("_word")


def conversation_context(turns: DataFrame, history: int = 5, relevant: int = 5) -> DataFrame:
    """(session_id, context): a session's last turns, then the earlier ones that share most words with its last turn."""
    line = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    placed = turns.withColumn("_back", F.row_number().over(line))
    last = placed.where("_back = 1").select("session_id", tokens(F.col("text")).alias("_last"))
    early = placed.where(F.col("_back") > history).join(last, "session_id").withColumn("_n", F.size(F.array_intersect(tokens(F.col("text")), "_last"))).where("_n > 0")
    best = early.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("_n"), "seq"))).where(F.col("_r") <= relevant)
    kept = placed.where(F.col("_back") <= history).select("session_id", F.lit(0).alias("part"), "seq", "text").unionByName(best.select("session_id", F.lit(1).alias("part"), F.col("_r").cast("long").alias("seq"), "text"))
    lines = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", "text"))).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: F.concat(F.when(x["part"] == 0, "- ").otherwise("* "), x["text"])), "\n").alias("context"))


def extract_answer(question: Column, context: Column) -> Column:
    """struct(kind, answer): by the question's type a date or span, a name, a place, a quantity, yes or no, else the first line."""
    kind = questions.question_type(question)

    def first(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(context, p, 1), F.lit("")) for p in patterns])

    when = first(r"(\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})", r"\b(\d{4})\b", r"(\d+ (?:years?|months?|weeks?|days?) ago)")
    who = F.try_element_at(questions.names(context), F.lit(1))
    where = first(r"\b(?:in|at|to|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)")
    many = first(r"(\d+) (?:years?|months?|weeks?|days?|hours?)", r"(\d+) (?:times?|people|items?|things?)")
    votes = scores.speaks_for(context)
    yes = F.when(votes > 0, "Yes").when(votes < 0, "No")
    line = F.split_part(context, F.lit("\n"), F.lit(1))
    answer = F.when(kind == "when", when).when(kind == "who", who).when(kind == "where", where).when(kind == "how_many", many).when(kind == "yes_no", yes).otherwise(line)
    return F.struct(kind.alias("kind"), answer.alias("answer"))
