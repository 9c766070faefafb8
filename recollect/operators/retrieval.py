"""Searches over facts and memories, and what is made of their results.

Facts have (fact_id, subject, predicate, object, fact_type, is_current), questions
(query_id, q).  Every search joins on a word, an entity or a class of equal facts and keeps
the best ``k`` rows of a question; ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import questions, scores
from recollect.functions.tokens import tokens
from recollect.operators.ranking import top
from recollect.operators.shared import cut, spread

# Words left out when facts are searched.
STOP_WORDS = ["what", "when", "where", "who", "how", "why", "which", "does", "did", "the", "a", "an", "is", "are", "was", "were", "has", "have", "had", "do", "for", "to", "in", "on", "at"]
SIGNALS = ["keyword", "entity", "graph", "temporal"]


def best(rows: DataFrame, k: int, key: str = "fact_id", score: str = "score") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 6)), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def statement(facts: DataFrame) -> Column:
    return F.concat_ws(" ", facts["subject"], facts["predicate"], facts["object"])


#: A word or name of at most so many facts is looked up fact by fact; of those that share only more frequent ones, a class of equals is met by its first facts.
RARE = 1000


def _inside(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part) of all ``parts`` (part) that a text (text) holds anywhere, by an equi-join on the pieces of the parts' lengths."""
    lengths = parts.agg(F.array_sort(F.collect_set(F.length("part"))).alias("_sizes"))
    cuts = F.flatten(F.transform("_sizes", lambda n: F.when(n <= F.length("text"), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substring("text", i, n))).otherwise(F.array().cast("array<string>"))))
    pieces = spread(texts.distinct(), "text").crossJoin(F.broadcast(lengths)).select("text", F.explode(F.array_distinct(cuts)).alias("part"))
    return pieces.where("part <> ''").join(parts.where("part <> ''").distinct(), "part")


def _frequent(features: DataFrame) -> DataFrame:
    """``features`` (fact_id, key) with ``rare``: whether at most ``RARE`` facts have the key."""
    counts = features.groupBy("key").agg((F.count(F.lit(1)) <= RARE).alias("rare"))
    return features.join(counts, "key")


def _matched(asked: DataFrame, words: Column, facts: DataFrame, k: int, score: Column, objects: bool = False) -> DataFrame:
    """(query_id, q, words, n, fact columns, overlap): of the facts that share a word with a question all that can be among its ``k`` best by ``score``.

    ``score`` is made of the columns above, ``low`` (the question), ``has_subject`` and ``has_object``: whether the question holds
    the subject, and with ``objects`` whether the object holds one of the words; it must not fall with the overlap nor with these.

    A fact that shares a rare word, or its subject, with the question is met by an equi-join.  All others of one
    predicate with the same frequent words have one score, so the first ``k`` of such a class are enough, and of
    classes the ``k`` best; a question meets classes, not facts.  The best are those of all pairs, exactly.
    """
    some = cut(asked.select("query_id", "q", F.lower("q").alias("low"), words.alias("words")).withColumn("n", F.size("words")))
    facts = cut(facts)
    held = facts.select("fact_id", F.explode(tokens(statement(facts))).alias("key")).join(some.select(F.explode("words").alias("key")).distinct(), "key", "left_semi")
    wanted = some.select("query_id", F.explode("words").alias("part"))
    features = held.withColumn("kind", F.lit("w"))
    if objects:
        inside = _inside(facts.select(F.lower("object").alias("text")), wanted.select("part"))
        features = features.unionByName(facts.select("fact_id", F.lower("object").alias("text")).join(inside, "text").select("fact_id", F.col("part").alias("key"), F.lit("o").alias("kind")))
    features = cut(_frequent(features.select("fact_id", F.struct("kind", F.col("key").alias("part")).alias("key"))))
    rare = features.where("rare").select("fact_id", "key.part").join(wanted, "part").select("query_id", "fact_id")
    # classes of facts: predicate, frequent words, and whether they are the user's own
    marks = features.where("not rare").groupBy("fact_id").agg(F.array_sort(F.collect_list("key")).alias("marks"))
    mark = lambda kind: F.transform(F.filter("marks", lambda m: m["kind"] == kind), lambda m: m["part"])
    classed = facts.join(marks, "fact_id").select("fact_id", F.lower("subject").alias("subject"), "predicate", (F.lower("subject") == "user").alias("own"), mark("w").alias("common"), mark("o").alias("inside"))
    group = ["predicate", "own", "common", "inside"]
    of_class, of_subject = Window.partitionBy(*group).orderBy("fact_id"), Window.partitionBy("subject", *group).orderBy("fact_id")
    heads = cut(classed.withColumn("nth", F.row_number().over(of_class)).where(F.col("nth") <= k).withColumn("class", F.xxhash64(*group)))
    classes = heads.groupBy("class", *group).agg(F.min("fact_id").alias("first"))
    asks = some.select("query_id", "q", "low", "words", "n")
    met = classes.withColumn("part", F.explode("common")).join(wanted, "part").groupBy("query_id", "class", *group, "first").agg(F.count(F.lit(1)).alias("overlap")).join(asks, "query_id")
    met = met.withColumns({"subject": F.when(F.col("own"), "user").otherwise(""), "has_subject": F.lit(False), "has_object": F.arrays_overlap("words", "inside")}).withColumn("score", score)
    near = best(met, k, "first").select("query_id", "class").join(heads.select("class", "fact_id"), "class").select("query_id", "fact_id")
    # a question that names a subject, anywhere in its letters
    named = _inside(some.select(F.col("low").alias("text")), facts.select(F.lower("subject").alias("part")))
    first = facts.select("fact_id", F.lower("subject").alias("subject")).join(classed.withColumn("nth", F.row_number().over(of_subject)).where(F.col("nth") <= k).select("fact_id"), "fact_id")
    about = some.select("query_id", F.col("low").alias("text")).join(named, "text").join(first, F.col("part") == F.col("subject")).select("query_id", "fact_id")
    pairs = cut(rare.unionByName(near).unionByName(about).distinct())
    rows = pairs.join(some, "query_id").join(facts, "fact_id").withColumn("overlap", F.size(F.array_intersect("words", tokens(F.concat_ws(" ", "subject", "predicate", "object"))))).where("overlap > 0")
    return rows.withColumns({"has_subject": F.contains("low", F.lower("subject")), "has_object": F.exists("words", lambda w: F.contains(F.lower("object"), w))}).withColumn("score", score)


def search_facts(asked: DataFrame, facts: DataFrame, k: int = 20) -> DataFrame:
    """overlap / (n + 1), + .3 if the question names the subject, + .2 if it has the predicate."""
    score = F.col("overlap") / (F.col("n") + 1) + F.when(F.col("has_subject"), 0.3).otherwise(0.0) + F.when(F.contains("low", F.lower("predicate")), 0.2).otherwise(0.0)
    return best(_matched(asked, tokens(F.col("q")), facts.where("is_current"), k, score), k).select("query_id", "fact_id", "score", "rank")


def search_keyword(asked: DataFrame, facts: DataFrame, k: int = 40) -> DataFrame:
    """Share of the question's words, + .4 for its subject, + .2 for a word in its object, + .5 for the user's own facts."""
    own = F.size(F.array_intersect(tokens(F.col("q")), F.lit(questions.SELF))) > 0
    words = F.array_union(F.array_except(tokens(F.col("q")), F.lit(STOP_WORDS)), F.when(own, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>")))
    user = (F.lower("subject") == "user") & (F.size(F.array_intersect(tokens(F.col("q")), F.lit(["me", "my"]))) > 0)
    bonus = F.when(F.col("has_subject"), 0.4).otherwise(0.0) + F.when(F.col("has_object"), 0.2).otherwise(0.0) + F.when(user, 0.5).otherwise(0.0)
    rows = _matched(asked, words, facts.where("is_current"), k, F.col("overlap") / F.col("n") + bonus, objects=True)
    return best(rows, k).select("query_id", "fact_id", "score", "rank")


def _entities(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.explode(questions.entities(F.col("q"))).alias("entity"))


def _sides(facts: DataFrame) -> DataFrame:
    """(entity, other, fact_id): both ends of every fact, in lower case."""
    ends = F.array(F.struct(F.lower("subject").alias("entity"), F.lower("object").alias("other")), F.struct(F.lower("object").alias("entity"), F.lower("subject").alias("other")))
    return facts.select("fact_id", F.explode(ends).alias("e")).select("fact_id", "e.*").distinct()


def search_entity(asked: DataFrame, facts: DataFrame, k: int = 40) -> DataFrame:
    """.3 + .2 for each end of the fact that the question names.

    Facts with one end named all have one score, so of each entity, and of each two, only the first ``k`` facts can count.
    """
    named = cut(_entities(asked))
    sides = cut(_sides(facts.where("is_current")).join(named.select("entity").distinct(), "entity", "left_semi"))
    by = lambda *keys: sides.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("fact_id", "other"))).where(F.col("_r") <= k)
    # both sides of a fact with one entity at both ends are one row
    one = by("entity").join(named, "entity").select("query_id", "fact_id")
    # the two ends that a question names meet first: a hub has as many others as facts
    both = named.join(named.select("query_id", F.col("entity").alias("other")), "query_id")
    two = by("entity", "other").join(both, ["entity", "other"]).select("query_id", "fact_id")
    ends = facts.select("fact_id", F.array_distinct(F.array(F.lower("subject"), F.lower("object"))).alias("_ends"))
    known = named.groupBy("query_id").agg(F.collect_set("entity").alias("_named"))
    rows = one.unionByName(two).distinct().join(known, "query_id").join(ends, "fact_id")
    return best(rows.withColumn("score", 0.3 + 0.2 * F.size(F.array_intersect("_ends", "_named"))), k).select("query_id", "fact_id", "score", "rank")


def near_facts(entities: DataFrame, facts: DataFrame, each: int, most: int) -> DataFrame:
    """(named, entity, fact_id): the current facts about the neighbours (entity) of every one of ``entities`` (entity), the first ``each`` a neighbour and the first ``most`` rows by fact in all."""
    first = Window.partitionBy("entity").orderBy("fact_id")
    about = _sides(facts.where("is_current")).select("entity", "fact_id").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= each).drop("_r")
    beside = _sides(facts).join(entities.select("entity").distinct(), "entity").select(F.col("entity").alias("named"), F.col("other").alias("entity")).where("entity <> named").distinct()
    rows = beside.join(about, "entity")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("named").orderBy("fact_id", "entity"))).where(F.col("_r") <= most).select("named", "entity", "fact_id")


def search_graph(asked: DataFrame, facts: DataFrame, k: int = 20) -> DataFrame:
    """.25 for facts about the neighbours of a question's entities, on either side, that the question does not name itself.

    All have one score, so of each neighbour only its first ``k`` facts can count, and of all neighbours of an entity
    only the first facts: each is there for its two sides at most, and ``k`` a neighbour that the question names.
    """
    named = cut(_entities(asked))
    most = named.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    rows = near_facts(named, facts, k, (2 + most) * k).join(named.withColumnRenamed("entity", "named"), "named")
    rows = rows.join(named, ["query_id", "entity"], "left_anti").select("query_id", "fact_id").distinct().withColumn("score", F.lit(0.25))
    return best(rows, k).select("query_id", "fact_id", "score", "rank")


def search_states(asked: DataFrame, states: DataFrame) -> DataFrame:
    """States (fact_id, subject, description) of the first name in a question about time: .5 + .1 a shared word."""
    named = asked.where(questions.flags(F.col("q"))["is_temporal"]).select("query_id", "q", F.lower(F.try_element_at(questions.names(F.col("q")), F.lit(1))).alias("who"))
    rows = states.withColumn("who", F.lower("subject")).join(named, "who")
    score = 0.5 + 0.1 * F.size(F.array_intersect(tokens(F.col("q")), tokens(F.col("description"))))
    return best(rows.withColumn("score", score), 40).select("query_id", "fact_id", "score", "rank")


def fuse_signals(found: dict[str, DataFrame]) -> DataFrame:
    """Rows (query_id, fact_id, score, rank) of several searches with their ``signal``, each fact as the first signal has it."""
    rows = reduce(DataFrame.unionByName, [rows.withColumns({"signal": F.lit(name), "_order": F.lit(i)}) for i, (name, rows) in enumerate(found.items())])
    first = F.min_by(F.struct("signal", "score", F.col("rank").alias("signal_rank"), "_order"), F.struct("_order", "rank"))
    return rows.groupBy("query_id", "fact_id").agg(first.alias("f")).select("query_id", "fact_id", "f.*")


def retrieve(asked: DataFrame, facts: DataFrame, states: DataFrame, k: int = 20) -> DataFrame:
    """All searches fused; the first row of each type of fact gains .1; the best ``k`` of a question."""
    found = {"keyword": search_keyword(asked, facts, 2 * k), "entity": search_entity(asked, facts, 2 * k), "graph": search_graph(asked, facts, k), "temporal": search_states(asked, states)}
    typed = facts.select("fact_id", "fact_type").unionByName(states.select("fact_id", F.lit("unknown").alias("fact_type")))
    rows = fuse_signals(found).join(typed, "fact_id")
    first = Window.partitionBy("query_id", "fact_type").orderBy("_order", "signal_rank")
    rows = rows.withColumn("score", F.col("score") + F.when(F.row_number().over(first) == 1, 0.1).otherwise(0.0))
    return best(rows, k).select("query_id", "fact_id", "signal", "fact_type", "score", "rank")


def build_context(found: DataFrame, said: DataFrame) -> DataFrame:
    """(query_id, context): the facts, then the states, one a line, in order of rank; ``said`` has (fact_id, line)."""
    rows = found.join(said, "fact_id").withColumn("part", F.when(F.col("signal") == "temporal", 1).otherwise(0))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    parts = rows.groupBy("query_id", "part").agg(F.array_join(lines, "\n").alias("text"))
    headed = F.struct("part", F.concat(F.when(F.col("part") == 0, "FACTS:\n").otherwise("TEMPORAL INFORMATION:\n"), "text").alias("text"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(headed)), lambda x: x["text"]), "\n\n").alias("context"))


def multi_hop(asked: DataFrame, facts: DataFrame, k: int = 5, hops: int = 4) -> DataFrame:
    """(query_id, hop, sub_query, fact_id, score, rank): the facts found for each part of a question, each at its first hop."""
    parts = asked.select("query_id", F.posexplode(F.slice(questions.decompose(F.col("q"))["parts"], 1, hops)).alias("hop", "q"))
    keyed = parts.select(F.struct("query_id", "hop").alias("query_id"), "q")
    rows = search_facts(keyed, facts, k).join(keyed, "query_id").select("query_id.query_id", "query_id.hop", F.col("q").alias("sub_query"), "fact_id", "score", "rank")
    seen = Window.partitionBy("query_id", "fact_id").orderBy("hop")
    return rows.withColumn("_r", F.row_number().over(seen)).where("_r = 1").drop("_r")


def hop_confidence(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean score, a tenth more for three rows or more, 1 at most."""
    mean = F.avg("score") * F.when(F.count(F.lit(1)) >= 3, 1.1).otherwise(1.0)
    return rows.groupBy(*by).agg(F.least(F.lit(1.0), mean).alias("confidence"), F.count(F.lit(1)).alias("rows"))


def evidence_confidence(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean of ``score`` where later steps (``hop``) weigh more: 1 + hop / 2."""
    weight = 1 + 0.5 * F.col("hop")
    return rows.groupBy(*by).agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("confidence"))


def explain_path(rows: DataFrame, said: DataFrame) -> DataFrame:
    """(query_id, path): the hops in order, each with its evidence cut at 200 characters."""
    best_first = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    hops = rows.join(said, "fact_id").groupBy("query_id", "hop", "sub_query").agg(F.substring(F.array_join(best_first, " | "), 1, 200).alias("evidence"))
    line = F.concat(F.lit("Hop "), (F.col("hop") + 1).cast("string"), F.lit(": "), "sub_query", F.lit(" -> "), "evidence")
    return hops.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", line.alias("line")))), lambda x: x["line"]), "\n").alias("path"))


def answer_confidence(similarity: Column, sources: Column, answer: Column) -> Column:
    """.5 mean similarity + .3 sources of three + .2 words of ten, halved if the answer is unsure."""
    words = F.size(F.filter(F.split(answer, r"\s+"), lambda w: w != ""))
    sure = 0.5 * similarity + 0.3 * F.least(F.lit(1.0), sources / 3) + 0.2 * F.least(F.lit(1.0), words / 10)
    # Phrases of an unsure answer.
    unsure = F.lower(answer).rlike("don't have|no information|cannot|unclear|not sure")
    return F.least(F.lit(1.0), F.when(unsure, sure * 0.5).otherwise(sure))


def answer_quality(confidence: Column, sources: Column) -> Column:
    return F.when((confidence >= 0.7) & (sources >= 2), "high").when((confidence >= 0.5) & (sources >= 1), "medium").when(confidence >= 0.3, "low").otherwise("none")


def search_tiered(overlaps: DataFrame, asked: DataFrame, memories: DataFrame, each: int = 5, overall: int = 10) -> DataFrame:
    """(query_id, memory_id, tier, similarity, relevance, recency, importance, score, rank): memories of the tiers that a question's intent asks for.

    ``overlaps`` is (query_id, memory_id, overlap, query_size, memory_size), ``asked`` (query_id, plan, terms),
    ``memories`` (memory_id, text, tier, hours, importance).  Token Jaccard of .3 at least counts.
    """
    jaccard = F.col("overlap") / (F.col("query_size") + F.col("memory_size") - F.col("overlap"))
    rows = overlaps.withColumn("similarity", jaccard).where("similarity >= 0.3").join(memories, "memory_id").join(asked, "query_id")
    place = F.array_position("plan.tiers", F.col("tier")).cast("int") - 1
    rows = rows.withColumn("place", place).where("place >= 0")
    share = F.aggregate("terms", F.lit(0), lambda a, t: a + F.contains(F.lower("text"), t).cast("int")) / F.greatest(F.size("terms"), F.lit(1))
    rows = rows.withColumn("relevance", F.least(F.lit(1.0), 0.5 + 0.3 * (1 - 0.2 * F.col("place")) + 0.2 * share)).withColumn("recency", scores.linear_recency_30d(F.col("hours")))
    score = F.col("similarity") * F.col("plan.similarity") + F.col("relevance") * F.col("plan.importance") + 0.3 * F.col("recency") * F.col("plan.recency")
    score = score * F.when((F.col("tier") == "short_term") & (F.col("plan.intent") == "context"), 1.3).otherwise(1.0) * (1 - 0.1 * F.col("place"))
    rows = rows.withColumn("score", F.round(score, 6))
    few = top(rows, "score", each, ["tier"]).drop("rank")
    return top(few, "score", overall).select("query_id", "memory_id", "tier", "place", "plan", "text", "similarity", "relevance", "recency", "importance", "score", "rank")


def rank_by_intent(found: DataFrame) -> DataFrame:
    """Rows of ``search_tiered`` scored anew: four weighted parts times the tier's boost."""
    # Weights that an intent sets (recency, similarity, importance), and boosts of the tiers.
    intent = F.col("plan.intent")
    recency = F.when(intent == "context", 0.8).when(intent == "factual", 0.2).when(intent == "preference", 0.7).otherwise(F.col("plan.recency"))
    similarity = F.when(intent == "context", 0.5).when(intent == "factual", 0.7).otherwise(F.col("plan.similarity"))
    importance = F.when(intent == "preference", 0.5).otherwise(0.3)
    boost = F.when(F.col("tier") == "short_term", 1.2).when(F.col("tier") == "semantic", 0.9).otherwise(1.0) * (1 + 0.1 * (F.size("plan.tiers") - F.col("place")))
    total = (F.col("similarity") * similarity + F.col("relevance") * F.col("plan.importance") + F.col("recency") * recency + F.col("importance") * importance) * boost
    return top(found.drop("rank").withColumn("score", F.round(total, 6)), "score", 10)


def hybrid(near: DataFrame, texts: DataFrame, asked: DataFrame, k: int = 5, least: float = 0.5) -> DataFrame:
    """.7 cosine + .3 share of the question's words, ``least`` at least: (query_id, vec_id, score, rank).

    ``near`` is (query_id, vec_id, similarity), ``texts`` (vec_id, text), ``asked`` (query_id, words).
    """
    rows = near.join(asked, "query_id").join(texts, "vec_id")
    share = F.size(F.array_intersect("words", tokens(F.col("text")))) / F.greatest(F.size("words"), F.lit(1))
    rows = rows.withColumn("score", F.round(0.7 * F.col("similarity") + 0.3 * share, 6)).where(F.col("score") >= least)
    return best(rows, k, "vec_id").select("query_id", "vec_id", "score", "rank")


def context_topics_boost(rows: DataFrame, turns: DataFrame, last: int = 5) -> DataFrame:
    """``score`` * (1 + min(.2, .05 a shared word)) with the words of the ``last`` turns before a turn.

    ``rows`` is (session_id, seq, text, score); ``turns`` (session_id, seq, text).
    """
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-last, -1)
    known = turns.select("session_id", "seq", F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))).over(before))).alias("known"))
    shared = F.size(F.array_intersect(F.coalesce("known", F.array().cast("array<string>")), tokens(F.col("text"))))
    return rows.join(known, ["session_id", "seq"]).withColumn("score", F.col("score") * (1 + F.least(F.lit(0.2), 0.05 * shared))).drop("known")
