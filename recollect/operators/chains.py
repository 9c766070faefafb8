"""Answers of several steps: evidence step by step, each step only with what earlier ones have not seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import retrieval
from recollect.operators.shared import cut

# Words that speak for and against, looked for anywhere in the evidence.
FOR = ["yes", "like", "enjoy", "love", "prefer"]
AGAINST = ["no", "not", "never", "dislike", "hate"]
TRUE = ["yes", "true", "indeed", "correct"]
FALSE = ["no", "not", "false", "never"]
INFERENCE = ["would", "could", "might", "likely"]
DESCRIPTIVE = ["what", "which", "describe"]
# Words left out when a question is bridged.
BRIDGE_STOP = ["what", "is", "the", "a", "an", "of", "to", "in", "for", "and", "or", "my", "where", "who", "how"]


def facts_about(entities: DataFrame, facts: DataFrame, each: int) -> DataFrame:
    """(entity, fact_id, nth): the first ``each`` facts that have an entity on either side; a hub's others stay behind.

    ``entities`` has lower-case names; the cut comes before the join, so it is made where the facts are.
    """
    about = retrieval._sides(facts).select("entity", "fact_id").distinct()
    first = Window.partitionBy("entity").orderBy("fact_id")
    return about.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= each).join(entities.select("entity").distinct(), "entity")


def evidence_steps(asked: DataFrame) -> DataFrame:
    """(query_id, step, part): the sub-questions of a question, in order."""
    return asked.select("query_id", F.posexplode(questions.evidence_steps(F.col("q"))).alias("step", "part"))


def evidence_chain(asked: DataFrame, facts: DataFrame, k: int = 5, each: int = 3) -> DataFrame:
    """(query_id, step, part, nth, fact_id, entity, source, confidence, content): the evidence of every sub-question.

    A step has the ``k`` facts that a search finds for it, and of each entity it names
    ``each`` facts, if no earlier step had evidence with that entity.  An entity's first
    step is one minimum over (question, entity), so no loop over steps is needed.
    ``nth`` orders a step's evidence: search by rank, then its entities in their order.
    """
    steps = cut(evidence_steps(asked))
    keyed = steps.select(F.struct("query_id", "step").alias("query_id"), F.col("part").alias("q"))
    said = facts.select("fact_id", F.lower("subject").alias("subject"), F.lower("object").alias("object"), retrieval.statement(facts).alias("content"))
    found = retrieval.search_facts(keyed, facts, k).select("query_id.query_id", "query_id.step", "fact_id", "score", "rank")
    found = cut(found.join(said, "fact_id"))
    named = steps.select("query_id", "step", F.posexplode(F.transform(questions.names(F.col("part")), F.lower)).alias("place", "entity"))
    about = cut(named.join(facts_about(named, facts.where("is_current"), each), "entity"))
    met = found.select("query_id", "step", F.explode(F.array("subject", "object")).alias("entity")).unionByName(about.select("query_id", "step", "entity"))
    first = met.groupBy("query_id", "entity").agg(F.min("step").alias("first"))
    fresh = about.join(first, ["query_id", "entity"]).where("step <= first").join(said.select("fact_id", "content"), "fact_id")
    searched = found.select("query_id", "step", F.lit(0).alias("kind"), F.col("rank").alias("a"), F.lit(0).alias("b"), "fact_id", F.lit(None).cast("string").alias("entity"), F.lit("search").alias("source"), F.col("score").cast("double").alias("confidence"), "content")
    graphed = fresh.select("query_id", "step", F.lit(1).alias("kind"), F.col("place").alias("a"), F.col("nth").alias("b"), "fact_id", "entity", F.lit("graph").alias("source"), F.lit(0.8).alias("confidence"), "content")
    order = Window.partitionBy("query_id", "step").orderBy("kind", "a", "b")
    rows = searched.unionByName(graphed).withColumn("nth", F.row_number().over(order))
    return rows.join(steps, ["query_id", "step"]).select("query_id", "step", "part", "nth", "fact_id", "entity", "source", "confidence", "content")


def _votes(texts: Column, words: list[str]) -> Column:
    return F.size(F.filter(texts, lambda t: F.lower(t).rlike("|".join(words))))


def step_answers(evidence: DataFrame) -> DataFrame:
    """(query_id, step, part, answer): the first three pieces of a step together, or its yes or no.

    A part that asks what is known is answered at more length; a yes-no part by what
    more of its pieces say.
    """
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"])
    rows = evidence.groupBy("query_id", "step", "part").agg(pieces.alias("pieces"))
    joined = F.array_join(F.transform(F.slice("pieces", 1, 3), lambda t: F.substring(t, 1, 100)), " ")
    low = F.lower("part")
    good, bad = _votes(F.col("pieces"), TRUE), _votes(F.col("pieces"), FALSE)
    asks = low.rlike("^(is|are|does|did|would|could) ")
    answer = (
        F.when(F.contains(low, F.lit("what do we know")), F.substring(joined, 1, 200)).when(asks & (good > bad), "Evidence suggests yes.")
        .when(asks & (bad > good), "Evidence suggests no.").otherwise(F.substring(joined, 1, 150))
    )
    return rows.select("query_id", "step", "part", answer.alias("answer"))


def chain_answers(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, pieces, confidence, answer) of every question, those without evidence too.

    A question of likelihood is answered by what its pieces speak for or against, a
    descriptive one by its first pieces (brackets removed, of over ten characters, three at most
    out of five), any other by the surest piece.  Later steps weigh more in the confidence.
    """
    piece = F.struct("step", "nth", "content", "confidence")
    rows = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(piece)).alias("e"))
    trust = retrieval.evidence_confidence(evidence.select("query_id", F.col("confidence").alias("score"), F.col("step").alias("hop")), ["query_id"])
    rows = asked.select("query_id", F.lower("q").alias("low")).join(rows, "query_id", "left").join(trust, "query_id", "left")
    texts = F.transform("e", lambda x: x["content"])
    good, bad = _votes(texts, FOR), _votes(texts, AGAINST)
    bare = F.transform(F.slice(texts, 1, 5), lambda t: F.regexp_replace(F.regexp_replace(t, r"\[.*?\]", ""), r"\(.*?\)", ""))
    told = F.array_join(F.slice(F.transform(F.filter(bare, lambda t: F.length(t) > 10), lambda t: F.substring(F.trim(t), 1, 100)), 1, 3), "; ")
    surest = F.array_sort("e", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["step"] != b["step"], a["step"] - b["step"]).otherwise(a["nth"] - b["nth"]))[0]["content"]
    answer = (
        F.when(F.col("e").isNull(), "Insufficient information to answer.")
        .when(F.col("low").rlike("|".join(INFERENCE)), F.when(good > bad, "Yes, likely based on the evidence.").when(bad > good, "No, unlikely based on the evidence.").otherwise("Cannot determine with confidence."))
        .when(F.col("low").rlike("|".join(DESCRIPTIVE)) & (told != ""), told).otherwise(F.substring(surest, 1, 150))
    )
    return rows.select("query_id", F.coalesce(F.size("e"), F.lit(0)).alias("pieces"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), answer.alias("answer")).withColumn("pieces", F.greatest(F.lit(0), "pieces"))


def reasoning_chain(asked: DataFrame, facts: DataFrame, states: DataFrame, k: int = 10, near: int = 5, steps: int = 4) -> DataFrame:
    """(query_id, step, part, fact_id, source): what each part of a question adds to what earlier parts found.

    A part is searched for in several wordings (itself, a made-up answer, two
    other wordings).  Facts of earlier steps do not count again.  A part that adds none is
    looked up in the graph: the first of its entities whose neighbours' facts (``near`` an
    entity) add any.  All searches run at once; the loop over at most ``steps`` steps only
    keeps apart what was seen, one anti-join a step.
    """
    parts = cut(asked.select("query_id", F.posexplode(F.slice(questions.decompose(F.col("q"))["parts"], 1, steps)).alias("step", "part")))
    wordings = F.concat(F.array("part", F.get(questions.hypothetical_answers(F.col("part")), F.lit(0))), F.slice(questions.expand(F.col("part")), 2, 2))
    worded = parts.select("query_id", "step", F.posexplode(F.array_distinct(F.array_compact(wordings))).alias("way", "q"))
    keyed = worded.select(F.struct("query_id", "step", "way").alias("query_id"), "q")
    direct = cut(retrieval.retrieve(keyed, facts, states, k).select("query_id.query_id", "query_id.step", "fact_id").distinct())
    named = parts.select("query_id", "step", F.posexplode(questions.entities(F.col("part"))).alias("place", "entity"))
    # a fact is there for its two sides at most
    near_by = retrieval.near_facts(named, facts, near, 2 * near).select(F.col("named").alias("entity"), "fact_id").distinct()
    around = named.join(near_by, "entity")
    first = Window.partitionBy("query_id", "step", "place").orderBy("fact_id")
    around = around.select("query_id", "step", "place", "fact_id").distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= near).drop("_r")
    around = cut(around)
    seen = direct.where("step < 0").withColumn("source", F.lit(""))
    for step in range(steps):
        held = seen.select("query_id", "fact_id")
        fresh = direct.where(F.col("step") == step).join(held, ["query_id", "fact_id"], "left_anti").withColumn("source", F.lit("search"))
        bare = parts.where(F.col("step") == step).join(fresh.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
        other = around.where(F.col("step") == step).join(bare, "query_id").join(held, ["query_id", "fact_id"], "left_anti")
        chosen = other.groupBy("query_id").agg(F.min("place").alias("place"))
        other = other.join(chosen, ["query_id", "place"]).select("query_id", "step", "fact_id").withColumn("source", F.lit("graph"))
        seen = cut(seen.select("query_id", "step", "fact_id", "source").unionByName(fresh.select("query_id", "step", "fact_id", "source")).unionByName(other))
    return seen.join(parts, ["query_id", "step"]).select("query_id", "step", "part", "fact_id", "source")


def bridge_terms(text: Column, most: int = 3) -> Column:
    """The first key terms in alphabetic order, as one text; null if there are none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    terms = F.slice(F.array_sort(F.array_distinct(F.array_except(words, F.lit(BRIDGE_STOP)))), 1, most)
    return F.when(F.size(terms) > 0, F.array_join(terms, " "))


def bridge_hop(asked: DataFrame, found: DataFrame, facts: DataFrame, k: int = 6, worth: float = 0.7) -> DataFrame:
    """(query_id, terms, evidence, confidence) of the questions that no row of ``found`` has: a search by their key terms.

    The evidence are the first three facts, each cut at 200 characters; the
    confidence is that of a hop, times ``worth``.
    """
    bare = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", bridge_terms(F.col("q")).alias("q")).where("q is not null")
    rows = retrieval.search_facts(bare, facts, k).join(facts.select("fact_id", F.substring(retrieval.statement(facts), 1, 200).alias("line")), "fact_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    told = rows.groupBy("query_id").agg(F.array_join(F.slice(lines, 1, 3), " | ").alias("evidence"))
    trust = retrieval.hop_confidence(rows, ["query_id"]).select("query_id", (F.col("confidence") * worth).alias("confidence"))
    return bare.join(told, "query_id").join(trust, "query_id").select("query_id", F.col("q").alias("terms"), "evidence", "confidence")


def context_lines_match(asked: DataFrame, contexts: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, key, line, content, shared, confidence): lines that share ``least`` words of four letters or more with their question.

    ``asked`` are (query_id, q), ``contexts`` (query_id, key, text) with any number of texts a question.  The
    questions' words go to the lines, not all lines to each other.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w{4,})\b"), F.lit(1)))
    lines = contexts.select("query_id", "key", F.posexplode(F.split("text", "\n")).alias("line", "content")).where("trim(content) <> ''")
    rows = lines.join(asked.select("query_id", words(F.col("q")).alias("_w")), "query_id")
    rows = rows.withColumn("shared", F.size(F.array_intersect(words(F.col("content")), F.col("_w")))).where(F.col("shared") >= least)
    return rows.select("query_id", "key", "line", "content", "shared", F.least(F.lit(1.0), F.col("shared") * 0.2).alias("confidence"))
