"""Search that weighs meaning, words and what is known of a memory at once, and its re-ranking.

Questions and memories are sparse vectors over one space of keys: words, buckets of a
hashed embedding, dates, speakers.  A score is their dot product, so one pass over the memories finds the
best of every question, exactly and without pairs in a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import questions
from recollect.operators import graph
from recollect.operators.shared import cut
from recollect.operators.sparse import sparse_top
from recollect.sources.conversations import hash_embedding

KEYS = "array<struct<key: string, weight: double>>"
# Parts of a question that tell what it asks for.
TIME = ["when", "date", "time", "year", "day", "month", "before", "after", "how long", "ago"]
TIME_AGAIN = [*TIME, "during"]
PERSON = ["who", "whom", "whose"]
PLACE = ["where", "location", "place"]
TASTE = ["like", "prefer", "favorite", "enjoy"]
# Parts of a memory that answer such questions.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
NEAR = ["in", "at", "to", "from", "near"]
LIKING = ["like", "love", "enjoy", "prefer", "favorite"]


def long_words(text: Column) -> Column:
    """Words of three characters or more in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b(\w{3,})\b"), F.lit(1)))


def bare_words(text: Column) -> Column:
    """Words in lower case, one blank between them."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1)), " ")


def word_runs(text: Column, most: int = 4) -> Column:
    """Runs of one to ``most`` words of a text, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))

    def of(n: int) -> Column:
        return F.transform(words, lambda w, i: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " ")))

    return F.array_distinct(F.array_compact(F.concat(*map(of, range(1, most + 1)))))


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)) for w in words])


def _keyed(kind: str, values: Column, weight) -> Column:
    return F.transform(values, lambda v: F.struct(F.concat(F.lit(kind), v).alias("key"), F.lit(weight).cast("double").alias("weight")))


def _some(when: Column, keys: Column) -> Column:
    return F.when(when, keys).otherwise(F.array().cast(KEYS))


def _hashed(text: Column, weight: float) -> Column:
    return F.transform(hash_embedding(text), lambda p: F.struct(F.concat(F.lit("b:"), p["bucket"].cast("string")).alias("key"), (p["weight"] * weight).alias("weight")))


def question_keys(q: Column) -> Column:
    """.4 of the embedding, .3 of the share of words; .05 for dated memories and .03 for the date named, if about time; .06 for the speaker named, if about a person; .01 of importance."""
    words = long_words(q)
    shared = F.transform(words, lambda w: F.struct(F.concat(F.lit("w:"), w).alias("key"), (0.3 / (F.size(words) + 1)).alias("weight")))
    timed, person = has_any(q, TIME), has_any(q, PERSON)
    return F.concat(shared, _hashed(q, 0.4), _some(timed, _keyed("t:", F.array(F.lit("")), 0.05)), _some(timed, _keyed("d:", word_runs(q), 0.03)), _some(person, _keyed("s:", word_runs(q), 0.06)), _keyed("i:", F.array(F.lit("")), 0.01))


def memory_keys(content: Column, event_date: Column, speaker: Column, importance: Column) -> Column:
    one = lambda kind, value, when: _some(when, _keyed(kind, F.array(value), 1.0))
    worth = F.array(F.struct(F.lit("i:").alias("key"), F.coalesce(importance, F.lit(0.0)).cast("double").alias("weight")))
    return F.concat(_keyed("w:", long_words(content), 1.0), _hashed(content, 1.0), one("t:", F.lit(""), event_date.isNotNull()), one("d:", bare_words(event_date), event_date.isNotNull()), one("s:", bare_words(speaker), speaker.isNotNull()), worth)


def basic_search(asked: DataFrame, memories: DataFrame, k: int = 20, types: list[str] | None = None) -> DataFrame:
    """(query_id, memory_id, score, rank) of (query_id, q) over (memory_id, content, event_date, speaker, importance, memory_type)."""
    if types is not None:
        memories = memories.where(F.col("memory_type").isin(types))
    keys = memory_keys(F.col("content"), F.col("event_date"), F.col("speaker"), F.col("importance"))
    return sparse_top(asked.select("query_id", question_keys(F.col("q")).alias("keys")), memories.select("memory_id", keys.alias("keys")), k)


def similarity(a: Column, b: Column) -> Column:
    """Dot product of the hashed embeddings of two texts."""
    left = F.transform(hash_embedding(a), lambda p: F.struct(p["bucket"].alias("bucket"), p["weight"].alias("a"), F.lit(0.0).alias("b")))
    right = F.transform(hash_embedding(b), lambda p: F.struct(p["bucket"].alias("bucket"), F.lit(0.0).alias("a"), p["weight"].alias("b")))
    start = F.struct(F.lit(-1).cast("long").alias("bucket"), F.lit(0.0).alias("a"), F.lit(0.0).alias("sum"))

    def add(have: Column, p: Column) -> Column:
        # within a bucket the right part, whose a is 0, comes first
        met = (have["bucket"] == p["bucket"]) & (p["b"] == 0.0)
        return F.struct(p["bucket"].alias("bucket"), p["b"].alias("a"), (have["sum"] + F.when(met, have["a"] * p["a"]).otherwise(0.0)).alias("sum"))

    return F.aggregate(F.array_sort(F.concat(left, right)), start, add, lambda have: have["sum"])


def rerank(asked: DataFrame, found: DataFrame, memories: DataFrame, k: int = 15, embedded: bool = True) -> DataFrame:
    """(query_id, memory_id, initial, score, reason, rank): candidates (query_id, memory_id, score) judged again by their texts.

    .35 of the meaning, .25 of shared words, .2 of the first score and .2 of what suits
    the question: dates and months, its speaker, places, likings; without embeddings .5, .3, .2.  ``reason`` is the last that suited.
    """
    rows = found.withColumnRenamed("score", "initial").join(asked.select("query_id", "q"), "query_id").join(memories.select("memory_id", "content", "speaker"), "memory_id")
    q, text = F.col("q"), F.col("content")
    words = long_words(q)
    overlap = F.size(F.array_intersect(words, long_words(text))) / (F.size(words) + 1)
    tests = [
        (has_any(q, TIME_AGAIN) & text.rlike(r"\b\d{4}\b"), 0.2, "has_date"), (has_any(q, TIME_AGAIN) & has_any(text, MONTHS), 0.15, "has_month"),
        (has_any(q, PERSON) & F.coalesce(F.contains(F.lower(q), F.lower("speaker")) & (F.col("speaker") != ""), F.lit(False)), 0.25, "speaker_match"),
        (has_any(q, PLACE) & has_any(text, NEAR), 0.1, "location_indicator"), (has_any(q, TASTE) & has_any(text, LIKING), 0.15, "preference_language"),
    ]
    boost = reduce(lambda a, b: a + b, [F.when(t, v).otherwise(0.0) for t, v, _ in tests])
    reason = F.coalesce(*[F.when(t, name) for t, _, name in reversed(tests)], F.lit(""))
    score = 0.35 * similarity(q, text) + 0.25 * overlap + 0.2 * F.col("initial") + 0.2 * boost if embedded else 0.5 * overlap + 0.3 * F.col("initial") + 0.2 * boost
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    rows = rows.withColumn("score", F.round(score, 9)).withColumn("reason", reason).withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= k).select("query_id", "memory_id", "initial", "score", "reason", "rank")


def graph_candidates(asked: DataFrame, edges: DataFrame, index: DataFrame, entities: int = 3, near: int = 5, each: int = 3) -> DataFrame:
    """(query_id, place, memory_id): memories of the entities around those that a question names.

    ``edges`` are (source, target) between lower-case names, ``index`` (entity, memory_id).  Of a question the first
    ``entities`` names in the graph, of each the first ``near`` entities within two hops, of those the first ``each`` memories.
    """
    nodes = edges.select(F.col("source").alias("entity")).union(edges.select("target")).distinct()
    named = asked.select("query_id", F.posexplode(F.transform(questions.names(F.col("q")), F.lower)).alias("at", "entity")).join(nodes, "entity")
    first = Window.partitionBy("query_id").orderBy("at")
    named = named.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= entities).select("query_id", "entity", F.col("_r").alias("at"))
    around = graph.related(edges, named.select(F.col("entity").alias("seed")).distinct(), 2)
    ranked = Window.partitionBy("seed").orderBy("hop", "node")
    around = around.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= near)
    held = index.distinct().withColumn("_m", F.row_number().over(Window.partitionBy("entity").orderBy("memory_id"))).where(F.col("_m") <= each)
    rows = named.join(around.withColumnRenamed("seed", "entity"), "entity").drop("entity").join(held.withColumnRenamed("entity", "node"), "node")
    return rows.select("query_id", (F.col("at") * 10_000 + F.col("_n") * 100 + F.col("_m")).alias("place"), "memory_id")


def search(asked: DataFrame, memories: DataFrame, edges: DataFrame, index: DataFrame, k: int = 15, decompose: bool = True) -> DataFrame:
    """(query_id, memory_id, initial, score, reason, rank): the parts of a question searched for, with memories around its entities at .3, and all re-ranked.

    A memory that several parts find keeps the score of the first; the candidates of a question are
    bounded (2k a part and those of its entities) before texts are joined.
    """
    parts = F.col("parts") if decompose else F.array("q")
    keyed = asked.select("query_id", questions.decompose(F.col("q"))["parts"].alias("parts"), "q").select("query_id", F.posexplode(parts).alias("seq", "part"))
    found = basic_search(keyed.select(F.struct("query_id", "seq").alias("query_id"), F.col("part").alias("q")), memories, 2 * k)
    found = found.select("query_id.query_id", F.col("query_id.seq").cast("long").alias("kind"), F.col("rank").cast("long").alias("place"), "memory_id", "score")
    around = graph_candidates(asked, edges, index).select("query_id", F.lit(1 << 40).alias("kind"), F.col("place").cast("long").alias("place"), "memory_id", F.lit(0.3).alias("score"))
    every = found.unionByName(around).groupBy("query_id", "memory_id").agg(F.min_by("score", F.struct("kind", "place")).alias("score"))
    return rerank(asked, cut(every), memories, k)


def search_wordings(asked: DataFrame, memories: DataFrame, wordings: Column, k: int = 15) -> DataFrame:
    """(query_id, memory_id, score, rank): the best of several wordings of a question; a memory keeps the score of the first that finds it."""
    keyed = asked.select("query_id", F.posexplode(wordings).alias("seq", "q"))
    found = basic_search(keyed.select(F.struct("query_id", "seq").alias("query_id"), "q"), memories, k)
    first = found.groupBy("query_id.query_id", "memory_id").agg(F.min_by("score", "query_id.seq").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_expanded(asked: DataFrame, memories: DataFrame, k: int = 15) -> DataFrame:
    """As ``search_wordings`` with the question and up to three other wordings."""
    return search_wordings(asked, memories, questions.expand(F.col("q")), k)


def search_hypothetical(asked: DataFrame, memories: DataFrame, k: int = 15) -> DataFrame:
    """(query_id, memory_id, score, rank): the memories nearest in meaning to the first made-up answer; those it shares nothing with as the question finds them."""
    made_up = asked.select("query_id", F.get(questions.hypothetical_answers(F.col("q")), F.lit(0)).alias("q"))
    near = sparse_top(made_up.select("query_id", _hashed(F.col("q"), 1.0).alias("keys")), memories.select("memory_id", _hashed(F.col("content"), 1.0).alias("keys")), k)
    every = near.withColumn("kind", F.lit(0)).unionByName(basic_search(asked, memories, k).withColumn("kind", F.lit(1)))
    first = every.groupBy("query_id", "memory_id").agg(F.min_by("score", "kind").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_with_reasoning(asked: DataFrame, memories: DataFrame, edges: DataFrame, index: DataFrame, few: int = 5) -> DataFrame:
    """(query_id, memory_id, score, rank, reasoning): ten memories, and where fewer than ``few`` came, five more for each of two further questions."""
    first = cut(search(asked, memories, edges, index, 10).select("query_id", "memory_id", "score"))
    counts = asked.select("query_id", "q").join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").na.fill(0, ["n"])
    told = F.concat(F.lit("Initial search for: "), "q", F.lit("\nFound "), F.col("n").cast("string"), F.lit(" relevant memories"))
    more = F.when(F.col("n") < few, F.slice(questions.follow_ups(F.col("q")), 1, 2)).otherwise(F.array().cast("array<string>"))
    steps = counts.select("query_id", more.alias("more"), F.concat(told, F.array_join(F.transform(more, lambda f: F.concat(F.lit("\nFollow-up search: "), f)), "")).alias("reasoning"))
    further = steps.select("query_id", F.posexplode("more").alias("seq", "q")).select(F.struct("query_id", "seq").alias("query_id"), "q")
    again = search(further, memories, edges, index, 5, decompose=False).select("query_id.query_id", F.col("query_id.seq").alias("kind"), "memory_id", "score")
    every = first.withColumn("kind", F.lit(-1)).unionByName(again).groupBy("query_id", "memory_id").agg(F.min_by("score", "kind").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    rows = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 15)
    return rows.join(steps.select("query_id", "reasoning"), "query_id")
