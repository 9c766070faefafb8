"""Conflicts between facts: detection by equi-joins, and resolution by named strategies.

A group of facts that disagree is reported by its different values, each with its
first fact and its number of facts; facts of one value are not paired one by one,
so a subject with a third of all facts costs no more than its values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.tokens import jaccard, tokens

# How far a source is trusted.
SOURCE_RANK = {"user_input": 6, "system": 5, "observation": 4, "assistant_output": 3, "inference": 2, "consolidation": 1}
# Relations of which a subject has one target at a time.
EXCLUSIVE = ["lives_in", "works_at", "married_to"]
# Predicates of which a subject has one object at a time.
EXCLUSIVE_PREDICATES = ["lives in", "lives at", "works at", "works as", "is married to", "relationship status", "favorite", "current job", "current location", "nationality"]
# A predicate and what contradicts it.
OPPOSITES = {"likes": "dislikes", "loves": "hates", "enjoys": "dislikes", "supports": "opposes", "agrees": "disagrees"}
# Spellings of predicates.
PREDICATE_FORMS = {"like": "likes", "liked": "likes", "love": "loves", "loved": "loves", "hate": "hates", "hated": "hates", "dislike": "dislikes", "disliked": "dislikes", "live in": "lives in", "lived in": "lives in", "work at": "works at", "worked at": "works at", "move from": "moved from", "was": "is", "had": "has"}
# A phrase and its negation, as substrings.
NEGATIONS = [("is", "is not"), ("can", "cannot"), ("does", "does not"), ("will", "will not"), ("should", "should not"), ("likes", "dislikes"), ("prefers", "avoids"), ("always", "never"), ("true", "false"), ("yes", "no")]
# Severity, confidence and whether it may be resolved without a user, by type of conflict.
TYPES = {"fact_inconsistency": ("medium", 0.9, True), "direct_contradiction": ("high", 0.85, False), "temporal_outdated": ("low", 0.6, True), "preference_conflict": ("medium", 0.8, True)}
# The strategy of a type of conflict; a critical one goes to the user.
DEFAULT_STRATEGY = {"temporal_outdated": "recency", "preference_conflict": "recency", "fact_inconsistency": "confidence", "direct_contradiction": "user_guided", "source_disagreement": "source", "partial_overlap": "merge"}
SEVERITY_ORDER = ["low", "medium", "high", "critical"]


def _pick(column: Column, values: dict, otherwise) -> Column:
    out = F.when(F.lit(False), F.lit(otherwise))
    for key, value in values.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def normalise_predicate(predicate: Column) -> Column:
    low = F.lower(F.trim(predicate))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PREDICATE_FORMS.items() for x in pair]), low), low)


def value_conflicts(facts: DataFrame, keys: list[str], value: str, key: str = "fact_id") -> DataFrame:
    """(keys, value_a, value_b, a, b, facts_a, facts_b) for each two values of one group of keys.

    ``a`` and ``b`` are the first facts of the values, a < b; values compare in lower case, trimmed.
    """
    low = F.lower(F.trim(F.col(value).cast("string")))
    held = facts.groupBy(*keys, low.alias("_value")).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_facts"))
    sides = [held.select(*keys, *[F.col(f"_{c}").alias(f"{n}_{s}") for c, n in (("value", "value"), ("first", "first"), ("facts", "facts"))]) for s in "ab"]
    both = sides[0].join(sides[1], keys).where("first_a < first_b")
    return both.select(*keys, "value_a", "value_b", F.col("first_a").alias("a"), F.col("first_b").alias("b"), "facts_a", "facts_b")


def triplet_conflicts(triplets: DataFrame) -> DataFrame:
    """(source, a, b, kind), a < b: two targets of an exclusive relation, or likes against dislikes of one target.

    Only current triplets count; each side is the first triplet with its target or relation.
    """
    current = triplets.where("is_current")
    exclusive = value_conflicts(current.where(F.col("relation").isin(EXCLUSIVE)), ["source", "relation"], "target", "triplet_id").select("source", "a", "b", F.lit("exclusive").alias("kind"))
    mixed = value_conflicts(current.where(F.col("relation").isin("likes", "dislikes")), ["source", "target"], "relation", "triplet_id").select("source", "a", "b", F.lit("polarity").alias("kind"))
    return exclusive.unionByName(mixed)


def negation_pairs(rows: DataFrame, block: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """(block, pattern, a, b, positives, negatives): blocks where one text has a phrase and another its negation.

    ``a`` is the first row with the phrase alone, ``b`` the first with the negation; phrases are substrings.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    sides = [F.struct(F.lit(i).alias("pattern"), F.contains(low, F.lit(p)).alias("yes"), F.contains(low, F.lit(n)).alias("no")) for i, (p, n) in enumerate(NEGATIONS)]
    said = rows.select(*block, F.col(key).alias("_id"), F.explode(F.array(*sides)).alias("s")).select(*block, "_id", "s.*").where("yes or no")
    alone = F.col("yes") & ~F.col("no")
    firsts = said.groupBy(*block, "pattern").agg(F.min(F.when(alone, F.col("_id"))).alias("a"), F.min(F.when(F.col("no"), F.col("_id"))).alias("b"), F.count_if(alone).alias("positives"), F.count_if("no").alias("negatives"))
    return firsts.where("a is not null and b is not null")


def temporal_outdated(rows: DataFrame, subject: list[str], at: str, text: str, key: str, days: int = 30, alike: float = 0.8) -> DataFrame:
    """(subject, a, b, days): rows at least ``days`` older than the subject's newest one that say something else."""
    newest = rows.groupBy(*subject).agg(F.max_by(F.struct(F.col(key).alias("b"), F.col(at).alias("_at"), F.col(text).alias("_text")), F.struct(at, key)).alias("_n")).select(*subject, "_n.*")
    both = rows.join(newest, subject).withColumn("days", F.floor((F.unix_timestamp(F.col("_at").cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))) / 86400).cast("int"))
    a, b = tokens(F.col(text)), tokens(F.col("_text"))
    differ = (F.size(a) == 0) | (F.size(b) == 0) | (jaccard(a, b) < alike)
    return both.where((F.col(key) != F.col("b")) & (F.col("days") >= days) & differ).select(*subject, F.col(key).alias("a"), "b", "days")


def conflict_candidates(new: DataFrame, facts: DataFrame) -> DataFrame:
    """(new_id, fact_id): current facts of a new fact's subject with the same or an opposite predicate, or the same object.

    Three equi-joins, so a subject's facts are not all compared with each other.
    """

    def shaped(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col("fact_id").alias(key), F.lower("subject").alias("subject"), normalise_predicate(F.col("predicate")).alias("predicate"), F.lower(F.col("object").cast("string")).alias("object"))

    asked, held = shaped(new, "new_id"), shaped(facts.where("is_current"), "fact_id")
    against = {}
    for p, q in OPPOSITES.items():
        against.setdefault(p, []).append(q)
        against.setdefault(q, []).append(p)
    related = F.concat(F.array("predicate"), F.coalesce(F.try_element_at(F.create_map(*[x for k, v in against.items() for x in (F.lit(k), F.lit(v))]), F.col("predicate")), F.array().cast("array<string>")))
    by_predicate = asked.withColumn("predicate", F.explode(related)).join(held, ["subject", "predicate"])
    by_object = asked.join(held.withColumnRenamed("predicate", "_p"), ["subject", "object"])
    return by_predicate.select("new_id", "fact_id").union(by_object.select("new_id", "fact_id")).where("new_id <> fact_id").distinct()


def typed(pairs: DataFrame, kind: str) -> DataFrame:
    """Pairs (a, b) with the type, severity, confidence and auto flag of a type of conflict."""
    severity, confidence, auto = TYPES[kind]
    return pairs.select("a", "b", F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(auto).alias("auto"))


def choose_strategy(kind: Column, severity: Column) -> Column:
    return F.when(severity == "critical", F.lit("user_guided")).otherwise(_pick(kind, DEFAULT_STRATEGY, "recency"))


def severity_rank(severity: Column) -> Column:
    return _pick(severity, {s: i for i, s in enumerate(SEVERITY_ORDER)}, len(SEVERITY_ORDER))


def _of(side: str, column: str) -> Column:
    return F.col(f"{side}.{column}")


def _rank(side: str) -> Column:
    return _pick(_of(side, "source"), SOURCE_RANK, 0)


def _days() -> Column:
    return F.abs(F.floor((F.unix_timestamp(_of("a", "created_at").cast("timestamp")) - F.unix_timestamp(_of("b", "created_at").cast("timestamp"))) / 86400))


def _gap(column: str) -> Column:
    return F.abs(_of("a", column) - _of("b", column))


#: Strategies by name: (whether the first of the pair wins, confidence).  Of equals the first wins, but for
#: recency the second.  Merge, keep-both and user-guided have no winner.
STRATEGIES: dict[str, tuple[Callable[[], Column] | None, Callable[[], Column]]] = {
    "recency": (lambda: _of("a", "created_at") > _of("b", "created_at"), lambda: F.least(F.lit(0.95), 0.5 + 0.01 * _days())),
    "confidence": (lambda: _of("a", "confidence") >= _of("b", "confidence"), lambda: F.least(F.lit(0.9), 0.5 + _gap("confidence"))),
    "source": (lambda: _rank("a") >= _rank("b"), lambda: 0.75 + 0.05 * F.abs(_rank("a") - _rank("b"))),
    "frequency": (lambda: _of("a", "access_count") >= _of("b", "access_count"), lambda: 0.6 + F.least(F.lit(0.3), 0.05 * _gap("access_count"))),
    "importance": (lambda: _of("a", "importance") >= _of("b", "importance"), lambda: F.least(F.lit(0.95), 0.6 + _gap("importance"))),
    "merge": (None, lambda: F.lit(0.7)),
    "keep_both": (None, lambda: F.lit(0.5)),
    "user_guided": (None, lambda: F.lit(0.0)),
}


def resolve(pairs: DataFrame, facts: DataFrame, strategy: str | None = None) -> DataFrame:
    """(a, b, strategy, action, winner, loser, confidence) of every pair.

    The strategy is the given one, else the column ``strategy`` of each pair.
    """
    named = pairs.select("a", "b", F.lit(strategy).alias("strategy") if strategy else "strategy")
    ids = named.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "strategy")
    joined = ids.join(facts.alias("a"), F.col("_a") == F.col("a.fact_id")).join(facts.alias("b"), F.col("_b") == F.col("b.fact_id"))
    a, b = F.col("_a"), F.col("_b")
    wins, confidence = F.when(F.lit(False), F.lit(True)), F.when(F.lit(False), F.lit(0.0))
    for name, (first, sure) in STRATEGIES.items():
        mine = F.col("strategy") == name
        wins = wins.when(mine, F.coalesce(first(), F.lit(name != "recency")) if first else F.lit(None).cast("boolean"))
        confidence = confidence.when(mine, F.coalesce(sure().cast("double"), F.lit(0.5)))
    action = F.when(F.col("_wins").isNotNull(), F.when(F.col("_wins"), "keep_a").otherwise("keep_b")).otherwise(_pick(F.col("strategy"), {"merge": "merge", "keep_both": "keep_both"}, "defer"))
    placed = joined.select(a.alias("a"), b.alias("b"), "strategy", wins.alias("_wins"), confidence.alias("confidence"))
    return placed.select("a", "b", "strategy", action.alias("action"), F.when(F.col("_wins"), F.col("a")).when(~F.col("_wins"), F.col("b")).alias("winner"), F.when(F.col("_wins"), F.col("b")).when(~F.col("_wins"), F.col("a")).alias("loser"), "confidence")


def apply_resolutions(facts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Facts with ``status``: kept, conflicted (both of a kept pair) or merged (both archived); the losers are gone."""
    lost = resolutions.where("loser is not null").select(F.col("loser").alias("fact_id")).distinct()
    sides = F.explode(F.array("a", "b"))
    marked = resolutions.where("action in ('keep_both', 'merge')").select(sides.alias("fact_id"), F.when(F.col("action") == "merge", "merged").otherwise("conflicted").alias("_mark")).groupBy("fact_id").agg(F.max("_mark").alias("_mark"))
    return facts.join(lost, "fact_id", "left_anti").join(marked, "fact_id", "left").withColumn("status", F.coalesce("_mark", F.lit("kept"))).drop("_mark")


def fold_updates(facts: DataFrame, order: list[str]) -> DataFrame:
    """Facts taken in order of time: (fact_id, outcome, supersedes, superseded_by, is_current).

    An exclusive predicate has one object at a time; a predicate and its opposite have one of the two for an
    object; any other fact is told once.  A fact that says again what holds is a duplicate.
    """
    predicate = normalise_predicate(F.col("predicate"))
    low = F.lower(F.col("object").cast("string"))
    exclusive = predicate.isin(EXCLUSIVE_PREDICATES)
    family = F.coalesce(*[F.when(predicate.isin(q, *[p for p, o in OPPOSITES.items() if o == q]), F.lit(q)) for q in sorted(set(OPPOSITES.values()))], predicate)
    opposed = predicate.isin([*OPPOSITES, *OPPOSITES.values()])
    axis = F.when(exclusive, predicate).otherwise(F.concat_ws(":", family, low))
    value = F.when(exclusive, low).when(opposed, (predicate == family).cast("string")).otherwise(F.lit("said"))
    line = Window.partitionBy("_who", "_axis").orderBy(*order)
    rows = facts.withColumns({"_who": F.lower("subject"), "_axis": axis, "_value": value})
    rows = rows.withColumn("_before", F.lag("_value").over(line)).withColumn("_again", F.col("_before").eqNullSafe(F.col("_value")))
    told = rows.where("not _again")
    linked = told.withColumns({"supersedes": F.lag("fact_id").over(line), "superseded_by": F.lead("fact_id").over(line)})
    linked = linked.select("fact_id", F.when(F.col("supersedes").isNull(), "new").otherwise("supersedes").alias("outcome"), "supersedes", "superseded_by", F.col("superseded_by").isNull().alias("is_current"))
    none = F.lit(None).cast("long")
    return linked.unionByName(rows.where("_again").select("fact_id", F.lit("duplicate").alias("outcome"), none.alias("supersedes"), none.alias("superseded_by"), F.lit(False).alias("is_current")))
