"""Intent of a question (a short text) from keywords and patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intent, weight, keywords (a substring counts 1), patterns (a match counts 1.5).
INTENTS = [
    ("factual", 1.0, ["what is", "what are", "how does", "explain", "define", "meaning of", "tell me about", "describe"], ["what .* mean", "how .* work"]),
    ("episodic_recall", 1.0, ["remember", "last time", "when did", "what happened", "previously", "before", "earlier", "history", "past"], ["when .* we", "do you remember", "what did .* say"]),
    ("preference", 1.0, ["prefer", "like", "favorite", "my settings", "i want", "i need", "my preference", "usually", "always use"], ["do i .*", "what do i .*", "my .*"]),
    ("procedural", 1.0, ["how to", "how do i", "steps to", "guide", "tutorial", "instructions", "process", "procedure", "way to"], ["how .* do", "steps .* to", "can you show"]),
    ("context", 0.8, ["continue", "as i said", "we were", "going back to", "about that", "regarding", "the", "this", "that"], ["as .* mentioned", "like .* said"]),
    ("problem_solving", 1.2, ["fix", "debug", "error", "problem", "issue", "broken", "not working", "fails", "exception", "bug", "solve"], ["how .* fix", "why .* not", ".*error.*"]),
    ("creative", 0.9, ["suggest", "recommend", "ideas", "brainstorm", "creative", "alternative", "options", "possibilities", "imagine"], ["what .* suggest", "can you .* ideas"]),
    ("comparison", 1.0, ["compare", "difference", "versus", "vs", "better", "which one", "pros and cons", "similarities"], ["compare .* and", ".* vs .*", "difference between"]),
]


def intent_scores(text: Column) -> Column:
    """An array of (score, order, intent)."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = []
    for i, (name, weight, keywords, patterns) in enumerate(INTENTS):
        total = F.lit(0.0)
        for k in keywords:
            total = total + F.contains(lower, F.lit(k)).cast("int")
        for p in patterns:
            total = total + 1.5 * lower.rlike(p).cast("int")
        out.append(F.struct((total * weight).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent")))
    return F.array(*out)


def classify_intent(text: Column) -> Column:
    """(intent, confidence): the best intent with min(1, score / 3), or general with 0.3."""
    best = F.array_max(intent_scores(text))
    found = best["score"] > 0
    return F.struct(F.when(found, best["intent"]).otherwise("general").alias("intent"), F.when(found, F.least(F.lit(1.0), best["score"] / 3)).otherwise(0.3).alias("confidence"))


# Of each intent the tiers to search, best first, and the weights of recency, importance and similarity.
PROFILES = {
    "factual": (["semantic", "episodic"], (0.2, 0.3, 0.8)),
    "episodic_recall": (["episodic", "short_term"], (0.7, 0.4, 0.6)),
    "preference": (["semantic", "episodic"], (0.8, 0.6, 0.5)),
    "procedural": (["semantic"], (0.3, 0.4, 0.9)),
    "context": (["short_term", "episodic"], (0.9, 0.3, 0.7)),
    "problem_solving": (["episodic", "semantic"], (0.5, 0.7, 0.8)),
    "creative": (["semantic", "episodic"], (0.3, 0.5, 0.6)),
    "comparison": (["semantic"], (0.2, 0.4, 0.9)),
    "general": (["semantic", "episodic", "short_term"], (0.5, 0.5, 0.7)),
}


def plan(text: Column, context: Column | None = None) -> Column:
    """struct(intent, confidence, secondary, tiers, recency, importance, similarity) of a question.

    With a context, the context intent counts 1.3 times, or 0.3 if nothing speaks for it.
    """
    return F.get(F.transform(F.array(intent_scores(text)), lambda scored: _planned(scored, context)), F.lit(0))  # an element is worked out once


def _planned(scored: Column, context: Column | None) -> Column:
    if context is not None:
        lifted = F.transform(scored, lambda s: s.withField("score", F.when((s["intent"] == "context") & context.isNotNull(), F.when(s["score"] > 0, s["score"] * 1.3).otherwise(0.3)).otherwise(s["score"])))
        scored = lifted
    ranked = F.reverse(F.array_sort(F.filter(scored, lambda s: s["score"] > 0)))
    return F.get(F.transform(F.array(ranked), _chosen), F.lit(0))


def _chosen(found: Column) -> Column:
    best = F.try_element_at(found, F.lit(1))
    intent = F.coalesce(best["intent"], F.lit("general"))
    others = F.filter(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda s: s["score"] > 0.5)
    choice = F.lit(None)
    for k, (tiers, w) in PROFILES.items():
        values = F.struct(F.lit(tiers).alias("tiers"), *[F.lit(v).alias(n) for n, v in zip(("recency", "importance", "similarity"), w, strict=True)])
        choice = F.when(intent == k, values).otherwise(choice)
    confidence = F.coalesce(F.least(F.lit(1.0), best["score"] / 3), F.lit(0.3))
    secondary = F.transform(F.slice(others, 1, 2), lambda s: s["intent"])
    planned = F.struct(intent.alias("intent"), confidence.alias("confidence"), secondary.alias("secondary"), choice.alias("profile"))
    return F.get(F.transform(F.array(planned), lambda p: F.struct(*[p[n].alias(n) for n in ("intent", "confidence", "secondary")], *[p["profile"][n].alias(n) for n in ("tiers", "recency", "importance", "similarity")])), F.lit(0))
