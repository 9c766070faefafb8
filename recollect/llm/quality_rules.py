"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on resampled labelled rows; every path from a root is a
conjunctive rule over the statistics.  Lasso logistic regression keeps a few of
the rules, and the kept ones are compiled into one Spark column expression, so a
score is a projection: no Python, shuffle or join per text.

The statistics of a bounded sample of labelled rows (``max_rows``, chosen by hash
of the id) come to the driver as numbers; the texts do not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Numbers that describe a text; a null counts as an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n = F.size(words)

    def share(keep: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{keep}]+", "")) / F.greatest(chars, F.lit(1))

    lines = chars - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return {
        "chars": chars.cast("double"),
        "words": n.cast("double"),
        "word_length": chars / F.greatest(n, F.lit(1)),
        "words_a_line": n / lines,
        "distinct_words": F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        "upper": share("A-Z"),
        "digits": share("0-9"),
        "symbols": share("#$%&*<>{}=~^@\\\\/_+\\[\\]"),
        "shouts": share("!?"),
        "bars": share("|;:"),
        "stops": share(".,"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold), with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, above, at in self.terms:
            one = values[name] > at if above else values[name] <= at
            out = one if out is None else out & one
        return out

    def column(self, columns: dict[str, Column]) -> Column:
        out = None
        for name, above, at in self.terms:
            one = columns[name] > F.lit(at) if above else columns[name] <= F.lit(at)
            out = one if out is None else out & one
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...]

    def logits(self, values: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(values.values())))
        return np.full(n, self.bias) + sum((r.weight * r.holds(values) for r in self.rules), np.zeros(n))

    def column(self, columns: dict[str, Column]) -> Column:
        """The score in (0, 1) as a column expression."""
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(columns)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int, least: int, rng: np.random.Generator, terms=()) -> list[tuple]:
    """Every path of one greedy Gini tree over the rows x, as rule terms."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return []
    best = None
    for j in rng.permutation(len(names))[: max(3, 2 * len(names) // 3)]:
        for at in cuts[j]:
            above = x[:, j] > at
            m = int(above.sum())
            if m < least or len(y) - m < least:
                continue
            p, q = y[above].mean(), y[~above].mean()
            impurity = m * p * (1 - p) + (len(y) - m) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, j, float(at), above)
    if best is None:
        return []
    _, j, at, above = best
    out = []
    for side in (True, False):
        here = (*terms, (names[j], side, at))
        rows = above if side else ~above
        out += [here, *_paths(x[rows], y[rows], names, cuts, depth - 1, least, rng, here)]
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Lasso logistic weights by accelerated proximal gradient; the bias is free."""
    n, m = z.shape
    bias, w = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(m)
    vb, v, t = bias, w.copy(), 1.0
    step = 4.0 * n / (np.linalg.norm(np.column_stack([np.ones(n), z]), 2) ** 2 + 1e-9)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(vb + z @ v))) - y
        new_b = vb - step * error.mean()
        new_w = v - step * (z.T @ error) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = new_b + (t - 1) / t2 * (new_b - bias), new_w + (t - 1) / t2 * (new_w - w)
        bias, w, t = new_b, new_w, t2
    return bias, w


def fit_rules(values: dict[str, np.ndarray], labels: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Fit the ensemble; without both labels it is a constant."""
    y = np.asarray(labels, dtype=float)
    if not len(y) or y.min() == y.max():
        base = 0.5 if not len(y) else float(y[0])
        return RuleEnsemble(float(np.log((base + 1e-3) / (1 - base + 1e-3))), ())
    rng, names = np.random.default_rng(seed), sorted(values)
    x = np.column_stack([values[n] for n in names]).astype(float)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(len(names))]
    terms: dict[tuple, None] = {}
    for _ in range(trees):
        rows = rng.integers(0, len(y), min(len(y), 2000))
        for path in _paths(x[rows], y[rows], names, cuts, depth, max(5, len(rows) // 200), rng):
            terms[path] = None
    rules = [Rule(t, 1.0) for t in terms]
    z = np.column_stack([r.holds(values) for r in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    bias, w = _lasso(z[:, first], y, penalty)
    return RuleEnsemble(float(bias), tuple(Rule(rules[i].terms, float(c)) for i, c in zip(first, w, strict=True) if abs(c) > 1e-6))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1, max_rows: int = 4000) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled ids outside the held-out fold.

    Rows without an id, a label or a text to match are left aside; with several
    labels for an id the largest counts, with several texts the least.  Empty tables
    give a constant score.
    """
    columns = statistics(F.col("text"))
    rows = sampled(docs, labels, label, folds, held_out, max_rows).select("doc_id", "_label", *[c.alias(n) for n, c in columns.items()])
    table = rows.toPandas().sort_values("doc_id")
    return fit_rules({n: table[n].to_numpy(dtype=float) for n in columns}, table["_label"].to_numpy())


def sampled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, text, _label) of at most ``max_rows`` labelled ids, chosen by hash: one row an id, however often it repeats."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("doc_id is not null and _label is not null")
    known = known.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("_label").alias("_label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))


def score_quality(docs: DataFrame, ensemble: RuleEnsemble, name: str = "score", text: str = "text") -> DataFrame:
    """The rows with the score of their text (0 to 1; higher: label 1 likelier).

    Null and empty texts get a score as well.  Each row is scored alone, so
    repeated rows score alike and an empty table stays empty; an existing column
    called ``name`` is replaced, all others stay, whatever their names.
    """
    prefix = "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    made = {prefix + n: c for n, c in statistics(F.col(text)).items()}
    return docs.withColumns(made).withColumn(name, ensemble.column({n.removeprefix(prefix): F.col(n) for n in made})).drop(*made)
