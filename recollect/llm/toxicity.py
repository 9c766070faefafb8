"""Toxicity scorer: a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words, all of which are scored; its
score is that of its worst window.  Each word enters with a word input (hashed
word) and a character input (hashed character n-grams of the marked word): for
both a log-odds weight estimated on the labelled rows and a small trained
embedding.  The network is trained here in numpy by back-propagation through
time, on the worst window of every labelled text (multiple-instance learning).

At most ``max_rows`` labelled texts come to the driver for training; scoring runs
in Arrow batches inside the tasks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import BASES, Words, chunks, mix, spans, windows
from recollect.llm.quality_rules import sampled

WINDOW, STRIDE = 48, 32
BITS = 16  # hashed inputs: 65,536 words and as many n-grams
GRAMS = (3, 6, 8)  # bytes, the marks at both ends of a word included; every word has one of the least
PIECE = 64  # bytes; a longer word enters as pieces of so many
EMBED, HIDDEN = 4, 8
WORD_DROPOUT = 0.4  # share of words whose word input is hidden in a training step
BLOCK = 4096  # windows scored at once


def _steps(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The lower-cased words of some texts, a long word in pieces that overlap by the longest n-gram.

    So no byte and no n-gram of a text without blanks is left out.
    """
    words = Words(data, offsets, lower=True)
    stride = PIECE - max(GRAMS)
    count = 1 + np.maximum(0, -(-(words.ends - words.starts - PIECE) // stride))
    if (count > 1).any():
        word = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        ends = words.ends[word]
        words.starts = words.starts[word] + number * stride
        words.ends = np.minimum(words.starts + PIECE, ends)
        words.text_of = words.text_of[word]
        words.first = np.searchsorted(words.starts, words.offsets)
    return words


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Vocabulary:
    """Distinct words of some texts as hashed slots; grams[bounds[i]:bounds[i+1]] belong to word i."""

    hashes: np.ndarray
    word: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray

    def part(self, some: np.ndarray) -> Vocabulary:
        """The vocabulary of some of the words."""
        sizes = self.bounds[some + 1] - self.bounds[some]
        cut = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.bounds[some] - cut[:-1], sizes) + np.arange(cut[-1])
        return Vocabulary(self.hashes[some], self.word[some], self.grams[at], cut)

    @classmethod
    def merged(cls, parts: list[Vocabulary]) -> Vocabulary:
        """One vocabulary, in order of hash, that holds each word of the parts once."""
        hashes = np.concatenate([p.hashes for p in parts])
        cuts = np.cumsum([0, *(len(p.grams) for p in parts)])
        whole = cls(hashes, np.concatenate([p.word for p in parts]), np.concatenate([p.grams for p in parts]), np.append(np.concatenate([p.bounds[:-1] + c for p, c in zip(parts, cuts[:-1], strict=True)]), cuts[-1]))
        return whole.part(np.unique(hashes, return_index=True)[1])

    @classmethod
    def of(cls, words: Words) -> tuple[Vocabulary, np.ndarray]:
        """The vocabulary, and the number in it of each word."""
        hashes = words.hashes()
        unique, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        starts, ends = words.starts[first], words.ends[first]
        length = ends - starts
        # each word between two marks, in one buffer, so that n-grams see where it begins and ends
        begin = np.concatenate([[0], np.cumsum(length + 2)])
        owner = np.repeat(np.arange(len(unique)), length + 2)
        inner = np.arange(begin[-1]) - begin[owner] - 1
        mark = (inner < 0) | (inner >= length[owner])
        marked = np.where(mark, 1, words.data[np.minimum(starts[owner] + np.maximum(inner, 0), max(len(words.data) - 1, 0))]).astype(np.uint64) if len(unique) else np.zeros(0, np.uint64)
        slots, owners = [], []
        for n in GRAMS:
            values = windows(marked, n, BASES[1])
            inside = owner[: len(values)] == owner[n - 1 :] if len(values) else np.zeros(0, dtype=bool)
            slots.append(_slots(mix(values[inside] + np.uint64(n))))
            owners.append(owner[: len(values)][inside])
        slots, owners = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return cls(unique, _slots(unique), slots[order], np.searchsorted(owners[order], np.arange(len(unique) + 1))), number


def _pool(values: np.ndarray, bounds: np.ndarray, op) -> np.ndarray:
    """op.reduceat over each non-empty range; every word has a gram, as it is marked."""
    return op.reduceat(values, bounds[:-1], axis=0) if len(bounds) > 1 else values[:0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    word_odds: np.ndarray
    gram_odds: np.ndarray
    base: float  # score of a text without words
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, word_odds: np.ndarray, gram_odds: np.ndarray, base: float, rng: np.random.Generator) -> Network:
        inputs = 2 + 2 * EMBED

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {"word": normal(1 << BITS, EMBED, scale=0.05), "gram": normal(1 << BITS, EMBED, scale=0.05)}
        for d in "fb":
            w |= {f"x{d}": normal(inputs, 3 * HIDDEN, scale=0.4), f"h{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        w |= {"attend": normal(2 * HIDDEN, scale=0.5), "out": normal(2 * HIDDEN, scale=0.5), "bias": np.full(1, -1.0, np.float32)}
        return cls(word_odds.astype(np.float32), gram_odds.astype(np.float32), base, w)

    def inputs(self, vocabulary: Vocabulary) -> np.ndarray:
        """One input row for each word of the vocabulary, and a last row for padding."""
        out = np.zeros((len(vocabulary.word) + 1, 2 + 2 * EMBED), np.float32)
        for i in range(0, len(vocabulary.word), 1 << 15):
            word, bounds = vocabulary.word[i : i + (1 << 15)], vocabulary.bounds[i : i + (1 << 15) + 1]
            grams, bounds = vocabulary.grams[bounds[0] : bounds[-1]], bounds - bounds[0]
            rows = out[i : i + len(word)]
            rows[:, 0] = self.word_odds[word]
            rows[:, 1] = _pool(self.gram_odds[grams], bounds, np.maximum)
            rows[:, 2 : 2 + EMBED] = self.weights["word"][word]
            rows[:, 2 + EMBED :] = _pool(self.weights["gram"][grams], bounds, np.add) / np.diff(bounds)[:, None]
        return out

    def _direction(self, d: str, projected: np.ndarray, at: np.ndarray, real: np.ndarray, keep: bool):
        """States over time; padding keeps the state.  at: windows x steps, numbers of inputs."""
        n, steps = at.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        trace = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, u = projected[at[:, t]], h @ self.weights[f"h{d}"]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            z = z * real[:, t, None]
            new = h + z * (c - h)
            if keep:
                trace.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, trace

    def forward(self, table: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; at holds numbers of rows of ``table`` (the last is padding)."""
        real = (at != len(table) - 1).astype(np.float32)
        both, traces = [], {}
        for d in "fb":
            states, traces[d] = self._direction(d, table @ self.weights[f"x{d}"] + self.weights[f"c{d}"], at, real, keep)
            both.append(states)
        states = np.concatenate(both, axis=2)
        energy = states @ self.weights["attend"] + (real.T - 1) * 1e4
        energy -= energy.max(axis=0)
        attention = np.exp(energy)
        attention /= attention.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", attention, states)
        logits = pooled @ self.weights["out"] + self.weights["bias"]
        return (logits, states, attention, pooled, traces, real) if keep else logits

    def gradients(self, table: np.ndarray, at: np.ndarray, labels: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean log loss by weight, and by row of ``table``."""
        logits, states, attention, pooled, traces, real = self.forward(table, at, keep=True)
        error = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        g = {"out": pooled.T @ error, "bias": error.sum(keepdims=True)}
        d_pooled = error[:, None] * self.weights["out"]
        d_attention = np.einsum("nh,tnh->tn", d_pooled, states)
        d_energy = attention * (d_attention - (attention * d_attention).sum(axis=0))
        g["attend"] = np.einsum("tn,tnh->h", d_energy, states)
        d_states = attention[:, :, None] * d_pooled + d_energy[:, :, None] * self.weights["attend"]
        d_table = np.zeros_like(table)
        for k, d in enumerate("fb"):
            part = d_states[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            wx, wh = self.weights[f"x{d}"], self.weights[f"h{d}"]
            g[f"h{d}"], d_projected, carry = np.zeros_like(wh), np.zeros((len(table), 3 * HIDDEN), np.float32), 0
            for t, h, z, r, c, u in reversed(traces[d]):
                total = part[t] + carry
                d_c = total * z * (1 - c * c)
                d_z = total * (c - h) * z * (1 - z) * real[:, t, None]
                d_r = d_c * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
                g[f"h{d}"] += h.T @ d_u
                carry = total * (1 - z) + d_u @ wh.T
                np.add.at(d_projected, at[:, t], np.concatenate([d_z, d_r, d_c], axis=1))
            d_projected[-1] = 0
            g[f"x{d}"], g[f"c{d}"] = table.T @ d_projected, d_projected.sum(axis=0)
            d_table += d_projected @ wx.T
        return g, d_table


def window_places(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of overlapping windows that cover each text's words first[i]:first[i+1]."""
    n = np.diff(first)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - window) // stride)))
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[:-1][text] + number * stride


def _grid(number: np.ndarray, start: np.ndarray, end: np.ndarray, padding: int) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], number[np.minimum(at, max(len(number) - 1, 0))], padding)


def _scores(network: Network, words: Words) -> np.ndarray:
    """The score of every text."""
    out = np.full(words.texts, -np.inf)
    if len(words.starts):
        vocabulary, number = Vocabulary.of(words)
        table = network.inputs(vocabulary)
        text, start = window_places(words.first)
        for i in range(0, len(text), BLOCK):
            some = text[i : i + BLOCK]
            logits = network.forward(table, _grid(number, start[i : i + BLOCK], words.first[some + 1], len(table) - 1))
            np.maximum.at(out, some, logits)
    return np.where(np.isinf(out), network.base, _sigmoid(out))


class _Odds:
    """Log-odds of label 1 for texts with each slot; few texts shrink it to 0."""

    def __init__(self, shrink: float):
        self.shrink, self.texts = shrink, np.zeros((2, 1 << BITS))

    def add(self, slot: np.ndarray, text: np.ndarray, labels: np.ndarray) -> None:
        pairs = np.unique(slot.astype(np.int64) << 32 | text)
        y = labels[pairs & 0xFFFFFFFF]
        for k in (0, 1):
            self.texts[k] += np.bincount((pairs >> 32)[y == k], minlength=1 << BITS)

    def values(self, labels: np.ndarray) -> np.ndarray:
        rates = [(self.texts[k] + 0.5) / ((labels == k).sum() + 1) for k in (0, 1)]
        seen = self.texts.sum(axis=0)
        return np.clip(np.log(rates[1] / rates[0]), -4, 4) * seen / (seen + self.shrink)


def fit_network(texts: list[str | None], labels: np.ndarray, steps: int = 160, batch: int = 256, rate: float = 0.01, seed: int = 11) -> Network:
    """Train on whole texts with labels 0 and 1; without both labels the score is constant.

    ``steps`` batches at least, in whole epochs; each epoch begins by choosing the
    worst window of every text anew.
    """
    rng, labels = np.random.default_rng(seed), np.asarray(labels)
    base = float((labels.sum() + 0.5) / (len(labels) + 1))  # .5 without any
    parts, hashes, sizes, odds = [], [], [], (_Odds(8), _Odds(20))
    for row, end, data, offsets in chunks(pa.array([t or "" for t in texts], pa.large_string())):
        words = _steps(data, offsets)
        vocabulary, number = Vocabulary.of(words)
        pairs = np.unique(words.text_of << 32 | number)
        of_word = vocabulary.part(pairs & 0xFFFFFFFF)
        of_text = pairs >> 32
        odds[0].add(of_word.word, of_text, labels[row:end])
        odds[1].add(of_word.grams, np.repeat(of_text, np.diff(of_word.bounds)), labels[row:end])
        parts.append(vocabulary)
        hashes.append(vocabulary.hashes[number])
        sizes.append(np.diff(words.first))
    if not any(map(len, hashes)) or len(set(labels.tolist())) < 2:
        network = Network.new(np.zeros(1 << BITS), np.zeros(1 << BITS), base, rng)
        network.weights["out"][:] = 0
        network.weights["bias"][:] = np.log(base / (1 - base))
        return network
    vocabulary = Vocabulary.merged(parts)
    number = np.searchsorted(vocabulary.hashes, np.concatenate(hashes)).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    del parts, hashes
    network = Network.new(odds[0].values(labels), odds[1].values(labels), base, rng)
    text, start = window_places(first)
    end = first[text + 1]
    slow = {k: np.zeros_like(v) for k, v in network.weights.items()}
    fast = {k: np.zeros_like(v) for k, v in network.weights.items()}
    bounds = np.searchsorted(text, np.arange(len(first)))
    filled = np.flatnonzero(np.diff(bounds))
    epochs = -(-steps // max(1, -(-len(filled) // batch)))
    step = 0
    for epoch in range(epochs):
        table = network.inputs(vocabulary)
        if epoch == 0:  # before any training the window with the largest odds stands for its text
            odds = np.append(table[:, 0] + table[:, 1], 0)
            logits = np.concatenate([odds[_grid(number, start[i : i + BLOCK], end[i : i + BLOCK], len(table) - 1)].max(axis=1) for i in range(0, len(text), BLOCK)])
        else:
            logits = np.concatenate([network.forward(table, _grid(number, start[i : i + BLOCK], end[i : i + BLOCK], len(table) - 1)) for i in range(0, len(text), BLOCK)])
        order = np.lexsort((logits, text))
        worst = order[bounds[filled + 1] - 1]
        for some in np.array_split(rng.permutation(worst), max(1, -(-len(worst) // batch))):
            used, back = np.unique(_grid(number, start[some], end[some], len(table) - 1), return_inverse=True)
            back = back.reshape(len(some), WINDOW)
            used = used[used < len(table) - 1]
            shown = vocabulary.part(used)
            rows = network.inputs(shown)
            hidden = np.flatnonzero(rng.random(len(used)) < WORD_DROPOUT)  # these words show their characters only
            rows[hidden, 0], rows[hidden, 2 : 2 + EMBED] = 0, 0
            g, d_rows = network.gradients(rows, back, labels[text[some]])
            d_rows = d_rows[:-1]
            d_rows[hidden, 2 : 2 + EMBED] = 0
            g["word"], g["gram"] = np.zeros_like(network.weights["word"]), np.zeros_like(network.weights["gram"])
            np.add.at(g["word"], shown.word, d_rows[:, 2 : 2 + EMBED])
            grams = np.diff(shown.bounds)
            np.add.at(g["gram"], shown.grams, np.repeat(d_rows[:, 2 + EMBED :] / grams[:, None], grams, axis=0))
            step += 1
            for k, w in network.weights.items():  # Adam
                slow[k] += 0.1 * (g[k] - slow[k])
                fast[k] += 0.001 * (g[k] ** 2 - fast[k])
                w -= rate * (slow[k] / (1 - 0.9**step)) / (np.sqrt(fast[k] / (1 - 0.999**step)) + 1e-8)
    return network


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_out: int = 0, max_rows: int = 5000) -> Network:
    """Fit on at most ``max_rows`` labelled texts outside the held-out fold, chosen by hash of the id.

    Rows without an id or a label are left aside; with several labels for an id the
    largest counts, with several texts the least.  Empty tables give a constant score.
    """
    rows = sampled(docs, labels, label, folds, held_out, max_rows).toPandas().sort_values("doc_id")
    return fit_network(rows["text"].tolist(), rows["_label"].to_numpy(dtype=np.int64))


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            scores = [_scores(network, _steps(data, offsets)) for _, _, data, offsets in chunks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, network: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score from 0 to 1) for every row: the score of its worst window.

    A null, empty or blank text has no window and gets the share of toxic rows
    among the labelled ones.  Every text is scored whole and alone, so repeated
    rows score alike; an empty table gives an empty result.  Other columns are
    not read.  A word of over 64 bytes counts as several, overlapping pieces of
    64 bytes, so texts without blanks are scored whole too.
    """
    kind = dict(docs.dtypes)[doc_id]
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_score_rows(shared), f"doc_id {kind}, score double")
