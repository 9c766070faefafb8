"""Ranked lexical search by NRA: impact-sorted lists read in order, no random access.

Documents stay where Spark has them.  A task indexes its documents in segments of
bounded text; a segment has, for every term that some item asks for, a list of
(impact, document) sorted by falling impact.  For an item the lists of its terms
are read side by side, a block at a time.  A document that has been met has a
lower bound (the impacts read) and an upper bound (plus, for each list it was not
met in, the impact at that list's reading position).  Reading goes on until no
unseen document can enter, every document that could still be among the best
has equal bounds, and so membership, ties and scores are final.  The k-th score
that the task has found already is where the next segment starts from.

Only the best k of an item leave a task.  The statistics that weights need (number of
documents, their terms, documents of each term asked for) are counted in one
earlier pass over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_CHARS = 4_000_000  # of item texts that are searched in one pass
SEGMENT_BYTES = 8 << 20  # of text that a segment indexes; one longer text is a segment of its own
READ = 64  # postings read from each list in the first round; later rounds double it
SALTS = 16
#: Letters, digits and all that is not ASCII make terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, as UTF-8; a null has none."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


class Segment:
    """Impact-sorted lists over some documents.

    ``postings`` are (term, document, impact) arrays; documents are numbered so that
    equal scores rank by rising number.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, documents: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.documents = doc[order], impact[order], documents
        self.term, self.first = np.unique(term[order], return_index=True)
        self.end = np.append(self.first[1:], len(order))

    def search(self, asked: Sequence[tuple[int, int]], k: int, floor: int = 0) -> list[tuple[int, int]]:
        """(score, document), best first, of the best k with a score above 0 and not under ``floor``.

        ``asked`` are (term, how often the item has it).
        """
        have = [(int(at), times) for t, times in asked if (at := np.searchsorted(self.term, t)) < len(self.term) and self.term[at] == t]
        if not have:
            return []
        first = np.array([self.first[i] for i, _ in have])
        end = np.array([self.end[i] for i, _ in have])
        times = np.array([n for _, n in have], dtype=np.int64)
        at = first.copy()
        lower = np.zeros(self.documents, dtype=np.int64)
        unread = np.zeros((self.documents, len(have)), dtype=bool)  # of the documents met: lists they may still be in
        met = np.zeros(self.documents, dtype=bool)
        alive = np.zeros(0, dtype=np.int64)
        size = READ
        floor = max(1, floor)
        while True:
            fresh = []
            for j in range(len(have)):
                if at[j] < end[j]:
                    stop = min(at[j] + size, end[j])
                    docs = self.doc[at[j] : stop]
                    new = docs[~met[docs]]
                    met[new] = True
                    unread[new] = True
                    fresh.append(new)
                    lower[docs] += self.impact[at[j] : stop] * times[j]
                    unread[docs, j] = False
                    at[j] = stop
            size *= 2
            # the most that a list can still give
            rest = np.where(at < end, self.impact[np.minimum(at, end - 1)], 0) * times
            alive = np.concatenate([alive, *fresh])
            low = lower[alive]
            if len(low) >= k:
                floor = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]))
            # those that an open list may still raise, by the most it could give
            high = low + unread[alive] @ rest
            keep = high >= floor
            alive, low, high = alive[keep], low[keep], high[keep]
            if rest.sum() < floor and (low == high).all():
                best = np.lexsort((alive, -low))[:k]
                return [(int(low[i]), int(alive[i])) for i in best]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(len(batch)):
            yield ids[i].as_py(), terms(texts[i].as_py())


def _count(wanted: dict[bytes, int]):
    """Per task: (term, documents), and under -1 and -2 the documents with terms and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for _, words in _documents(batches):
            if words:
                counts[-1] += 1
                counts[-2] += len(words)
                counts.update(wanted[w] for w in set(words) if w in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def _best(wanted: dict[bytes, int], weights: dict[int, int], items: list[list[tuple[int, int]]], documents: int, total: int, k: int, kind: pa.DataType):
    """Per task: (item, doc_id, score) of the best k documents of each item."""

    def indexed(rows: list[tuple[object, list[bytes]]]) -> tuple[list, Segment]:
        rows = sorted(rows, key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0]))
        term, doc, impact = [], [], []
        for number, (_, words) in enumerate(rows):
            m = 25 + (75 * len(words) * documents) // total
            for t, tf in Counter([wanted[w] for w in words if w in wanted]).items():
                value = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                if value > 0:
                    term.append(t)
                    doc.append(number)
                    impact.append(value)
        return [r[0] for r in rows], Segment(np.array(term, np.int64), np.array(doc, np.int64), np.array(impact, np.int64), len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in items]

        def add(rows) -> None:
            ids, segment = indexed(rows)
            if not len(segment.term):
                return
            for number, asked in enumerate(items):
                have = best[number]
                found = segment.search(asked, k, have[-1][0] if len(have) == k else 0)
                if found:
                    have.extend((score, ids[doc]) for score, doc in found)
                    have.sort(key=lambda r: (-r[0], r[1] is not None, 0 if r[1] is None else r[1]))
                    del have[k:]

        rows, size = [], 0
        for row in _documents(batches):
            if row[1]:
                rows.append(row)
                size += sum(map(len, row[1]))
                if size >= SEGMENT_BYTES:
                    add(rows)
                    rows, size = [], 0
        if rows:
            add(rows)
        out = [(number, doc, score) for number, have in enumerate(best) for score, doc in have]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of every item, equal scores by rising ``doc_id``.

    With N documents that have terms, L terms in all of them, n in one, df documents
    of a term and tf of its occurrences in one: ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``,
    ``m = 25 + 75 n N div L``, and a document scores the sum over the item's terms, repeats
    included, of ``w * (10**9 tf div (1000 tf + 8 m))``.  Documents that score 0 are not ranked.

    Items are a query set: they pass the driver in blocks of about ``BLOCK_CHARS``
    characters, each searched in one pass over all documents.  ``doc_id`` may have any
    type that sorts.  A null text has no terms; an item without terms has no rows.
    Every row of either table counts on its own: repeated documents are ranked as often as
    they occur, one item_id in two rows has two rankings, and a null doc_id ranks before others
    of equal score.  Empty tables give an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    id_kind, item_kind = dict(rows.dtypes)["doc_id"], dict(asked.dtypes)["item_id"]
    chars = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    out = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect() if blocks > 1 else asked.collect()
        found = _search_block(rows, [(r.item_id, terms(r.text)) for r in block], k, id_kind, item_kind)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(rows: DataFrame, items: list[tuple[object, list[bytes]]], k: int, id_kind: str, item_kind: str) -> DataFrame:
    spark = rows.sparkSession
    wanted = {t: i for i, t in enumerate(sorted({t for _, words in items for t in words}))}
    counts = dict(tuple(r) for r in rows.mapInArrow(_count(wanted), "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents, total = counts.pop(-1, 0), counts.pop(-2, 0)
    weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in wanted.values()}
    asked = [sorted(Counter(wanted[w] for w in words).items()) for _, words in items]
    found = rows.mapInArrow(_best(wanted, weights, asked, documents, total, k, to_arrow_type(rows.schema["doc_id"].dataType)), f"item long, doc_id {id_kind}, score long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    # the best of many tasks meet in two steps, so an item's share of one task stays small
    found = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item long, item_id {item_kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
