"""Substring de-duplication by Rabin-Karp hashes of every fixed-length word window.

1. Every window of ``size`` words is hashed.  The window's *anchor* is the least
   hash among the shorter windows of ``anchor`` words inside it, so equal windows
   have equal anchors.  Anchors (about one word in fourteen) are counted in Spark;
   a window whose anchor occurs once in the corpus is itself unique, and nothing
   about it has to be shuffled.
2. Windows with a repeated anchor are counted in Spark by two 64-bit hashes.
3. Places of repeated windows come back to their text, overlapping ones merge
   into maximal removal intervals, and the kept words are joined.

Equal texts are handled once: a text held by several rows loses every word that
any window covers.  Counts use partial aggregation, and both joins on a hash are
equi-joins that adaptive execution can split, so a frequent passage does not meet
in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._shared import content_key, join_split, narrow
from recollect.llm._text import BASES, Words, chunks, mix, signed, sliding, windows

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(words: Words, hashes: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor of each window, whether the window lies in one text, hashes of short windows)."""
    short = windows(hashes, anchor, BASES[0])
    inside = words.inside(size)
    short = np.where(words.inside(anchor), short, NEVER)
    return sliding(short, size - anchor + 1, np.minimum), inside, short


def _anchor_rows(size: int, anchor: int):
    reach = size - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("content")
            for row, _, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                if len(words.starts) < size:
                    continue
                least, inside, short = _anchors(words, words.hashes(), size, anchor)
                # a short window is an anchor if some window around it has it as the least
                least = np.where(inside, least, np.uint64(0))
                pad = np.zeros(reach - 1, dtype=np.uint64)
                around = sliding(np.concatenate([pad, least, pad]), reach, np.maximum)
                at = np.flatnonzero(around == short)
                at = at[short[at] != NEVER]
                text, value = words.text_of[at], short[at]
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(at)))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(text[first] + row)), pa.array(signed(value[first])), pa.array(times > 1)],
                    names=["content", "anchor", "twice"],
                )

    return run


def _window_rows(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wanted = batch.column("content"), batch.column("anchors")
            for row, end, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                if len(words.starts) < size:
                    continue
                hashes = words.hashes()
                least, inside, _ = _anchors(words, hashes, size, anchor)
                part = wanted.slice(row, end - row)
                owner = np.repeat(np.arange(end - row), np.diff(part.offsets.to_numpy()))
                value = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                # a text's own anchors: membership by a key of text number and value
                mine = np.sort(mix(value + mix(owner.astype(np.uint64) + np.uint64(1))))
                n = len(least)
                seek = mix(least + mix(words.text_of[:n].astype(np.uint64) + np.uint64(1)))
                spot = np.minimum(np.searchsorted(mine, seek), max(len(mine) - 1, 0))
                hit = np.flatnonzero(inside & (mine[spot] == seek)) if len(mine) else np.zeros(0, dtype=np.int64)
                if not len(hit):
                    continue
                one = windows(hashes, size, BASES[0])[hit]
                two = windows(words.hashes(BASES[1]), size, BASES[1])[hit]
                text = words.text_of[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(text + row)),
                        pa.array((hit - words.first[text]).astype(np.int32)),
                        pa.array(signed(one)),
                        pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ],
                    names=["content", "start", "w1", "w2"],
                )

    return run


def merge_intervals(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal [begin, end) word intervals covered by windows at ``starts``."""
    out: list[tuple[int, int]] = []
    for s in np.sort(starts).tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + size)
        else:
            out.append((s, s + size))
    return out


def _digest_rows(size: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest, spans, kept = [], [], [], [], []
            starts = batch.column("starts")
            bounds, places = starts.offsets.to_numpy(), starts.flatten().to_numpy(zero_copy_only=False)
            places = places if len(places) else np.zeros(0, dtype=np.int32)
            low = bounds[0]
            copies = batch.column("copies").to_pylist()
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                cuts = []
                if n >= size:
                    cuts = [(0, n)] if copies[i] > 1 else merge_intervals(places[bounds[i] - low : bounds[i + 1] - low], size)
                left, at = [], 0
                for b, e in cuts:
                    left += words[at:b]
                    at = e
                left += words[at:]
                joined = b" ".join(left)
                n_words.append(n)
                n_removed.append(n - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                spans.append([x for c in cuts for x in c])
                if keep_text:
                    kept.append(joined.decode())
            arrays = [batch.column("content"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, pa.list_(pa.int32()))]
            names = ["content", "n_words", "n_removed", "kept_sha256", "removed"]
            if keep_text:
                arrays.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 35, anchor: int = 10, keep_text: bool = False) -> DataFrame:
    """Remove every word that a repeated window of ``size`` words covers.

    Returns one row per input row: doc_id, n_words, n_removed, kept_sha256,
    removed (flat list begin, end, begin, end ... of maximal word intervals) and,
    with ``keep_text``, kept_text (kept words joined by one space).

    Null texts count as empty: no words, digest of the empty text.  Texts under
    ``size`` words keep all words.  Repeated rows are copies of one another, also
    when their doc_id is equal or null, so they lose all that windows cover.  An
    empty table gives an empty result.  Other columns are neither read nor kept.
    """
    if not 1 <= anchor <= size:
        raise ValueError("anchor must lie between 1 and size")
    rows = narrow(docs, doc_id, text).withColumn("content", content_key(F.col("text")))
    kinds = "content binary, anchor long, twice boolean"
    anchors = rows.select("content", "text").mapInArrow(_anchor_rows(size, anchor), kinds)
    repeated = (
        anchors.groupBy("anchor").agg(F.min(F.xxhash64("content")).alias("low"), F.max(F.xxhash64("content")).alias("high"), F.max("twice").alias("twice")).where("low < high or twice").select("anchor")
    )
    wanted = join_split(anchors.select("content", "anchor"), repeated, ["anchor"], "left_semi").groupBy("content").agg(F.collect_set("anchor").alias("anchors"))
    unique = rows.groupBy("content").agg(F.first("text").alias("text"))
    copies = rows.groupBy("content").agg(F.count(F.lit(1)).alias("copies"))
    found = unique.join(wanted, "content").mapInArrow(_window_rows(size, anchor), "content binary, start int, w1 long, w2 int")
    twice = found.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    starts = join_split(found, twice, ["w1", "w2"], "left_semi").groupBy("content").agg(F.collect_list("start").alias("starts"))
    empty = F.array().cast("array<int>")
    whole = unique.join(starts, "content", "left").join(copies, "content").select("content", "text", "copies", F.coalesce("starts", empty).alias("starts"))
    shape = "content binary, n_words long, n_removed long, kept_sha256 string, removed array<int>" + (", kept_text string" if keep_text else "")
    return rows.select("doc_id", "content").join(whole.mapInArrow(_digest_rows(size, keep_text), shape), "content").drop("content")
