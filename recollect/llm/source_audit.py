"""Source divergence audit on run-length columns.

Terms are counted per (lang, source).  A language's vocabulary are the terms that
enough of its documents hold; each is one row of a table with its cells, the counts
of the sources that have it.  That table is sorted by cells, source by source, so
terms with equal counts stand together, and is dealt by range into slices.  A slice
is cut into chunks of bounded size, and a chunk encodes every source's column as
runs (count, length), zeros included.

Two sources are compared within a chunk by intersecting their run boundaries: f is
computed once for each piece between two boundaries and multiplied by its length.
The sums of the chunks add up.  Sources are dealt to tiles, so a task holds the
runs of two tiles of one chunk, however many sources a language has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._shared import cut

SCALE = 1_000_000_000
HELD = 300_000  # distinct (group, term) that a task counts before it hands them on
CHUNK_CELLS = 1_000_000  # of one chunk of the vocabulary
CHUNK_TERMS = 100_000
TILE = 64  # sources compared with as many others in one task
#: Letters and all that is not ASCII make terms; A-Z are lower-cased.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's rows, handed on whenever ``HELD`` are together."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> pa.RecordBatch:
        langs, sources, words, n, docs = [], [], [], [], []
        for (lang, source), (count, held) in groups.items():
            langs += [lang] * len(count)
            sources += [source] * len(count)
            words += [w.decode() for w in count]
            n += count.values()
            docs += map(held.__getitem__, count)
        groups.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    size = 0
    for batch in batches:
        langs, sources, texts = batch.columns
        for i in range(len(batch)):
            words = (texts[i].as_py() or "").encode().translate(_TERM_BYTES).split()
            count, held = groups.setdefault((langs[i].as_py() or "", sources[i].as_py() or ""), (Counter(), Counter()))
            before = len(count)
            count.update(words)
            held.update(set(words))
            size += len(count) - before
            if size >= HELD:
                yield flush()
                size = 0
    if groups:
        yield flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)), exact for any long."""
    wide = "decimal(19,0)"
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast(wide), (total + 2 * kept).cast(wide)) + F.lit(1)


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); p and q are at most 10**9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def encode(places: np.ndarray, counts: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, lengths) of the runs of a column of ``terms`` places that is 0 but at ``places`` (rising)."""
    edges = np.unique(np.concatenate([[0], places, places + 1]))
    edges = edges[edges < terms]
    values = np.zeros(len(edges), dtype=np.int64)
    values[np.searchsorted(edges, places)] = counts
    first = np.append(True, values[1:] != values[:-1])
    return values[first], np.diff(np.append(edges[first], terms))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vocabulary rows (slice, lang, cells) to (chunk, lang, source, counts, lengths, terms).

    A chunk has a row without source besides, for its length in terms.
    """
    columns: dict[str, tuple[list[int], list[int]]] = {}
    chunk = {"slice": 0, "number": 0, "lang": None, "terms": 0, "cells": 0}

    def flush() -> pa.RecordBatch:
        name, terms = f"{chunk['slice']}-{chunk['number']}", chunk["terms"]
        runs = [encode(np.array(places), np.array(counts), terms) for places, counts in columns.values()]
        n = len(runs) + 1
        chunk.update(number=chunk["number"] + 1, terms=0, cells=0)
        out = [pa.array([name] * n), pa.array([chunk["lang"]] * n), pa.array([None, *columns], pa.string()), pa.array([None, *(r[0] for r in runs)], pa.list_(pa.int64())), pa.array([None, *(r[1] for r in runs)], pa.list_(pa.int64())), pa.array([terms] * n, pa.int64())]
        columns.clear()
        return pa.RecordBatch.from_arrays(out, names=["chunk", "lang", "source", "counts", "lengths", "terms"])

    for batch in batches:
        for part, lang, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk["terms"] and (lang != chunk["lang"] or chunk["cells"] >= CHUNK_CELLS or chunk["terms"] >= CHUNK_TERMS):
                yield flush()
            chunk["slice"], chunk["lang"] = part, lang
            for cell in cells:
                places, counts = columns.setdefault(cell["source"], ([], []))
                places.append(chunk["terms"])
                counts.append(cell["n"])
            chunk["terms"] += 1
            chunk["cells"] += len(cells)
    if chunk["terms"]:
        yield flush()


def run_sum(p: np.ndarray, p_ends: np.ndarray, q: np.ndarray, q_ends: np.ndarray) -> int:
    """Sum of f over two run-length columns (values and run ends) of equal length."""
    ends = np.union1d(p_ends, q_ends)
    a, b = p[np.searchsorted(p_ends, ends)], q[np.searchsorted(q_ends, ends)]
    return int((((a - b) * (a - b)) // (a + b) * np.diff(ends, prepend=0)).sum())


def _shares(counts, total: int, kept: int) -> np.ndarray:
    return np.array([1 + SCALE * (int(c) + 2) // (total + 2 * kept) for c in counts], dtype=np.int64)


def _tile_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of f for every pair of sources of two tiles in one chunk; each pair once."""
    columns = []
    for r in frame.itertuples(index=False):
        distinct, place = np.unique(r.counts, return_inverse=True)
        columns.append((r.source, r.tile, _shares(distinct, int(r.total), int(r.kept))[place], np.cumsum(r.lengths)))
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    out = []
    for i, (a, tile_a, p, p_ends) in enumerate(columns):
        for b, tile_b, q, q_ends in columns[i + 1 :]:
            if low == high or tile_a != tile_b:
                out.append((frame["lang"].iloc[0], min(a, b), max(a, b), run_sum(p, p_ends, q, q_ends)))
    return pd.DataFrame(out, columns=["lang", "a", "b", "part"])


def source_divergence(docs: DataFrame, least: int = 10, most: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): what tells the sources of a language apart.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased.  A language keeps
    the V terms that at least ``least`` of its documents hold.  A group is a (lang, source)
    that occurs, even without terms.  In a group, and in the whole language, a kept term has
    ``p = 1 + floor(10**9 (count + 2) / (N + 2 V))``, N the counts of all kept terms there;
    ``f = floor((p - q)**2 / (p + q))``.

    ``part`` ``pair``: every other source of the language (``item``), ``value`` the sum of f
    over all kept terms.  ``term``: the group's ``most`` terms of highest f among those with
    a count and p above the language's.  ``rank`` counts from 1 by falling value, then rising
    item in byte order.

    Null texts, languages and sources count as ''.  Rows count one by one, so repeated
    rows add up; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # one row a kept term, with its cells in the order of sources
    kept = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("count"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    kept = cut(kept.where(F.col("docs") >= least).select("lang", "term", "count", "cells"))
    whole = kept.groupBy("lang").agg(F.sum("count").alias("all"), F.count(F.lit(1)).alias("kept"))
    flat = kept.select("lang", "term", "count", F.explode("cells").alias("cell")).select("lang", "term", "count", "cell.source", "cell.n")
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = cut(groups.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").na.fill(0, ["total", "all", "kept"]))

    # part term
    named = flat.join(groups, ["lang", "source"])
    named = named.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", _share(F.col("count"), F.col("all"), F.col("kept")))
    named = named.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    # part pair
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("long").alias("tiles"))
    tiled = groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    # ranges are drawn by the first cells only: Spark samples these keys to the driver
    slices = kept.repartitionByRange("lang", F.slice("cells", 1, 3)).sortWithinPartitions("lang", "cells").select(F.spark_partition_id().alias("slice"), "lang", "cells")
    runs = cut(slices.mapInArrow(_runs, "chunk string, lang string, source string, counts array<long>, lengths array<long>, terms long"))
    chunks = runs.where("source is null").select("lang", "chunk", "terms")
    # a source that a chunk has no term of is one run of zeros there
    columns = chunks.join(tiled, "lang").join(runs.where("source is not null").drop("terms"), ["lang", "chunk", "source"], "left")
    columns = columns.withColumn("counts", F.coalesce("counts", F.array(F.lit(0).cast("long")))).withColumn("lengths", F.coalesce("lengths", F.array("terms")))
    columns = columns.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = columns.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    parts = columns.groupBy("lang", "chunk", "low", "high").applyInPandas(_tile_pairs, "lang string, a string, b string, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    sums = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_"), "value").select("lang", "_.*", "value")
    others = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(named)
