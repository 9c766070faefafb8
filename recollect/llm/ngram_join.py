"""Exact Jaccard join of word-shingle sets, as components.

Candidates.  Shingles have one global order: the frequent ones last, the rest by
hash.  Two sets with Jaccard >= t share a shingle among the first
``n - ceil(t n) + 1`` of each, so only these prefixes are shuffled, and only
prefix shingles that two different sets hold go further.  Which shingles count as
frequent changes the work, never the result.

Tiles.  The blocks (the sets with one prefix shingle) are counted first.  One of a
few sets gives its pairs directly; a larger one is never gathered: its sets are dealt
into tiles of bounded size, by size band and then by hash.  Bands are so wide that
only sets of one band or of two neighbouring ones can reach the threshold, so only
their tiles are paired; each pair of tiles is one task.  In it the sets are in order
of size, only sizes within the threshold meet, and hashed bitmap signatures bound the
overlap from above: ``|A & B| <= |A| - bits(sig A & ~sig B)``.  What passes is joined
to *families*.

Verification.  Each family's sorted shingle arrays meet once, again in tiles, and
are intersected exactly; a pair already connected is not compared again.  A tile
task returns a spanning forest, so the links of a large group of near copies do
not grow with its square, and no link between different groups is lost.

Shingles are 64-bit hashes of ``k`` words; equal sets are one node throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm._shared import cut, join_split, narrow
from recollect.llm._text import BASES, Words, chunks, mix, signed, spans, windows
from recollect.llm.components import components

LEAST_BITS = 1024  # of a signature; it has twice its set's size at least, a power of two
SMALL_BLOCK = 32  # sets of a block that are paired directly
TILE = 1024  # sets of a tile
FREQUENT = 1 << 20  # entries at most in the list of frequent shingles
NODE = "node long, n long"


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle) of the distinct shingles, sorted; short texts are one shingle."""
    hashes = words.hashes()
    whole = windows(hashes, k, BASES[0])
    inside = words.inside(k)
    text, value = words.text_of[: len(whole)][inside], whole[inside]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        one = spans(hashes, words.first[short], words.first[short + 1], BASES[0]) ^ mix(count[short].astype(np.uint64))
        text, value = np.concatenate([text, short]), np.concatenate([value, one])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _nodes(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each set of sorted shingles value[bounds[i]:bounds[i+1]]."""
    n = np.diff(bounds).astype(np.uint64)
    return spans(mix(value), bounds[:-1], bounds[1:], BASES[1]) ^ mix(n)


def _signatures(text: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bitmap of every set; half of a bitmap or-ed with the other half is the one of half the bits."""
    out: list[bytes] = [b""] * len(n)
    bits = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    hashed = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    for m in np.unique(bits).tolist():
        some = np.flatnonzero(bits == m)
        place = np.full(len(n), -1)
        place[some] = np.arange(len(some))
        mine = place[text] >= 0
        flags = np.zeros((len(some), m), dtype=bool)
        flags[place[text[mine]], (hashed[mine] & np.uint64(m - 1)).astype(np.int64)] = True
        for i, row in zip(some.tolist(), np.packbits(flags, axis=1), strict=True):
            out[i] = row.tobytes()
    return out


def _most_overlap(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of sets with signatures x (the wider) and y, row by row."""
    while x.shape[-1] > y.shape[-1]:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))


def _parts(batch: pa.RecordBatch, k: int):
    for row, end, data, offsets in chunks(batch.column("text")):
        words = Words(data, offsets, lower=True)
        text, value = _sets(words, k)
        bounds = np.searchsorted(text, np.arange(end - row + 1))
        yield row, end, text, value, bounds, np.diff(bounds), _nodes(value, bounds)


def _unit_rows(k: int):
    """A row for each text, and the shingles that many sets of this task hold, with their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, common, pending = np.zeros(0, np.uint64), 0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), []
        for batch in batches:
            for row, end, text, value, bounds, n, node in _parts(batch, k):
                some = batch.slice(row, end - row)
                m = end - row
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("unit"), pa.array(signed(node)), pa.array(n.astype(np.int64)), pa.array(_signatures(text, value, n), pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    names=["doc_id", "unit", "node", "n", "signature", "key", "times"],
                )
                fresh, first = np.unique(node, return_index=True)
                first = first[~np.isin(fresh, seen)]
                pending.append(value[np.isin(text, first)])
                seen = np.union1d(seen, node)
                sets += len(first)
                if sum(map(len, pending)) > 4_000_000:
                    common, pending = _heavy(common, pending, sets), []
                if len(seen) > 500_000:
                    seen = np.zeros(0, np.uint64)
        key, times = _heavy(common, pending, sets)
        m = len(key)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(signed(key)), pa.array(times)],
            names=["doc_id", "unit", "node", "n", "signature", "key", "times"],
        )

    return run


def _heavy(common: tuple[np.ndarray, np.ndarray], pending: list[np.ndarray], sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least one of 512 sets so far, and in four at least."""
    key, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *pending]), return_counts=True)
    both = np.concatenate([common[0], key])
    key, at = np.unique(both, return_inverse=True)
    times = np.bincount(at, np.concatenate([common[1], times]), len(key)).astype(np.int64)
    keep = times >= max(4, sets // 512)
    return key[keep], times[keep]


def _prefix_rows(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            for _, _, text, value, bounds, n, node in _parts(batch, k):
                last = np.isin(value, late) if len(late) else np.zeros(len(value), dtype=bool)
                order = np.lexsort((last, text))  # stable: each text's frequent shingles move behind the others
                rank = np.arange(len(text)) - bounds[:-1][text]
                prefix = n - (percent * n + 99) // 100 + 1
                take = order[rank < prefix[text]]
                owner = text[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(value[take])), pa.array(signed(node[owner])), pa.array(n[owner].astype(np.int64))], names=["key", "node", "n"]
                )

    return run


def _block_rows(percent: int):
    """The pairs (a, b) of sets in small blocks, which come one behind the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, []
        a, b = [], []

        def close():
            for j, (y, ny) in enumerate(block):
                for x, nx in block[:j]:
                    if 100 * nx >= percent * ny:
                        a.append(min(x, y))
                        b.append(max(x, y))

        for batch in batches:
            for now, node, n in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n")), strict=True):
                if now != key:
                    close()
                    key, block = now, []
                block.append((node, n))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])
            a, b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _least_overlap(nx, ny, percent: int):
    """The least overlap of sizes nx and ny with Jaccard >= percent / 100."""
    return -(-percent * (nx + ny) // (100 + percent))


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            swap = batch.column("n_a").to_numpy() < batch.column("n_b").to_numpy()  # the larger set first
            sig = [np.array(batch.column(c).to_pylist(), dtype=object) for c in ("sig_a", "sig_b")]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            sx, sy, nx, ny = np.where(swap, sig[1], sig[0]), np.where(swap, sig[0], sig[1]), np.where(swap, n[1], n[0]), np.where(swap, n[0], n[1])
            widths = np.array([(len(p), len(q)) for p, q in zip(sx, sy, strict=True)]).reshape(-1, 2)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for w in np.unique(widths, axis=0):
                some = np.flatnonzero((widths == w).all(axis=1))
                x, y = (np.frombuffer(b"".join(s[some]), dtype=np.uint64).reshape(len(some), -1) for s in (sx, sy))
                keep[some] = _most_overlap(x, nx[some], y, ny[some]) >= _least_overlap(nx[some], ny[some], percent)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _tile_forest(percent: int, exact: bool):
    """Each set of a tile task with the root of its tree of links; of two different tiles only pairs across them."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), n))
        table = table.take(pa.array(order))
        n, node, high = n[order], table.column("node").to_numpy(), table.column("is_high").to_numpy(zero_copy_only=False)
        across = bool(high.any())
        signatures = table.column("signature").to_pylist()
        width = np.array([len(x) for x in signatures])  # grows with n, so each width is one range of rows
        ranges = {int(w): (int(np.searchsorted(width, w)), int(np.searchsorted(width, w, side="right"))) for w in np.unique(width)}
        bits = {w: np.frombuffer(b"".join(signatures[b:e]), dtype=np.uint64).reshape(e - b, -1) for w, (b, e) in ranges.items()}
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()] if exact else []
        root = np.arange(len(n))
        for i in range(1, len(n)):
            low = int(np.searchsorted(n, -(-percent * n[i] // 100)))
            open_pairs = root[low:i] != root[i]
            other = np.flatnonzero(open_pairs & (high[low:i] != high[i]) if across else open_pairs) + low
            if not len(other):
                continue
            mine = bits[width[i]][i - ranges[width[i]][0]]
            parts = [(w, other[(other >= b) & (other < e)] - b) for w, (b, e) in ranges.items() if b < i]
            most = np.concatenate([_most_overlap(mine, n[i], bits[w][at], n[at + ranges[w][0]]) for w, at in parts if len(at)])
            good = most >= _least_overlap(n[other], n[i], percent)
            other = other[good][np.argsort(-most[good], kind="stable")]
            for j in other.tolist():
                if root[j] == root[i]:
                    continue
                if exact:
                    both = np.concatenate([sets[i], sets[j]])
                    both.sort(kind="stable")
                    if int((both[1:] == both[:-1]).sum()) < _least_overlap(n[i], n[j], percent):
                        continue
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root[: i + 1][root[: i + 1] == old] = new
        linked = np.flatnonzero(root != np.arange(len(n)))
        return pa.table({"a": node[root[linked]], "b": node[linked]})

    return run


def _band(n: Column, percent: int) -> Column:
    """The size band of a set; sizes within the threshold are in one band or in neighbouring ones."""
    width = max(math.log(100 / percent) * (1 + 1e-9), 1e-3)
    return F.floor(F.ln(n) / width)


def _tiled(rows: DataFrame, group: str, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) inside each group; groups of over TILE sets are dealt to pairs of tiles of near sizes."""
    rows = rows.withColumn("band", _band(F.col("n"), percent))
    whole, line = Window.partitionBy(group), Window.partitionBy(group).orderBy("band")
    counts = rows.groupBy(group, "band").agg(F.count(F.lit(1)).alias("members"))  # a few dozen rows a group
    own = F.ceil(F.col("members") / F.lit(TILE)).cast("int")

    def beside(step: int) -> Column:
        return F.when(F.lag("band", step).over(line) == F.col("band") - step, F.lag(own, step).over(line)).otherwise(0)

    tiles = counts.select(group, "band", own.alias("tiles"), beside(1).alias("before"), beside(-1).alias("after"), (F.sum("members").over(whole) > TILE).alias("dealt"))
    placed = join_split(rows, tiles, [group, "band"], "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def task(low_band, low, high_band, high, is_high) -> Column:
        names = ("low_band", "low", "high_band", "high", "is_high")
        kinds = ("long", "int", "long", "int", "boolean")
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(k).alias(name) for v, name, k in zip((low_band, low, high_band, high, is_high), names, kinds, strict=True)])

    def each(count: str, make) -> Column:
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), make)

    band, mine = F.col("band"), F.col("own")
    inside = each("tiles", lambda j: task(band, F.least(mine, j), band, F.greatest(mine, j), mine > j))
    larger = each("after", lambda j: task(band, mine, band + 1, j, False))
    smaller = each("before", lambda j: task(band - 1, j, band, mine, True))
    tasks = F.when(F.col("dealt"), F.concat(inside, larger, smaller)).otherwise(F.array(task(0, 0, 0, 0, False)))
    dealt = placed.withColumn("task", F.explode(tasks)).select(group, "task.*", "node", "n", "signature", *(["shingles"] if exact else []))
    return dealt.groupBy(group, "low_band", "low", "high_band", "high").applyInArrow(_tile_forest(percent, exact), "a long, b long")


def _set_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, value, bounds, n, node in _parts(batch, k):
                some = batch.slice(row, end - row)
                right = np.flatnonzero(signed(node) == some.column("node").to_numpy())
                signature = _signatures(text, value, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("family").take(pa.array(right)),
                        pa.array(signed(node[right])),
                        pa.array(n[right].astype(np.int64)),
                        pa.array([signature[i] for i in right], pa.binary()),
                        pa.array([value[bounds[i] : bounds[i + 1]].tobytes() for i in right], pa.binary()),
                    ],
                    names=["family", "node", "n", "signature", "shingles"],
                )

    return run


def ngram_jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Texts are lower-cased (A-Z) and split at ``[\\x20\\x09-\\x0D]``; a set holds the
    distinct ``k``-word shingles, of fewer words the whole sequence as one.  Rows
    link when 100 * intersection >= percent * union; component_id is the least
    doc_id reachable by links, the row's own included.

    Null, empty and blank texts have no shingles and link with nothing: their
    component_id is their own doc_id.  Repeated rows and equal sets are linked.
    A null doc_id is never the least unless all of the component are null.  An
    empty table gives an empty result; other columns are not read.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    spark = docs.sparkSession
    rows = narrow(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("unit", F.xxhash64("doc_id", "text"))
    shape = "doc_id long, unit long, node long, n long, signature binary, key long, times long"
    both = cut(rows.mapInArrow(_unit_rows(k), shape))
    units = both.where("node is not null").select("doc_id", "unit", "node", "n", "signature")
    frequent = both.where("key is not null").groupBy("key").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "key").limit(FREQUENT)
    late = spark.sparkContext.broadcast(np.sort(np.array([r.key for r in frequent.select("key").toLocalIterator()], dtype=np.int64).view(np.uint64)))

    keys = rows.select("text").mapInArrow(_prefix_rows(k, percent, late), "key long, node long, n long")
    repeated = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    members = cut(join_split(keys, repeated, ["key"], "left_semi").distinct())
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > SMALL_BLOCK).select("key")
    few = members.join(crowded, "key", "left_anti").repartition("key").sortWithinPartitions("key", "n", "node")

    sets = units.where("n > 0").groupBy("node").agg(F.min("unit").alias("unit"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    pairs = few.mapInArrow(_block_rows(percent), "a long, b long").distinct()
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"sig_{c}")), c)
    close = pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_plausible(percent), "a long, b long")
    large = join_split(members, crowded, ["key"], "left_semi").select("key", "node").join(sets.select("node", "n", "signature"), "node")
    family = components(close.union(_tiled(large, "key", percent, exact=False))).select("node", F.col("component").alias("family"))

    wanted = family.join(sets.select("node", "unit"), "node")
    whole = rows.select("unit", "text").join(wanted, "unit").dropDuplicates(["node"]).select("text", "node", "family")
    verified = whole.mapInArrow(_set_rows(k), "family long, node long, n long, signature binary, shingles binary")
    linked = components(_tiled(verified, "family", percent, exact=True))

    named = units.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "component").select("node", "component_id")
    full = units.where("n > 0").join(answer, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    blank = units.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(blank)
