"""I-Match document fingerprints.

A term is a lower-cased word; 24 bits of its md5 are its lexicon slot, 32 others
its value.  A slot's document frequency comes from all texts; terms in the chosen
band of normalised inverse document frequency, ln(N / df) / ln(N), are kept.  Of
the kept distinct terms in sorted order, one hash is taken over all and one over
each of several randomised lexicon subsets: the sum of their values modulo 2**32.
A subset holds one slot of 4, 16, 64, 256 or 1024, so that texts of any length
have subsets in which only a few of their terms fall.

The fingerprint is the list of those hashes; 00000000 stands for a subset without
terms.  Two fingerprints are as alike as the share of subsets with equal hashes
among those that are not empty in both.

What reaches the driver is one bit for each slot: 2**bits / 8 bytes (2 MB) at any
size of the corpus.  A corpus of many more than 2**24 distinct terms wants more
``bits`` (up to 32), so that unrelated terms seldom share a slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm._shared import narrow
from recollect.llm._text import Words, chunks

BITS = 24
BLOCK_BITS = 19  # slots of one block of the lexicon as it reaches the driver
RATES = [4] * 4 + [16] * 10 + [64] * 14 + [256] * 14 + [1024] * 6  # one slot in so many lies in a subset
PRIME = 2**31 - 1


def subset_factors() -> list[tuple[int, int]]:
    """(factor, addend) of each subset: slot s lies in it if (factor s + addend) mod PRIME mod rate is 0."""
    digests = [hashlib.md5(f"lexicon {j}".encode()).digest() for j in range(len(RATES))]
    return [(1 + int.from_bytes(d[:4], "big") % (PRIME - 1), int.from_bytes(d[4:8], "big") % PRIME) for d in digests]


def distinct_terms(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term) of the distinct terms of every text, sorted; slot and value of each term."""
    unique, first, number = np.unique(words.hashes(), return_index=True, return_inverse=True)
    data = words.data.tobytes()
    digests = b"".join([hashlib.md5(data[b:e]).digest()[:8] for b, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
    parts = np.frombuffer(digests, dtype=">u4").reshape(-1, 2)
    pairs = np.unique(words.text_of.astype(np.int64) << 32 | number)
    return pairs >> 32, pairs & 0xFFFFFFFF, parts[:, 0].astype(np.int64) >> (32 - bits), parts[:, 1].astype(np.uint32)


def _frequency_rows(bits: int):
    """(slot, texts), summed over the rows of a task in turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush():
            slot, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "texts"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column("text")):
                _, term, slot, _ = distinct_terms(Words(data, offsets, lower=True), bits)
                held.append(slot[term])
                if sum(map(len, held)) > 4_000_000:
                    yield flush()
        yield flush()

    return run


def _pack_block(table: pa.Table) -> pa.Table:
    """The bits of one block of slots."""
    slots = table.column("slot").to_numpy()
    flags = np.zeros(1 << BLOCK_BITS, dtype=bool)
    flags[slots & ((1 << BLOCK_BITS) - 1)] = True
    return pa.table({"block": pa.array([int(slots[0]) >> BLOCK_BITS], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})


def lexicon(docs: DataFrame, text: str = "text", low: float = 0.15, high: float = 0.9, bits: int = BITS) -> np.ndarray:
    """One bit a slot, packed: whether its normalised inverse document frequency lies in [low, high].

    That is df between N**(1 - high) and N**(1 - low); a slot's df is the sum of its terms'.
    """
    if not BLOCK_BITS <= bits <= 32:
        raise ValueError(f"bits must lie between {BLOCK_BITS} and 32")
    rows = docs.select(F.col(text).alias("text"))
    total = rows.count()
    counts = rows.mapInArrow(_frequency_rows(bits), "slot long, texts long").groupBy("slot").agg(F.sum("texts").alias("texts"))
    kept = counts.where((F.col("texts") >= float(total) ** (1 - high)) & (F.col("texts") <= float(total) ** (1 - low)))
    flags = np.zeros(1 << bits - 3, dtype=np.uint8)
    blocks = kept.select("slot").groupBy(F.expr(f"slot div {1 << BLOCK_BITS}")).applyInArrow(_pack_block, "block int, bits binary")
    for r in blocks.toLocalIterator():  # 64 KB a block
        flags[r.block << BLOCK_BITS - 3 : (r.block + 1) << BLOCK_BITS - 3] = np.frombuffer(r.bits, dtype=np.uint8)
    return flags


class Fingerprinter:
    def __init__(self, kept: np.ndarray):
        self.kept, self.bits = kept, len(kept).bit_length() + 2
        self.factors, self.rates = np.array(subset_factors(), dtype=np.int64), np.array(RATES, dtype=np.int64)

    def of(self, words: Words) -> np.ndarray:
        """A row for each text: the hash of all kept terms, then of each subset (0 if it has none)."""
        text, term, slot, value = distinct_terms(words, self.bits)
        band = (self.kept[slot >> 3] >> (7 - (slot & 7)) & 1).astype(bool)[term]
        any_band = np.bincount(text[band], minlength=words.texts) > 0
        use = band | ~any_band[text]  # a text without a term in the band keeps all of its terms
        text, term = text[use], term[use]
        weight = value[term]
        # membership is a matter of the term, so it is found once for all texts of the chunk
        member = (slot % PRIME * self.factors[:, :1] + self.factors[:, 1:]) % PRIME % self.rates[:, None] == 0
        out = np.zeros((words.texts, len(RATES) + 1), dtype=np.uint32)
        for j, holds in enumerate([None, *member]):
            at = slice(None) if holds is None else np.flatnonzero(holds[term])
            owner = text[at]
            if len(owner):
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                out[owner[starts], j] = np.add.reduceat(weight[at], starts, dtype=np.uint32)
        return out


def as_text(prints: np.ndarray) -> list[str]:
    """Each row as eight hexadecimal digits a hash, with a space between two."""
    width = 9 * prints.shape[1]
    digits = prints.astype(">u4").tobytes().hex(" ", 4)
    return [digits[i * width : (i + 1) * width - 1] for i in range(len(prints))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row 1 for equal fingerprints; else the share of equal subsets among those not empty in both."""
    some = (a[:, 1:] != 0) | (b[:, 1:] != 0)
    equal = (some & (a[:, 1:] == b[:, 1:])).sum(axis=1)
    return np.where((a == b).all(axis=1), 1.0, equal / np.maximum(some.sum(axis=1), 1))


def _fingerprint_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(shared.value)
        for batch in batches:
            found = [p for _, _, data, offsets in chunks(batch.column("text")) for p in as_text(printer.of(Words(data, offsets, lower=True)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, kept: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row, against a lexicon.

    A null or empty text has the hash of no terms.  Equal texts have equal
    fingerprints, whatever their ids; an empty table gives an empty result.
    Other columns are not read.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = narrow(docs, doc_id, text)
    return rows.mapInArrow(_fingerprint_rows(docs.sparkSession.sparkContext.broadcast(kept)), f"doc_id {kind}, fingerprint string")


_SHAPE = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(printer: Fingerprinter, run_of: list[tuple]) -> pa.RecordBatch:
    """Results for all rows (doc_id, text, guest) but the last and the guests; each one's next is the row after it."""
    texts = [t for _, t, _ in run_of]
    edited = [now[: len(now) - len(now) // 2] + after[: len(now) // 2] for now, after in zip(texts[:-1], texts[1:], strict=True)]
    both = np.concatenate([printer.of(Words(data, offsets, lower=True)) for _, _, data, offsets in chunks(pa.array(texts + edited, pa.large_string()))])
    plain, changed = both[: len(texts)], both[len(texts) :]
    mine = np.flatnonzero([not guest for _, _, guest in run_of[:-1]])
    columns = [
        [run_of[i][0] for i in mine], [len(texts[i]) for i in mine], [hashlib.sha256(edited[i].encode()).hexdigest() for i in mine],
        as_text(plain[mine]), as_text(changed[mine]), likeness(plain[mine], changed[mine]), likeness(plain[mine], plain[mine + 1]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, _SHAPE, strict=True)], names=[name for name, _ in _SHAPE])


def _edited_rows(shared):
    """Rows of a range in order of id, each compared with the text after it; guests only follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(shared.value)
        pending: list[tuple] = []  # (doc_id, text, guest), the first one left over from before
        bucket, size = None, 0
        for batch in batches:
            for b, i, t, guest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "guest")), strict=True):
                if b != bucket:
                    if len(pending) > 1:
                        yield _compared(printer, pending)
                    pending, bucket, size = [], b, 0
                pending.append((i, t or "", guest))
                size += len(t or "")
                if size > 1 << 20 and len(pending) > 1:
                    yield _compared(printer, pending)
                    pending, size = pending[-1:], 0
        if len(pending) > 1:
            yield _compared(printer, pending)

    return run


def _placed(order: Column, cuts: np.ndarray, hosts: dict[int, int]) -> Column:
    """(bucket, host) of ids: the range of each, and the range it also visits as a guest (or null)."""
    lows = np.array(sorted(hosts), dtype=np.int64)
    to = np.array([hosts[low] for low in lows.tolist()], dtype=np.int32)

    def place(ids: pa.Array) -> pa.Array:
        at = ids.to_numpy(zero_copy_only=False)
        bucket = np.searchsorted(cuts, at, side="right").astype(np.int32)
        near = np.minimum(np.searchsorted(lows, at), max(len(lows) - 1, 0))
        none = lows[near] != at if len(lows) else np.ones(len(at), dtype=bool)
        host = pa.array(to[near] if len(lows) else bucket, mask=none)
        return pa.StructArray.from_arrays([pa.array(bucket), host], names=["bucket", "host"])

    return F.arrow_udf(place, "bucket int, host int")(order)


def compare_with_edits(docs: DataFrame, kept: np.ndarray, ranges: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one, compared.

    The edited text has the last floor(n / 2) code points replaced by the first as
    many (or all) of the next row in ascending doc_id; the last row's next is the
    first.  Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Rows are dealt to ``ranges`` ranges of ids (two a shuffle partition by default)
    whose bounds are quantiles;
    the first row of a range is also sent to the range before it, so no sort sees
    all rows.  Null texts are empty; rows with a null doc_id come first and rows with
    equal doc_id are in order of text.  A single row follows itself; an empty table
    gives an empty result.  Other columns are not read.
    """
    rows = narrow(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ranges = ranges or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [i / ranges for i in range(1, ranges)]
    cuts = rows.select(F.percentile_approx("doc_id", parts, 10_000).alias("cuts")).first().cuts or []
    cuts = np.array(sorted(set(cuts)), dtype=np.int64)
    bucket = _placed(order, cuts, {})["bucket"]
    firsts = sorted(tuple(r) for r in rows.select(bucket.alias("bucket"), order.alias("at")).groupBy("bucket").agg(F.min("at")).collect())  # one row a range
    if not firsts:
        return rows.select("doc_id").mapInArrow(lambda batches: iter(()), _DDL)
    hosts = {low: firsts[i - 1][0] for i, (_, low) in enumerate(firsts)}  # the first range follows the last
    dealt = rows.withColumn("at", order).withColumn("placed", _placed(F.col("at"), cuts, hosts))
    own = F.struct(F.col("placed.bucket").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.when(F.col("placed.host").isNotNull(), F.struct(F.col("placed.host").alias("bucket"), F.lit(True).alias("guest")))
    dealt = dealt.withColumn("place", F.explode(F.array_compact(F.array(own, guest)))).select("place.bucket", "place.guest", "at", "doc_id", "text")
    dealt = dealt.repartitionByRange("bucket").sortWithinPartitions("bucket", "guest", "at", F.coalesce("text", F.lit("")))
    shared = docs.sparkSession.sparkContext.broadcast(kept)
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_edited_rows(shared), _DDL)
