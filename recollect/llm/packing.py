"""Bounded-space online packing of token sequences.

Every task tokenizes its texts and packs them as they come, with a fixed number
of open windows: what fills a window goes out at once, the rest goes to the open
window it fits best.  If none fits, the fullest window takes as much as it holds
(a document may be cut anywhere) and is emitted; a gap under ``least_piece`` ids
stays as padding instead.  The open windows that are left at the end of a task
are the leftovers; only they are merged across tasks: their pieces are laid end
to end (one running total per task reaches the driver) and cut at window ends.

Texts are not shuffled.  The packing of a task depends only on its own rows, so
a task that runs again packs alike; the packed pieces are checkpointed before
the leftovers are placed, so both parts come from one run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from recollect.llm._shared import cut, narrow
from recollect.llm._text import chunks
from recollect.llm._tokens import UnitEncoder

MERGED = 1 << 62  # sequence ids from here on are merged leftovers
_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class OpenWindows:
    """Best-fit packing into at most ``limit`` open windows of ``size`` places.

    Pieces are (document, first id, length); ``done`` gets closed windows as lists of pieces.
    """

    def __init__(self, size: int, limit: int, least_piece: int):
        self.size, self.limit, self.least = size, limit, least_piece
        self.gaps = np.zeros(0, dtype=np.int64)
        self.windows: list[list[tuple[int, int, int]]] = []
        self.done: list[list[tuple[int, int, int]]] = []

    def _close(self, i: int) -> None:
        self.done.append(self.windows.pop(i))
        self.gaps = np.delete(self.gaps, i)

    def add(self, doc: int, length: int) -> None:
        whole = length // self.size
        self.done += [[(doc, k * self.size, self.size)] for k in range(whole)]
        start, left = whole * self.size, length % self.size
        while left:
            fits = np.where(self.gaps >= left, self.gaps, self.size + 1)
            if len(fits) and fits.min() <= self.size:
                i = int(fits.argmin())
            elif len(self.windows) < self.limit:
                self.windows.append([])
                self.gaps = np.append(self.gaps, self.size)
                i = len(self.windows) - 1
            else:
                i = int(self.gaps.argmin())
                if self.gaps[i] < self.least:
                    self._close(i)
                    continue
            some = min(left, int(self.gaps[i]))
            self.windows[i].append((doc, start, some))
            self.gaps[i] -= some
            start, left = start + some, left - some
            if not self.gaps[i]:
                self._close(i)


def _pack_rows(path: str, end_id: int, size: int, limit: int, least: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = UnitEncoder.at(path, special_as_text), OpenWindows(size, limit, least)
        part, sequence, docs = TaskContext.get().partitionId(), 0, 0
        held: dict[int, tuple] = {}  # ids of documents with a piece in an open window: (doc_id, ids)

        def rows(windows, merged: bool):
            nonlocal sequence
            out: dict[str, list] = {f: [] for f in [*_FIELDS, "part", "ids"]}
            at = 0
            for pieces in windows:
                offset = at if merged else 0
                for doc, start, length in pieces:
                    doc_id, ids = held[doc]
                    some = ids[start : start + length].astype("<u4").tobytes()
                    values = (doc_id, start, length, zlib.crc32(some), len(ids), -1 if merged else part << 32 | sequence, offset, part, some if merged else None)
                    for f, v in zip(out, values, strict=True):
                        out[f].append(v)
                    offset += length
                at = offset
                sequence += 1
            kinds = dict.fromkeys(out, pa.int64()) | {"part": pa.int32(), "ids": pa.binary(), "doc_id": doc_kind}
            return pa.RecordBatch.from_arrays([pa.array(out[f], kinds[f]) for f in out], names=list(out))

        doc_kind = pa.int64()
        for batch in batches:
            doc_kind = batch.schema.field("doc_id").type
            names = batch.column("doc_id").to_pylist()
            for begin, _, data, offsets in chunks(batch.column("text")):
                ids, ends = encoder.encode(data, offsets)
                for i, ids in enumerate(np.split(ids, ends[:-1])):
                    held[docs] = (names[begin + i], np.append(ids, np.uint32(end_id)))
                    packer.add(docs, len(ids) + 1)
                    docs += 1
                yield rows(packer.done, merged=False)
                packer.done = []
                still = {p[0] for w in packer.windows for p in w}
                held = {d: held[d] for d in still}
        yield rows(packer.windows, merged=True)

    return run


def _leftover_rows(bases: dict[int, int], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f: [] for f in _FIELDS}
            for r in batch.to_pylist():
                ids, at, start = np.frombuffer(r["ids"], dtype="<u4"), bases[r["part"]] + r["offset"], r["start"]
                while len(ids):
                    some, ids = ids[: size - at % size], ids[size - at % size :]
                    values = (r["doc_id"], start, len(some), zlib.crc32(some.tobytes()), r["doc_tokens"], MERGED | at // size, at % size)
                    for f, v in zip(out, values, strict=True):
                        out[f].append(v)
                    at, start = at + len(some), start + len(some)
            yield pa.RecordBatch.from_arrays([pa.array(out[f], batch.schema.field(f).type) for f in out], names=_FIELDS)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 2048, open_windows: int = 64, least_piece: int = 16, doc_id: str = "doc_id", text: str = "text", special_as_text: bool = False) -> DataFrame:
    """Pack whole texts into sequences of at most ``size`` ids; one row per piece.

    Columns: doc_id, start (the document's ids before the piece), length,
    ids_crc32 (of the piece's ids as little-endian unsigned 32-bit integers),
    doc_tokens (with ``end_id``, which ends every document), sequence_id and
    offset in the sequence, gapless from 0.  Every id lies in exactly one piece.

    A null or empty text is the end id alone.  Rows are packed one by one, also
    where doc_id repeats or is null; an empty table gives no pieces.  Other
    columns are not read.  The strings of special tokens in a text become those
    tokens, as the library does by default, or ordinary text if ``special_as_text``.
    """
    rows = narrow(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    shape = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = cut(rows.mapInArrow(_pack_rows(tokenizer, end_id, size, open_windows, least_piece, special_as_text), shape + ", part int, ids binary"))
    left = packed.where("ids is not null")
    bases, total = {}, 0
    for r in sorted(left.groupBy("part").agg({"length": "sum"}).collect()):  # one row a task
        bases[r[0]] = total
        total += r[1]
    return packed.where("ids is null").select(*_FIELDS).unionByName(left.mapInArrow(_leftover_rows(bases, size), shape))
