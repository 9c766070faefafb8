"""Line de-duplication that returns keep bitmaps.

Each long line becomes one row per document (hash of its key, document, places).
Rows are range-partitioned by hash and descending document and sorted the same
way, so every hash is one run whose first row is the document that keeps it.  A
pass over the sorted rows streams the runs and emits the places to drop.

A frequent line may span several partitions.  Because the sorted rows sit in a
reliable checkpoint, a first pass can report the two runs at each partition's
edges (two rows a partition, all that reaches the driver); the second pass then
knows how many documents hold such a line before and after its own part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._shared import cut, narrow

BLANK = " \t\n\x0b\x0c\r"


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, places = [], [], []
            for i, text in enumerate(batch.column("text")):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars and len(line := line.strip(BLANK)) >= min_chars:
                        found.setdefault(hashlib.md5(line.encode().lower()).digest(), []).append(at)
                keys += found
                owner += [i] * len(found)
                places += [np.array(x, dtype=np.int32).tobytes() for x in found.values()]
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("doc").take(at), batch.column("unit").take(at), pa.array(places, pa.binary())],
                names=["line", "doc", "unit", "places"],
            )

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in the first and the last run of this partition."""
    runs: list[list] = []  # the first and the latest: [line, documents]
    doc = None
    for batch in batches:
        for line, now in zip(batch.column("line").to_pylist(), batch.column("doc").to_pylist(), strict=True):
            if runs and runs[-1][0] == line:
                runs[-1][1] += now != doc
            else:
                runs = [*runs[:1], [line, 1]]
            doc = now
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array([part] * len(runs), pa.int32()), pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.int64())],
        names=["part", "line", "docs"],
    )


def _drop_rows(beyond: dict[tuple[int, bytes], tuple[int, int]], min_docs: int):
    """beyond: for a run that other partitions share, documents before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        line, doc, seen, before, after = None, None, 0, 0, 0
        held: list[tuple[bytes, bytes]] = []  # rows to drop if enough documents follow
        for batch in batches:
            units, places = [], []
            for now_line, now_doc, unit, where in zip(*(batch.column(c).to_pylist() for c in ("line", "doc", "unit", "places")), strict=True):
                if now_line != line:
                    line, doc, held = now_line, now_doc, []
                    before, after = beyond.get((part, line), (0, 0))
                    seen = before + 1
                elif now_doc != doc:
                    doc = now_doc
                    seen += 1
                if seen == 1:
                    continue  # the largest document keeps its lines
                if seen + after < min_docs:
                    held.append((unit, where))
                    continue
                for u, w in held:
                    units.append(u)
                    places.append(w)
                held = []
                units.append(unit)
                places.append(where)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(places, pa.binary())], names=["unit", "places"])

    return run


def _bitmap_rows(digest: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, bitmaps, digests, texts = [], [], [], [], []
            drops = batch.column("drops").to_pylist()
            for text, drop in zip(batch.column("text"), drops, strict=True):
                lines = (text.as_py() or "").split("\n")
                keep = np.ones(len(lines), dtype=bool)
                for blob in drop or ():
                    keep[np.frombuffer(blob, dtype=np.int32)] = False
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - int(keep.sum()))
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes()))
                if digest or keep_text:
                    kept = "\n".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k) if n_dropped[-1] else "\n".join(lines)
                    digests.append(hashlib.sha256(kept.encode()).hexdigest() if digest else None)
                    texts.append(kept if keep_text else None)
            arrays = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(bitmaps, pa.binary())]
            names = ["doc_id", "n_lines", "n_dropped", "keep_bitmap"]
            for wanted, name, values in ((digest, "kept_sha256", digests), (keep_text, "kept_text", texts)):
                if wanted:
                    arrays.append(pa.array(values, pa.string()))
                    names.append(name)
            for extra in batch.schema.names[batch.schema.get_field_index("drops") + 1 :]:
                arrays.append(batch.column(extra))
                names.append(extra)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def keeps(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines from its bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=n_lines).astype(bool)


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, digest: bool = False, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop a long line from all documents but the largest doc_id if ``min_docs`` documents hold it.

    A line's key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and
    A-Z lower-cased; keys under ``min_chars`` code points are never dropped.
    Returns one row per input row: doc_id, n_lines, n_dropped, keep_bitmap (zlib
    of packed bits, first line in the highest bit; see ``keeps``), with
    ``digest`` kept_sha256, with ``keep_text`` kept_text, then the columns named
    in ``carry`` (names that the operator itself returns are refused).

    A null or empty text is one empty line.  Rows with equal doc_id are one
    document; rows without a doc_id are together one document that sorts below
    all others.  An empty table gives an empty result.
    """
    clash = {"doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256", "kept_text", "doc", "unit", "drops", "text"} & set(carry)
    if clash:
        raise ValueError(f"columns {sorted(clash)} can't be carried")
    own = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    unit = F.unhex(F.md5(F.concat_ws("|", name, F.coalesce("text", F.lit(""))).cast("binary")))
    order = F.col("doc_id").cast("long").alias("doc")
    lines = docs.select(*own).select(order, unit.alias("unit"), "text").mapInArrow(_line_rows(min_chars), "line binary, doc long, unit binary, places binary")
    by = [F.col("line"), F.col("doc").desc_nulls_last()]
    runs = cut(lines.repartitionByRange(*by).sortWithinPartitions(*by))
    shared: dict[bytes, list] = defaultdict(list)
    for r in runs.mapInArrow(_edges, "part int, line binary, docs long").collect():  # two rows a partition
        shared[bytes(r.line)].append((r.part, r.docs))
    beyond = {}
    for line, parts in shared.items():
        if len(parts) > 1:
            parts.sort()
            total, before = sum(n for _, n in parts), 0
            for part, n in parts:
                beyond[part, line] = (before, total - before - n)
                before += n
    drops = runs.mapInArrow(_drop_rows(beyond, min_docs), "unit binary, places binary").groupBy("unit").agg(F.collect_set("places").alias("drops"))
    rows = docs.select(*own, *[F.col(c) for c in carry]).withColumn("unit", unit)
    joined = rows.join(drops, "unit", "left").select("doc_id", "text", "drops", *carry)
    kinds = dict(joined.dtypes)
    shape = f"doc_id {kinds['doc_id']}, n_lines long, n_dropped long, keep_bitmap binary" + ", kept_sha256 string" * digest + ", kept_text string" * keep_text
    return joined.mapInArrow(_bitmap_rows(digest, keep_text), shape + "".join(f", `{c}` {kinds[c]}" for c in carry))
