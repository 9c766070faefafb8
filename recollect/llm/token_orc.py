"""Token ids as ORC files in order of document id, and reading them back.

Documents are range-partitioned and sorted by id, tokenized in Arrow batches and
written by Spark's ORC writer: ids in integer run-length encoding, row indexes in
every stripe and a Bloom filter on the document id, so a reader can take stripes
in parallel and skip those that can't hold an id.  A file's rows carry their
place in it, and a file's total places it after the files before it, so where a
document starts in the whole stream needs no global sort when reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm._shared import narrow
from recollect.llm._text import chunks
from recollect.llm._tokens import UnitEncoder


def _id_rows(path: str, end_id: int, special_as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place = UnitEncoder.at(path, special_as_text), 0
        for batch in batches:
            names = batch.column("doc_id")
            for row, end, data, offsets in chunks(batch.column("text")):
                ids, ends = encoder.encode(data, offsets)
                ids = np.insert(ids, ends, end_id).astype(np.int32)  # ids of the vocabulary fit 31 bits
                bounds = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(row, end - row), pa.array(np.arange(place, place + end - row)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))],
                    names=["doc_id", "place", "ids"],
                )
                place += end - row

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", stripe_mb: int = 16, special_as_text: bool = False) -> None:
    """Write (doc_id, place, ids) of every row to ORC files under ``path``, in ascending doc_id.

    ``end_id`` ends every document; a null or empty text is that id alone.  Rows
    without a doc_id come first, repeated ids stay next to each other.  An empty
    table writes no rows.  Other columns are not read.  The strings of special tokens
    in a text (``<|endoftext|>``) become those tokens, as the library does by default,
    or ordinary text if ``special_as_text``.
    """
    rows = narrow(docs, doc_id, text)
    kind = dict(rows.dtypes)["doc_id"]
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = ordered.mapInArrow(_id_rows(tokenizer, end_id, special_as_text), f"doc_id {kind}, place long, ids array<int>")
    (
        ids.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("compression", "zstd")
        .orc(path)
    )


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        bounds = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(ids[b:e]) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "place", "file")), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "place", "file", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the files alone."""
    shape = "doc_id long, place long, ids array<int>"
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("file")
    rows = spark.read.schema(shape).orc(path).select("doc_id", "place", "ids", number)
    found = rows.mapInArrow(_digest_rows, "doc_id long, place long, file int, n_tokens long, ids_crc32 long")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("total")).select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return found.join(totals, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of some documents; row groups whose index or Bloom filter excludes them are skipped."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path).where(F.col("doc_id").isin(doc_ids))
