"""The corpus pipeline: five stages over ``documents``, each one operator.

Quality classifier -> line de-duplication -> n-gram Jaccard join -> benchmark
decontamination -> packing.  Every stage is written as Parquet and read again as
the input of the next one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from recollect.llm._shared import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules score 0.5 or more; the others go."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.score_quality(docs, model, "_score").where("_score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that the largest of three or more documents keeps."""
    kept = line_dedup.line_dedup(docs, keep_text=True, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id.

    A doc_id stands for one document.  Documents without shingles are in no group
    and stay, as do those without a doc_id.
    """
    copies = ngram_join.ngram_jaccard_components(docs).where("n_shingles > 0 and doc_id <> component_id")
    return docs.join(copies.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("packing", packed)]

#: A model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _is_whole(spark: SparkSession, folder: str) -> bool:
    """Whether a stage's output was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written below ``folder`` and read again.

    Without ``folder`` a new one in the shared folder is taken.  After a failure the outputs of the
    finished stages stay there; a run with the same folder, also of another driver, reads those and goes on with the
    first stage that is not whole, whose parts it writes anew.  The folder belongs to the caller, who removes it.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        if not _is_whole(spark, out):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    return docs
