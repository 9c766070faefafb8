"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import toxicity
from recollect.llm._shared import shared_folder
from recollect.llm.decontaminate import contaminated
from recollect.llm.html_extract import extract_main_text
from recollect.llm.imatch import compare_with_edits, lexicon
from recollect.llm.line_dedup import line_dedup
from recollect.llm.ngram_join import ngram_jaccard_components
from recollect.llm.packing import pack
from recollect.llm.quality_rules import fold, score_quality, train
from recollect.llm.ranked_search import ranked_search
from recollect.llm.source_audit import source_divergence
from recollect.llm.substring_dedup import substring_dedup
from recollect.llm.token_orc import read_tokens, write_tokens
from recollect.llm.url_filter import url_filter

#: Host rules of the URL contract, and the globs that judge what no host rule fits.
HOST_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
URL_GLOBS = [("*spam*?*", "block"), ("*pills*?*", "block"), ("*casino*?*", "block"), ("*porn*?*", "block"), ("*xxx*?*", "block"), ("*?*free-download*", "block"), ("*?*/login*", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), size=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3, digest=True).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), HOST_RULES, URL_GLOBS, default="allow").drop("glob")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_edits(docs, lexicon(docs, low=0.15, high=0.9))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"), k=5, percent=80)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, _table(spark, sf_dir, "labels"), folds=3, held_out=1)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), share=0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.train(docs, _table(spark, sf_dir, "labels"), folds=5, held_out=0)
    scored = toxicity.score_toxicity(docs, network)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), least=10, most=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_url_filter, op4_fingerprints, op5_ngram_jaccard_join, op6_token_orc, op7_packing, op8_quality_classifier, op9_decontaminate, op10_toxicity, op11_ranked_search, op12_html_extract, op13_source_divergence)}
