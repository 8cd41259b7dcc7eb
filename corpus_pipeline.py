"""Cleaning a corpus: five stages over ``documents``, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm import decontaminate, lines, quality, simhash, tokens
from tallywise.operators.scratch import durable


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the test fold, accepts."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold != 1))
    return quality.score_quality(docs, weights).where(F.col("score") >= 0.5).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which nothing is left go."""
    lean = lines.dedupe_lines(docs)
    lean = lean.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return lean.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: 4-word shingles, links at 4 bits or fewer."""
    return simhash.keep_first(docs, shingle=4, distance=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and digests of the ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = tokens.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True)
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: The classifier's weights, XXH64 fingerprints and byte pair merges can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
