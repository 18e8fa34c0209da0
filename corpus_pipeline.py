"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir); ``run`` writes what it returns to the shared folder and hands the
rows to the next. A stage begins with the executors giving back what the one before left in their heaps. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grafloom.llm import language_id, mixing, ngram_join, packing, secret_forest
from grafloom.llm.registry import END_ID
from grafloom.llm.shared import give_back, staged, unstage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows stay whose text has a language: neither ``und`` nor ambiguous. Learns from rows that aren't held
    out. Each row is decided by its own text, whatever its id."""
    give_back(spark)
    return language_id.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by near-duplicates one row stays: that with the smallest id. Rows with a null id
    and rows without words have no group and stay."""
    give_back(spark)
    return ngram_join.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; n_chars follows the text. Every row stays; null and empty texts stay as they are."""
    give_back(spark)
    clean = secret_forest.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it, 0 to 2 times; rows without words aren't taken."""
    give_back(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 tokens; a null or empty text is its end id."""
    give_back(spark)
    # By now each executor has idle workers of earlier stages, and all of them would keep an encoder.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, keep_encoder=False)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("packing", pack)]

#: Learned decisions and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # what no later stage reads
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
