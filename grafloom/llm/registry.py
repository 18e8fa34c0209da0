"""The subpackage's queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hard_negatives, imatch, kd_clusters, language_id, maxscore, mixing, ngram_join, packing, quality, secret_forest, token_counts, token_files
from .ngram_sql import NGRAM_SQL

END_ID = 2


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_read(spark, sf_dir, "documents")).documents.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID).read()


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(_read(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_clusters.clustered(_read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_likeness(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_quality, op3_maxscore, op4_mixing, op5_neighbours, op6_token_files, op7_token_counts, op8_language_id, op9_packing, op10_secrets, op11_clusters, op12_hard_negatives, op13_imatch)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_SQL, "op3_maxscore": maxscore.TOP_SQL, "op4_mixing": mixing.MIX_SQL, "op11_clusters": kd_clusters.cluster_sql(), "op12_hard_negatives": hard_negatives.NEGATIVES_SQL, "op13_imatch": imatch.IMATCH_SQL}
