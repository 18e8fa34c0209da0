"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, digest, n_tokens) keyed by the digest of a tokenizer's file and
the SHA-256 of the normalised content. Normalising replaces a null by the empty text and changes nothing
else, since any other change could alter a count. Texts whose digest the cache lacks are encoded once,
whatever the number of copies and ids, and appended; all counts are then read from the cache by a join, those of
digests that a thousandth of all rows share by a broadcast of at most a thousand rows. The folder is an argument
or the setting ``spark.grafloom.tokenCache``.

Defined cases: null counts as empty (0 bytes, 0 tokens); rows with a null or repeated id are counted row
by row; extra columns are ignored; an empty table gives an empty result. An append is a Spark write, so a
job that is run again after a failure finds its cache either without or with the new rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import textkit as tk
from .shared import bounded_batches, id_filter, in_filter, lean, new_folder, staged
from .tokens import encoder, version

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Names a folder that holds the cache from run to run; without it each call makes a cache of its own.
CACHE_SETTING = "spark.grafloom.tokenCache"
HOT_DIGESTS = 1000


def default_folder(spark) -> str:
    return spark.conf.get(CACHE_SETTING, None) or new_folder(spark, "token-cache")


def open_cache(spark, folder: str) -> DataFrame:
    """The cache in ``folder``, empty if nothing has been written there."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _encode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tk.byte_slices(batch.column(1)):
                n = encoder(path, True).counts(data, offs)
                yield pa.record_batch([pa.array([name] * (j - i), pa.string()), batch.column(0)[i:j].cast(pa.binary()), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    return run


def _hot(keyed: DataFrame, counts: DataFrame) -> DataFrame:
    """(digest, n_tokens) of the digests that at least a thousandth of all rows bear: a thousand rows at most."""
    many = keyed.groupBy("digest").count().filter(F.col("count") * HOT_DIGESTS >= keyed.count())
    return many.orderBy(F.desc("count"), "digest").limit(HOT_DIGESTS).select("digest").join(counts, "digest")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = cache_folder or default_folder(spark)
    name = version(tokenizer_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    keyed = staged(content.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    cached = open_cache(spark, folder).filter(F.col("tokenizer") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = staged(keyed.select("digest").distinct().join(cached, "digest", "left_anti"), "token-misses")
    count, distinct = misses.count(), keyed.select("digest").distinct().count()
    if count:
        wanted = content.select("digest", "text")
        if count < distinct:  # texts that the cache knows stay where they are
            hit = in_filter(id_filter(misses.select(F.xxhash64("digest")), count))
            wanted = wanted.filter(hit(F.xxhash64("digest"))).join(misses, "digest", "left_semi")
        # Copies fall away before the shuffle and after it, so a hot text is a row for each task at most.
        once = wanted.groupBy("digest").agg(F.first("text").alias("text"))
        once.mapInArrow(lean(_encode(tokenizer_path, name), tokens=True), CACHE_SCHEMA).write.mode("append").parquet(folder)
    counts = open_cache(spark, folder).filter(F.col("tokenizer") == name).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = staged(_hot(keyed, counts), "token-hot")
    common = keyed.join(F.broadcast(hot), "digest")
    rest = keyed.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(counts, "digest", "left")
    return common.unionByName(rest).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
