"""Cutting lineage: a frame written below the session's checkpoint folder and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="grafloom-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/graph/{label}-{uuid.uuid4().hex}"


#: Whether what a statement shuffled is deleted at its end, not when the driver next collects garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path, before = new_folder(spark, label), spark.conf.get(_CLEANED)
    spark.conf.set(_CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)
