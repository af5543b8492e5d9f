"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset on one machine (tests) a temporary one is set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*)?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="spark-"))
    return found or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its partitions and their order as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
