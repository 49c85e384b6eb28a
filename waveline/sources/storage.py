"""The shared folder of a session, and tables that are kept in it."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a single machine a local one where it is unset, on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "waveline-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/waveline-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """The rows as they are in their partitions, whatever is read again or lost; files stay as for any checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()
