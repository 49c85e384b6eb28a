"""Key streams (key, node, pos) from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("key"), F.col("l_linenumber").cast("long").alias("node"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("key"), F.col("l_linenumber").cast("long").alias("node"))


def events(spark: SparkSession, sf_dir: str, positions: bool = True) -> DataFrame:
    """A skewed stream of 64 keys; ``pos`` counts a node's records in order of the event.

    A node stands for a split, which one task reads: its records are ordered in one.
    """
    df = table(spark, sf_dir, "events").select("event_id", F.least(F.floor(F.col("value") / 8) + 1, F.lit(64)).cast("long").alias("key"), (F.col("user_id") % 8).alias("node"))
    if not positions:
        return df.select("key", "node")
    return df.withColumn("pos", (F.row_number().over(Window.partitionBy("node").orderBy("event_id")) - 1).cast("long")).drop("event_id")
