"""Zipf-distributed and toy key streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.functions import round_half_up
from waveline.operators.ids import numbered

RUN = 1 << 16

#: Frequencies of keys 1 to 8.
TOY = (3, 5, 10, 8, 2, 2, 10, 14)


def zipf_ranks(spark: SparkSession, domain: int, n: int, s: float = 1.0, denominator: str = "domain") -> DataFrame:
    """(rank, p, freq); ``denominator`` "elements" normalises over n ranks in place of the domain's."""
    size = domain if denominator == "domain" else n
    total = spark.range(1, size + 1).agg(F.sum(F.pow(F.col("id").cast("double"), F.lit(-float(s)))).alias("total"))
    ranks = spark.range(1, domain + 1).crossJoin(F.broadcast(total))
    p = F.pow(F.col("id").cast("double"), F.lit(-float(s))) / F.col("total")
    return ranks.select(F.col("id").alias("rank"), p.alias("p"), round_half_up(F.lit(float(n)) * p).alias("freq"))


def zipf_listing(spark: SparkSession, domain: int, n: int, s: float = 1.0, seed: int = 42, **how) -> DataFrame:
    """(rank, key, p, freq): ranks are given to keys in a hashed order of the domain."""
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rank").cast("string")).cast("binary"))
    return numbered(zipf_ranks(spark, domain, n, s, **how).withColumn("_order", hashed), ["_order", "rank"], "key").select("rank", "key", "p", "freq")


def zipf_frequencies(spark: SparkSession, domain: int, n: int, s: float = 1.0, seed: int = 42, **how) -> DataFrame:
    """(rank, key, freq)."""
    return zipf_listing(spark, domain, n, s, seed, **how).select("rank", "key", "freq")


def repeat(freq: DataFrame) -> DataFrame:
    """A key row for every count, in runs of at most ``RUN`` from one row, so a hot key is dealt out."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("freq") - 1) / RUN)))
    parts = freq.where("freq > 0").select("key", "freq", runs.alias("run"))
    size = F.least(F.col("freq") - F.col("run") * RUN, F.lit(RUN)).cast("int")
    return parts.select("key", F.explode(F.sequence(F.lit(1), size)).alias("n")).select("key")


def toy(spark: SparkSession) -> DataFrame:
    return repeat(spark.createDataFrame(list(enumerate(TOY, 1)), "key long, freq long"))
