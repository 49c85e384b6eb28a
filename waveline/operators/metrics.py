"""Sum of squared errors between two frequency tables (key, freq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.functions import round_half_up
from waveline.operators.reconstruct import at_keys


def sse(a: DataFrame, b: DataFrame, mode: str = "inner") -> DataFrame:
    """One row ``sse``; "inner" takes keys of both tables, "full" counts a missing key as 0."""
    a, b = a.select("key", F.col("freq").alias("fa")), b.select("key", F.col("freq").alias("fb"))
    gap = F.coalesce("fa", F.lit(0)) - F.coalesce("fb", F.lit(0))
    return a.join(b, "key", "inner" if mode == "inner" else "full").agg(F.coalesce(F.sum(gap * gap), F.lit(0)).alias("sse"))


def sse_grouped(a: DataFrame, b: DataFrame) -> DataFrame:
    """The inner form without a join: union, signed sums, keys that occur twice."""
    both = a.select("key", F.col("freq").alias("f")).unionAll(b.select("key", (-F.col("freq")).alias("f")))
    return both.groupBy("key").agg(F.sum("f").alias("gap"), F.count("*").alias("n")).where("n = 2").agg(F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("sse"))


def sse_of_pairs(lines: DataFrame) -> DataFrame:
    """One row ``sse`` of (key, freq) lines of two tables in one: keys with two lines count, whichever table they are of."""
    gap = F.max("freq") - F.min("freq")
    return lines.groupBy("key").agg(gap.alias("gap"), F.count("*").alias("n")).where("n = 2").agg(F.coalesce(F.sum(F.col("gap") * F.col("gap")), F.lit(0)).alias("sse"))


def sse_segments(freq: DataFrame, runs: DataFrame, mode: str = "full") -> DataFrame:
    """One row ``sse`` between a frequency table and a histogram's rounded segments.

    No key of the domain is made that doesn't occur: the keys that don't have their
    segments' squares in total less those of the keys that do.
    """
    made = runs.withColumn("value", round_half_up(F.col("value")))
    found = at_keys(made, freq.select("key", "freq"))
    gap, square = F.col("freq") - F.col("value"), F.col("value") * F.col("value")
    seen = found.agg(F.coalesce(F.sum(gap * gap), F.lit(0)).alias("gaps"), F.coalesce(F.sum(square), F.lit(0)).alias("squares"))
    if mode == "inner":
        return seen.select(F.col("gaps").alias("sse"))
    whole = made.agg(F.coalesce(F.sum((F.col("hi") - F.col("lo") + 1) * square), F.lit(0)).alias("all_squares"))  # one row
    return seen.crossJoin(F.broadcast(whole)).select((F.col("gaps") + F.col("all_squares") - F.col("squares")).alias("sse"))
