"""Frequencies and piecewise-constant histograms from a coefficient set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.functions import bits, path_sign, round_half_up
from waveline.operators import haar


def frequencies(coefs: DataFrame, levels: int, keys: DataFrame | None = None) -> DataFrame:
    """(key, value) for all keys of the domain or those given; an absent coefficient is 0.

    Paths of keys meet the coefficients in an equi-join, which the planner broadcasts when they are few.
    """
    spark = coefs.sparkSession
    keys = spark.range(1, (1 << levels) + 1).select(F.col("id").alias("key")) if keys is None else keys.select("key").distinct()
    part = F.coalesce("coef", F.lit(0.0)) * path_sign(F.col("key"), F.col("level"))
    return haar.paths(keys, levels).join(coefs.select("idx", "coef"), "idx", "left").groupBy("key").agg((F.sum(part) + F.lit(0.0)).alias("value"))


def rounded(values: DataFrame) -> DataFrame:
    return values.select("key", round_half_up(F.col("value")).alias("freq"))


def segments(coefs: DataFrame, levels: int) -> DataFrame:
    """(lo, hi, value): the runs of equal value, at most three for each coefficient and one more.

    The breakpoints of the synopsis are ordered in one task: a top-k set is small by its k.
    Keys outside the domain make coefficients of higher indexes, which no key of the
    domain has on its path: beyond twice the domain, where their support would be less
    than one key, they have no segment.
    """
    spark, top = coefs.sparkSession, 1 << levels
    inner = coefs.where((F.col("idx") > 1) & (F.col("idx") <= 2 * top)).select((F.col("idx") - 1).alias("z")).withColumn("depth", bits(F.col("z")))
    size = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(levels) - F.col("depth")).cast("int"))
    start = (F.col("z") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth").cast("int"))) * size + 1
    breaks = inner.select(F.explode(F.array(start, start + F.expr("1L") * (size / 2).cast("long"), start + size)).alias("lo"))
    breaks = breaks.unionAll(spark.createDataFrame([(1,)], "lo long")).where(F.col("lo") <= top).distinct()
    runs = breaks.withColumn("hi", F.coalesce(F.lead("lo").over(Window.orderBy("lo")) - 1, F.lit(top).cast("long")))
    values = frequencies(coefs, levels, breaks.select(F.col("lo").alias("key")))
    return runs.join(values.withColumnRenamed("key", "lo"), "lo").select("lo", "hi", "value")


def at_keys(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` with the value of their segment.

    Segments and keys meet in an equi-join by the upper bits of a key; the lower bits are
    so many that segments fall into no more parts than twice their number.
    """
    size = runs.agg(F.count("*").alias("n"), F.coalesce(F.max("hi"), F.lit(1)).alias("top")).first()
    low = max(0, (int(size["top"]) // max(1, size["n"])).bit_length())
    part = lambda c: F.call_function("shiftright", F.col(c), F.lit(low))
    dealt = runs.withColumn("_part", F.explode(F.sequence(part("lo"), part("hi"))))
    return keys.withColumn("_part", part("key")).join(dealt, "_part").where(F.col("key").between(F.col("lo"), F.col("hi"))).select(*keys.columns, "value")


def range_sum(runs: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: the estimated number of records with keys from lo to hi."""
    width = F.least("hi", F.lit(hi)) - F.greatest("lo", F.lit(lo)) + 1
    return runs.where((F.col("hi") >= lo) & (F.col("lo") <= hi)).agg(F.coalesce(F.sum(F.col("value") * width), F.lit(0.0)).alias("total"))
