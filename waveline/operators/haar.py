"""The Haar transform of a sparse frequency vector as an aggregation.

A frequency adds to ``levels + 1`` coefficients, those on the path above its key. The
paths are exploded and summed by index, so partial aggregation collapses the upper
levels before the shuffle and memory follows the distinct keys, not the domain.
Contributions are dyadic, so double sums are exact in any order below 2**53.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveline.functions import path_index, path_sign, support_size


def check_levels(levels: int) -> int:
    if not 1 <= levels <= 52:
        raise ValueError("levels: 1 to 52")
    return levels


def paths(df: DataFrame, levels: int) -> DataFrame:
    """Adds ``level`` (0 to ``levels``) and ``idx`` for every key."""
    steps = F.sequence(F.lit(0), F.lit(check_levels(levels)))
    return df.withColumn("level", F.explode(steps)).withColumn("idx", path_index(F.col("key"), F.col("level"), levels))


def kept() -> Column:
    """Zero details go, the average stays."""
    return (F.col("coef") != 0) | (F.col("idx") == 1)


def coefficients(freq: DataFrame, levels: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, idx, coef) of (by, key, freq); details are half differences, right minus left."""
    share = F.col("freq") / support_size(F.col("level"), levels) * path_sign(F.col("key"), F.col("level"))
    return paths(freq, levels).groupBy(*by, "idx").agg(F.sum(share).alias("coef")).where(kept())


def add(coefs: DataFrame) -> DataFrame:
    """Sum of coefficients with equal index: the transform is linear."""
    return coefs.groupBy("idx").agg(F.sum("coef").alias("coef")).where(kept())


def top(coefs: DataFrame, k: int, levels: int | None = None, normalize: bool = False) -> DataFrame:
    """The k coefficients of the largest magnitude, ties by index; ``normalize`` ranks by magnitude times the root of the support."""
    size = F.abs("coef")
    if normalize:
        support = F.when(F.col("idx") == 1, F.lit(2.0 ** check_levels(levels))).otherwise(F.pow(F.lit(2.0), F.lit(levels) - (F.length(F.bin(F.col("idx") - 1)) - 1)))
        size = size * F.sqrt(support)
    return coefs.orderBy(size.desc(), F.col("idx").asc()).limit(k)
