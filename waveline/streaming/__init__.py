"""Running coefficients of a key stream (an extension: the transform is linear)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waveline.operators import haar


def running_coefficients(keys: DataFrame, levels: int) -> DataFrame:
    """A streaming aggregation of (idx, coef); the state holds a row for each index that has occurred.

    For output modes "update" and "complete". Coefficients that have come to zero are
    shown, as an update must replace what it showed before.
    """
    from pyspark.sql import functions as F

    from waveline.functions import path_sign, support_size

    share = path_sign(F.col("key"), F.col("level")) / support_size(F.col("level"), levels)
    return haar.paths(keys.select("key"), levels).groupBy("idx").agg(F.sum(share).alias("coef"))
