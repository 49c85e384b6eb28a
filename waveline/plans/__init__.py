"""Whole programs: compositions of sources and operators by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveline.operators import exact, haar, metrics, reconstruct, sampling
from waveline.sources import text
from waveline.sources.storage import pinned


def synopsis(keys: DataFrame, method: str, levels: int, k: int, eps: float = 1e-4, m: int | None = None) -> DataFrame:
    """Top-k coefficients by "central", "local", "three_round", "basic", "improved", "twolevel" or "twolevel_variant"."""
    if method == "central":
        return exact.central_topk(keys, levels, k)
    if method == "local":
        return exact.local_topk(keys, levels, k)
    if method == "three_round":
        return exact.three_round_topk(keys, levels, k)
    m = keys.select("node").distinct().count() if m is None and method.startswith("twolevel") else m
    estimate = {
        "basic": lambda: sampling.basic_estimate(keys, eps),
        "improved": lambda: sampling.improved_estimate(keys, eps),
        "twolevel": lambda: sampling.twolevel_estimate(keys, eps, m),
        "twolevel_variant": lambda: sampling.twolevel_estimate(keys, eps, m, variant=True),
    }[method]()
    return haar.top(haar.coefficients(estimate, levels), k)


def error(keys: DataFrame, coefs: DataFrame, levels: int, mode: str = "full") -> DataFrame:
    """The squared error of a synopsis against the stream's true frequencies, by segments.

    The synopsis and its segments are made once, when this is called.
    """
    return metrics.sse_segments(exact.frequency(keys), pinned(reconstruct.segments(pinned(coefs), levels)), mode)


def reconstruct_file(spark: SparkSession, coefs: str, levels: int, out: str) -> None:
    """Coefficients of a text file to a listing of all keys with their rounded frequencies."""
    text.write_listing(reconstruct.rounded(reconstruct.frequencies(text.read_coefficients(spark, coefs), levels)), out)


def error_of_files(spark: SparkSession, a: str, b: str, out: str | None = None, mode: str = "inner") -> DataFrame:
    """The squared error between two frequency files, written to a file as well if one is named."""
    found = metrics.sse(text.read_frequencies(spark, a), text.read_frequencies(spark, b), mode)
    if out:
        found.select(F.col("sse").cast("string").alias("value")).write.mode("overwrite").text(out)
    return found


def error_of_folder(spark: SparkSession, path: str) -> DataFrame:
    """The grouped form for the frequency files of a folder: of keys in exactly two lines, the squared difference."""
    return metrics.sse_of_pairs(text.read_frequencies(spark, path))
