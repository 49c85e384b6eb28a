"""Systematic sampling, threshold-pruned sampling and two-level sampling of key streams.

Streams have (key, node, pos); ``pos`` counts a node's records. ``scale`` "actual"
divides by the rate sampled (1 / step), "nominal" by 1 / (eps**2 n).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveline.functions import coin, round_half_up
from waveline.operators import haar

SEED = 42


def rate(keys: DataFrame, eps: float, n: int | None = None, scale: str = "actual") -> DataFrame:
    """One row: step and p."""
    total = keys.agg(F.count("*").alias("n")) if n is None else keys.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"))
    wide = F.lit(float(eps)) * F.lit(float(eps)) * F.col("n")
    step = F.greatest(F.lit(1).cast("long"), round_half_up(wide))
    return total.select(step.alias("step"), (F.lit(1.0) / (step.cast("double") if scale == "actual" else wide)).alias("p"))


def systematic(keys: DataFrame, eps: float, **how) -> DataFrame:
    """Every step-th record of each node, with step and p."""
    return keys.crossJoin(F.broadcast(rate(keys, eps, **how))).where(F.col("pos") % F.col("step") == 0)


def pairs(keys: DataFrame, eps: float, **how) -> DataFrame:
    """(node, key, c, p): sampled counts of each node."""
    return systematic(keys, eps, **how).groupBy("node", "key", "p").agg(F.count("*").alias("c"))


def with_totals(sampled: DataFrame) -> DataFrame:
    """Adds tj, the node's sampled records."""
    return sampled.join(sampled.groupBy("node").agg(F.sum("c").alias("tj")), "node")


def basic_estimate(keys: DataFrame, eps: float, **how) -> DataFrame:
    return systematic(keys, eps, **how).groupBy("key", "p").agg(F.count("*").alias("c")).select("key", round_half_up(F.col("c") / F.col("p")).alias("freq"))


def improved_pairs(keys: DataFrame, eps: float, **how) -> DataFrame:
    """(node, key, c, p) whose count reaches eps times the node's sample."""
    return with_totals(pairs(keys, eps, **how)).where(F.col("c") >= F.lit(float(eps)) * F.col("tj")).select("node", "key", "c", "p")


def improved_estimate(keys: DataFrame, eps: float, **how) -> DataFrame:
    return improved_pairs(keys, eps, **how).groupBy("key", "p").agg(F.sum("c").alias("c")).select("key", round_half_up(F.col("c") / F.col("p")).alias("freq"))


def em(eps: float, m: int) -> float:
    return m**0.5 * eps


def twolevel_pairs(keys: DataFrame, eps: float, m: int, seed: int = SEED, **how) -> DataFrame:
    """(node, key, c, p): large counts as they are; of small ones a marker 0 with a chance in proportion."""
    e = F.lit(em(eps, m))
    level = F.when(F.col("c") >= F.lit(1.0) / e, F.col("c")).when(coin(seed, "node", "key") <= e * F.col("c"), F.lit(0).cast("long"))
    return pairs(keys, eps, **how).withColumn("c", level).where("c is not null").select("node", "key", "c", "p")


def twolevel_estimate(keys: DataFrame, eps: float, m: int, seed: int = SEED, variant: bool = False, **how) -> DataFrame:
    """Truncated estimates; the variant rounds the markers' part first."""
    marks = F.col("marks") / F.lit(em(eps, m))
    marks = round_half_up(marks) if variant else marks
    sums = twolevel_pairs(keys, eps, m, seed, **how).groupBy("key", "p").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 0).alias("marks"))
    return sums.select("key", ((F.col("c") + marks) / F.col("p")).cast("long").alias("freq"))


def topk(estimate: DataFrame, levels: int, k: int) -> DataFrame:
    return haar.top(haar.coefficients(estimate, levels), k)


def _statistics(keys: DataFrame, sampled: DataFrame) -> DataFrame:
    everything = keys.groupBy("node", "key").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("records"), F.count("*").alias("items"))
    some = sampled.groupBy("node").agg(F.sum("c").alias("sampled"), F.count("*").alias("sampled_items"))
    return everything.join(some, "node", "left")


def improved_statistics(keys: DataFrame, eps: float, **how) -> DataFrame:
    """For each node: records, items, sampled, sampled_items, threshold, passed."""
    passed = improved_pairs(keys, eps, **how).groupBy("node").agg(F.count("*").alias("passed"))
    found = _statistics(keys, pairs(keys, eps, **how)).join(passed, "node", "left")
    return found.select("node", "records", "items", "sampled", "sampled_items", (F.lit(float(eps)) * F.col("sampled")).alias("threshold"), F.coalesce("passed", F.lit(0).cast("long")).alias("passed"))


def twolevel_statistics(keys: DataFrame, eps: float, m: int, seed: int = SEED, **how) -> DataFrame:
    """For each node: records, items, sampled, sampled_items, threshold, passed (exact), passed_2nd (markers)."""
    passed = twolevel_pairs(keys, eps, m, seed, **how).groupBy("node").agg(F.count_if(F.col("c") > 0).alias("passed"), F.count_if(F.col("c") == 0).alias("passed_2nd"))
    found = _statistics(keys, pairs(keys, eps, **how)).join(passed, "node", "left")
    zero = F.lit(0).cast("long")
    return found.select("node", "records", "items", "sampled", "sampled_items", (F.lit(1.0) / F.lit(em(eps, m))).alias("threshold"), F.coalesce("passed", zero).alias("passed"), F.coalesce("passed_2nd", zero).alias("passed_2nd"))
