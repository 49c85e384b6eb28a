"""Exact top-k coefficients: central, by local transforms, and in three rounds with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.operators import haar


def frequency(keys: DataFrame) -> DataFrame:
    return keys.groupBy("key").agg(F.count("*").alias("freq"))


def local_frequency(keys: DataFrame) -> DataFrame:
    return keys.groupBy("node", "key").agg(F.count("*").alias("freq"))


def central_topk(keys: DataFrame, levels: int, k: int) -> DataFrame:
    """One transform of the global frequencies."""
    return haar.top(haar.coefficients(frequency(keys), levels), k)


def local_coefficients(keys: DataFrame, levels: int) -> DataFrame:
    return haar.coefficients(local_frequency(keys), levels, by=("node",))


def local_topk(keys: DataFrame, levels: int, k: int) -> DataFrame:
    """Local transforms, summed by index."""
    return haar.top(haar.add(local_coefficients(keys, levels)), k)


def two_sided(local: DataFrame, k: int) -> DataFrame:
    """(node, idx, coef, band, place): each node's k lowest negatives (-1) and k highest positives (+1)."""
    low = Window.partitionBy("node").orderBy(F.col("coef").asc(), F.col("idx").asc())
    high = Window.partitionBy("node").orderBy(F.col("coef").desc(), F.col("idx").asc())
    # a filter on row_number lets each task keep k rows a node before the shuffle
    below = local.where("coef < 0").withColumn("place", F.row_number().over(low)).where(F.col("place") <= k).withColumn("band", F.lit(-1).cast("byte"))
    above = local.where("coef > 0").withColumn("place", F.row_number().over(high)).where(F.col("place") <= k).withColumn("band", F.lit(1).cast("byte"))
    return below.unionByName(above).select("node", "idx", "coef", "band", "place")


def node_bounds(nodes: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """(node, hi, lo): what an unsent coefficient of the node can be at most and at least."""
    cut = sent.where(F.col("place") == k).groupBy("node").agg(F.max(F.when(F.col("band") == 1, F.col("coef"))).alias("hi"), F.min(F.when(F.col("band") == -1, F.col("coef"))).alias("lo"))
    return nodes.join(cut, "node", "left").select("node", F.coalesce("hi", F.lit(0.0)).alias("hi"), F.coalesce("lo", F.lit(0.0)).alias("lo"))


def _tau():
    """Least magnitude that the bounds allow."""
    return F.when((F.col("upper") > 0) & (F.col("lower") < 0), F.lit(0.0)).otherwise(F.least(F.abs("upper"), F.abs("lower")))


def bound_table(sent: DataFrame, bounds: DataFrame) -> DataFrame:
    """(idx, partial_sum, upper, lower, tau) of every index sent in round 1."""
    whole = bounds.agg(F.coalesce(F.sum("hi"), F.lit(0.0)).alias("all_hi"), F.coalesce(F.sum("lo"), F.lit(0.0)).alias("all_lo"))  # one row
    seen = sent.join(bounds, "node").groupBy("idx").agg(F.sum("coef").alias("partial_sum"), F.sum("hi").alias("s_hi"), F.sum("lo").alias("s_lo"))
    table = seen.crossJoin(F.broadcast(whole)).select("idx", "partial_sum", (F.col("partial_sum") + (F.col("all_hi") - F.col("s_hi"))).alias("upper"), (F.col("partial_sum") + (F.col("all_lo") - F.col("s_lo"))).alias("lower"))
    return table.withColumn("tau", _tau())


def kth_bound(table: DataFrame, k: int) -> DataFrame:
    """One row: the k-th largest tau, 0 with fewer than k rows."""
    best = table.select("tau").orderBy(F.col("tau").desc()).limit(k)
    return best.agg(F.when(F.count("*") == k, F.min("tau")).otherwise(F.lit(0.0)).alias("bound"))


def cuts(sent: DataFrame, k: int) -> DataFrame:
    """(node, hi, hi_idx, lo, lo_idx): the last coefficients that a node sent in round 1, null where it sent all of a sign."""
    last = lambda band, c: F.max(F.when((F.col("band") == band) & (F.col("place") == k), F.col(c)))
    return sent.groupBy("node").agg(last(1, "coef").alias("hi"), last(1, "idx").alias("hi_idx"), last(-1, "coef").alias("lo"), last(-1, "idx").alias("lo_idx"))


def unsent(local: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, idx, coef) that round 1 didn't send, told by the node's last ones (one row a node) in place of a join by index."""
    coef, idx = F.col("coef"), F.col("idx")
    high = (coef > 0) & (F.col("hi").isNull() | (coef > F.col("hi")) | (coef == F.col("hi")) & (idx <= F.col("hi_idx")))
    low = (coef < 0) & (F.col("lo").isNull() | (coef < F.col("lo")) | (coef == F.col("lo")) & (idx <= F.col("lo_idx")))
    return local.join(F.broadcast(edges), "node").where(~(high | low) & (coef != 0)).select("node", "idx", "coef")


def round2(rest: DataFrame, bound: DataFrame, nodes: int) -> DataFrame:
    """(node, idx, coef) of those not sent whose magnitude reaches bound / nodes."""
    return rest.crossJoin(F.broadcast(bound)).where(F.abs("coef") * nodes >= F.col("bound")).select("node", "idx", "coef")


def candidates(sent: DataFrame, more: DataFrame, bound: DataFrame, nodes: int, k: int) -> DataFrame:
    """(idx, partial_sum) of indexes whose total may be among the k largest; bounds are kept times ``nodes`` so no division rounds."""
    seen = sent.select("idx", "coef").unionByName(more.select("idx", "coef")).groupBy("idx").agg(F.sum("coef").alias("partial_sum"), F.count("*").alias("n"))
    room = (F.lit(nodes) - F.col("n")) * F.col("bound")
    table = seen.crossJoin(F.broadcast(bound)).select("idx", "partial_sum", (F.col("partial_sum") * nodes + room).alias("upper"), (F.col("partial_sum") * nodes - room).alias("lower")).withColumn("tau", _tau())
    second = kth_bound(table, k).select(F.col("bound").alias("second"))
    return table.crossJoin(F.broadcast(second)).where(F.greatest(F.abs("upper"), F.abs("lower")) >= F.col("second")).select("idx", "partial_sum")


def round3(rest: DataFrame, wanted: DataFrame, bound: DataFrame, nodes: int) -> DataFrame:
    """(node, idx, coef) of candidates that neither round sent."""
    left = rest.crossJoin(F.broadcast(bound)).where(F.abs("coef") * nodes < F.col("bound")).select("node", "idx", "coef")
    return left.join(wanted.select("idx"), "idx", "left_semi").select("node", "idx", "coef")


def totals(wanted: DataFrame, last: DataFrame) -> DataFrame:
    """(idx, coef): what round 3 sent is added to the partial sums."""
    return haar.add(wanted.select("idx", F.col("partial_sum").alias("coef")).unionByName(last.select("idx", "coef")))


def three_round_topk(keys: DataFrame, levels: int, k: int) -> DataFrame:
    """Two-sided threshold top-k over nodes: equal to ``central_topk``, with less sent between rounds.

    The rounds run when this is called, since each needs the bound of the one before; the
    result has k rows. What is held between rounds is the local coefficients, and is
    released at the end.
    """
    local = local_coefficients(keys, levels).persist()
    spark = keys.sparkSession
    try:
        sent = two_sided(local, k)
        # at most 2 k rows a node
        held = sent.select("node", "idx", "coef", "band", "place").persist()
        try:
            nodes = local.select("node").distinct()
            m = nodes.count()
            bound = spark.createDataFrame([(kth_bound(bound_table(held, node_bounds(nodes, held, k)), k).first()["bound"],)], "bound double")
            rest = unsent(local, cuts(held, k))
            wanted = candidates(held, round2(rest, bound, m), bound, m, k)
            rows = haar.top(totals(wanted, round3(rest, wanted, bound, m)), k).collect()  # k at most
        finally:
            held.unpersist()
    finally:
        local.unpersist()
    return spark.createDataFrame(rows, "idx long, coef double")
