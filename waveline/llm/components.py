"""Connected components of a large edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label (the least id of the component) for every id of ``edges`` (a, b).

    Each round takes the least label among neighbours and then the label's label, so
    long chains shrink fast; every round is a written table. Ends when no label moves.
    """
    both = scratch.table(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        near = scratch.table(both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near")))
        moved = scratch.table(labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jump = moved.select(F.col("id").alias("label"), F.col("label").alias("far"))
        moved = scratch.table(moved.join(jump, "label").select("id", "old", F.least("label", "far").alias("label")))
        labels = moved.select("id", "label")
        if moved.where("label <> old").isEmpty():
            return labels
