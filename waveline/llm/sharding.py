"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only).

Rows are put in one global order (``doc_id``, then the text's crc32) by range
partitioning; each partition's byte total is prefix-summed, which gives every row
its global byte offset, and the offsets are cut at equal targets. Only ids, sizes
and checksums move unless ``carry`` asks for more columns.

Defined results: a null text has no bytes (size 8, crc32 0); null ids come first;
repeated rows are separate rows and may lie in different shards; an empty table
gives no rows. A shard's bytes differ from the target by less than one row's size.
Columns of the input other than ``doc_id``, ``text`` and those carried are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir

ROW_BYTES = 8


def assign(docs: DataFrame, shards: int = 24, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and ``carry``) for every row."""
    scratch_dir(docs.sparkSession)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
        *carry,
    )
    order = ["doc_id", "text_crc32", "size", "_tie"]
    # the checkpoint pins which rows a partition holds; its totals must stay true
    rows = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(  # one row a partition
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    local = Window.partitionBy("_part").orderBy(*order)
    placed = (
        rows.withColumn("_end", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(local))
        .join(F.broadcast(totals), "_part")
        .withColumn("_middle2", 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(_middle2 * {int(shards)}) div (2 * _total)")).cast("int"))
        .withColumn("_index", F.col("_rows_before") + F.col("_nth") - 1)
    )
    # a shard's first row index follows from the rows before it: one row for each shard
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot"), *carry)


def write(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Writes texts as ``path/shard=<n>/``, rows in slot order within each file."""
    placed = assign(docs, shards, carry=("text",))
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
