"""Dense ids of composite keys without a single-task sort, and id streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveline.sources.storage import pinned


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Adds 1, 2, ... in the given order.

    Range partitions are numbered on their own and shifted by the rows of the partitions
    before (one row a partition). They are pinned, as their counts must stay true.
    """
    columns = df.columns
    parts = pinned(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_own", own).join(F.broadcast(shift), "_part").select(*columns, (F.col("_before") + F.col("_own")).alias(name))


def dense_ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct ``columns`` with ``id`` 1, 2, ... in their order."""
    return numbered(df.select(*columns).distinct(), columns)


def id_lines(df: DataFrame, columns: list[str], file: str, order: list[str]) -> DataFrame:
    """One comma-joined line of ids for each ``file``, in the order given; a line is a row, so a file's ids must fit in one."""
    named = df.join(dense_ids(df, columns), columns)
    line = F.array_sort(F.collect_list(F.struct(*order, "id")))
    return named.groupBy(file).agg(F.array_join(F.transform(line, lambda x: x["id"].cast("string")), ",").alias("line"))


def id_rows(df: DataFrame, columns: list[str], file: str, order: list[str]) -> DataFrame:
    """(file, ``order``, id) for each record: the same stream for files of any size, sorted within each task."""
    return df.join(dense_ids(df, columns), columns).select(file, *order, "id").repartitionByRange(file, *order).sortWithinPartitions(file, *order)
