"""Binary request logs: 20-byte big-endian records."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = 20


def _int32(content: Column, at: Column) -> Column:
    """Four bytes as a signed number."""
    raw = F.conv(F.hex(F.substring(content, at, F.lit(4))), 16, 10).cast("long")
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def _byte(content: Column, at: Column) -> Column:
    raw = F.conv(F.hex(F.substring(content, at, F.lit(1))), 16, 10).cast("int")
    return F.when(raw >= 128, raw - 256).otherwise(raw).cast("tinyint")


def decode(blobs: DataFrame) -> DataFrame:
    """Records of a ``content`` column; an incomplete record at the end is left out."""
    n = F.floor(F.octet_length("content") / RECORD).cast("int")
    others = [c for c in blobs.columns if c != "content"]
    rows = blobs.where(n > 0).select(*others, "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("_n"))
    at = F.col("_n") * RECORD + 1
    content = F.col("content")
    ints = [_int32(content, at + 4 * i).alias(c) for i, c in enumerate(("ts", "client_id", "object_id", "size"))]
    return rows.select(*others, *ints, *(_byte(content, at + 16 + i).alias(c) for i, c in enumerate(("method", "status", "type", "server"))))


def encode(df: DataFrame) -> DataFrame:
    """A ``record`` of hexadecimal digits for (ts, client_id, object_id, size, method, status, type, server)."""
    four = [F.lpad(F.right(F.hex(F.col(c).cast("long")), F.lit(8)), 8, "0") for c in ("ts", "client_id", "object_id", "size")]
    one = [F.lpad(F.right(F.hex(F.col(c).cast("long")), F.lit(2)), 2, "0") for c in ("method", "status", "type", "server")]
    return df.withColumn("record", F.concat(*four, *one))


FIELDS = "ts int, client_id int, object_id int, size int, method byte, status byte, type byte, server byte"


def _records(log: str | None):
    def rows(records: Iterable[bytes]) -> Iterator[tuple]:
        return (struct.unpack(">4i4b", r) + (() if log is None else (log,)) for r in records)

    return rows


def read(spark: SparkSession, path: str, glob: str = "[!.]*[!z]", with_log: bool = False) -> DataFrame:
    """Records of all files of a folder but compressed ones (``.gz``), and the file's name as ``log``.

    Files of whole records are split by record, so they may have any size. A file with an
    incomplete record at its end is read as one row (up to 2 GB), without that record.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where(~F.col("path").endswith(".gz"))
    name = F.element_at(F.split("path", "/"), -1).alias("log")
    own = ["log"] * with_log
    out = decode(files.where(F.col("length") % RECORD != 0).select("content", name).select("content", *own))
    whole = files.where((F.col("length") % RECORD == 0) & (F.col("length") > 0)).select("path", name).collect()  # as many as there are files
    if not whole:
        return out
    groups = [(r["path"], r["log"]) for r in whole] if with_log else [(",".join(r["path"] for r in whole), None)]
    sc = spark.sparkContext
    parts = sc.union([sc.binaryRecords(paths, RECORD).mapPartitions(_records(log)) for paths, log in groups])
    return out.unionByName(spark.createDataFrame(parts, FIELDS + ", log string" * with_log))


def write_requests(records: DataFrame, path: str, by: str | None = None) -> None:
    """client, object, timestamp as CSV; with ``by``, a folder ``by=<value>`` for each value, such as each log."""
    rows = records.select(*[by] * bool(by), "client_id", "object_id", "ts")
    (rows.write.partitionBy(by) if by else rows.write).mode("overwrite").csv(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """client, object, timestamp of CSV files, and the folder's partition column if there is one."""
    return spark.read.schema("client_id int, object_id int, ts int").csv(path)
