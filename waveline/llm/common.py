"""Shared helpers: session settings, scratch storage and Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
SHINGLE_WORDS = 5
NEAR_SIMILARITY = 0.8


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python workers by bytes as well as rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    with contextlib.suppress(Exception):  # a session may pin it
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset a local folder serves a single machine (tests); on a cluster that
    would lose data, so there it is an error.
    """
    held = spark.sparkContext.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        if not named:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = os.path.join(tempfile.gettempdir(), "waveline-checkpoints")
        spark.sparkContext.setCheckpointDir(named)
        held = spark.sparkContext.getCheckpointDir()
    return named or held


class Scratch:
    """Tables written to the shared folder, deleted when the block ends.

    Results that outlive the block go through ``keep``, a checkpoint. Spark removes its
    files once nothing refers to them if the session was started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``; else they stay in the folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{scratch_dir(spark).rstrip('/')}/waveline-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs (it acts on collected references)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give a Python worker's free memory back, for it is kept between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def with_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with null texts as empty strings."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``h1``/``h2``, a 96-bit row key, so null or repeated ids do no harm."""
    return with_text(docs).withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.hash("doc_id", "text")})


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as one uint8 array and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    else:
        column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column``, one row at least."""
    _, offsets = buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(31))
        x = x * _U(0x7FB5D329728EA185)
        x = x ^ (x >> _U(27))
        x = x * _U(0x81DADEF4BC2DD44D)
        return x ^ (x >> _U(33))


#: Longer runs of bytes are hashed one at a time.
_LONG = 128
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its end, eight at a time with a mix after each."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(eight[starts] & _MASKS[np.minimum(size, 8)] ^ size.astype(np.uint64) * _ODD)
        at, left, own = starts, size, np.arange(len(starts))
        while True:
            more = np.flatnonzero((left > 8) & (size[own] <= _LONG))
            if not len(more):
                break
            at, left, own = at[more] + 8, left[more] - 8, own[more]
            out[own] = mix(out[own] * _ODD + (eight[at] & _MASKS[np.minimum(left, 8)]))
    view = memoryview(padded)
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(view[starts[i] : ends[i]])
    return out


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = True
_WORD[0x80:] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and the word offsets of the rows.

    Words are lower-cased runs of ASCII letters and digits and of all non-ASCII
    characters; other ASCII characters separate them.
    """
    import pyarrow.compute as pc

    data, offsets = buffer(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = np.empty(n + 1, bool)
    inside[:n] = _WORD[data]
    inside[n] = False
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[: n - 1]
    cuts = offsets[:-1][offsets[:-1] < n]
    before[cuts] = False  # rows don't run into each other
    starts = np.flatnonzero(inside[:n] & ~before)
    after = inside[1:].copy()
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside[:n] & ~after) + 1
    hashes = run_hashes(data, starts, ends)
    rows = np.searchsorted(starts, offsets)
    return hashes, rows


def shingle_hashes(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text is one shingle, an empty one none."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    with np.errstate(over="ignore"):
        out = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            out = out * _U(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j]
    return mix(out + _U(k))


def digest(data: bytes | np.ndarray) -> int:
    """Signed 64-bit hash of some bytes."""
    x = xxhash.xxh3_64_intdigest(data)
    return x - (1 << 64) if x >= 1 << 63 else x
