"""Removal of byte strings that occur more than once, by suffix arrays.

A byte is removed when some string of ``length`` bytes covers it that also starts
anywhere else, in the same document or another.

1. Equal texts are one text; with copies it is repeated whole. In every window of
   ``length`` bytes the 32-byte gram with the least hash (the leftmost of equals) is
   its anchor, a choice that depends on the window's bytes alone, so equal windows have
   equal anchors. An anchor's context is all bytes of windows that may have it.
2. Before anything is gathered, equal strings are counted: contexts first, then the
   halves of contexts (all windows of a half hold the same core). What occurs twice is
   repeated whole, and one of its places stays, with its number, to be compared with
   other strings. Only halves with a core that another half has too can hold a further
   repeat; their bytes are dealt out by core.
3. The bytes of a bucket of cores get a suffix array (two-stage sorting) and the
   common prefixes of neighbours in its order: windows in a run of prefixes of
   ``length`` bytes and more are repeated.
   A core whose spans have more than ``GROUP_BYTES`` is too large for a bucket: its
   halves are halved again, as long as cores remain that large; a half of one window is
   its own core, so this ends, and no group is gathered in one task.

Defined results: a null or empty text has nothing to remove, nor has a text of less
than ``length`` bytes, copies or not; repeated rows (equal ids and texts too) are
occurrences of their own; null ids are kept; an empty table gives no rows; columns of
other names are ignored, whatever they are called. Hashes of 96 to 128 bits stand for
texts, contexts and halves, of 64 bits for cores and for 64 bytes in a suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buffer, digest, mix, pieces, prepare, trim
from .suffix_array import _words, common_prefixes, jump_hashes, suffix_order

LENGTH = 400
GRAM = 32
PIECE_BYTES = 1 << 18
GROUP_BYTES = 1 << 21  # of the spans of one core, at most 1.5 lengths each
BUCKET_BYTES = 1 << 18
TRIM_BYTES = 4 << 20

_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 20) - 1)  # a piece and a window have fewer bytes


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    with np.errstate(over="ignore"):
        h, size = _TABLE[data], 1
        while size < GRAM:
            h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
            h ^= h >> np.uint64(29)
            size *= 2
        return h * np.uint64(0xBF58476D1CE4E5B9)


def text_key(docs: DataFrame) -> DataFrame:
    """``text`` (null: empty) with h1 and h2, 96 bits that stand for it."""
    return docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"h1": F.xxhash64("text"), "h2": F.hash("text")})


def _anchors(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Anchor positions of all windows that lie in one document; ``ends`` are the documents' ends."""
    out, span = [np.zeros(0, np.int64)], length - GRAM + 1
    for a in range(0, len(data) - length + 1, PIECE_BYTES):
        x = data[a : a + PIECE_BYTES + length - 1]
        # the upper bits of a gram's hash, and its place: of equal grams the leftmost is least
        least = _grams(x) & ~_PLACE
        least |= np.arange(len(least), dtype=np.uint64)
        width = 1
        while width < span:
            step = min(width, span - width)
            n = len(least) - step
            np.minimum(least[:n], least[step:], out=least[:n])
            least = least[:n]
            width += step
        at = (least & _PLACE).astype(np.int32)
        # windows that run over a document's end are none
        whole = np.ones(len(at), bool)
        for k in range(*np.searchsorted(ends, [a + 1, a + len(at) + length])):
            whole[max(0, ends[k] - length + 1 - a) : max(0, ends[k] - a)] = False
        at = at[whole]
        out.append(at[np.append(True, at[1:] != at[:-1])].astype(np.int64) + a if len(at) else at.astype(np.int64))
    return np.unique(np.concatenate(out))


def _anchor_rows(length: int):
    before, half = length - GRAM, (length - GRAM) // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # keys of the task's texts: of copies one will do
        for whole in batches:
            fresh = []
            for key in zip(whole.column("h1").to_pylist(), whole.column("h2").to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            for batch in pieces(whole.filter(pa.array(fresh, pa.bool_())), limit=PIECE_BYTES):
                data, offsets = buffer(batch.column("text"))
                found = _anchors(data, offsets[1:], length)
                doc = np.searchsorted(offsets, found, "right") - 1
                lo = np.maximum(found - before, offsets[doc])
                hi = np.minimum(found + length, offsets[doc + 1])
                view = memoryview(data)
                begin = offsets[doc]
                for k in range(0, len(found), 8192):
                    part = slice(k, k + 8192)
                    context, left, right, left_all, right_all = [], [], [], [], []
                    for p, a, b in zip(found[part].tolist(), lo[part].tolist(), hi[part].tolist(), strict=True):
                        context.append(xxhash.xxh3_128_digest(view[a:b], seed=p - a))
                        # windows that start up to p - half all hold [p - half, p + GRAM); the others [p, p - half + 1 + length)
                        l1, r0, r1 = min(p - half, b - length), max(a, p - half + 1), min(p, b - length)
                        left.append(digest(view[p - half : p + GRAM]) if a <= l1 else None)
                        left_all.append(digest(view[a : l1 + length]) if a <= l1 else None)
                        right.append(digest(view[p : p - half + 1 + length]) if r0 <= r1 else None)
                        right_all.append(digest(view[r0 : r1 + length]) if r0 <= r1 else None)
                    # of neighbours with one context, as in periodic text, the first and last tell of all
                    own, digests = doc[part], np.array(context, "V16")
                    fresh = np.append(True, (digests[1:] != digests[:-1]) | (own[1:] != own[:-1]))
                    stop = hi[part][np.append(np.flatnonzero(fresh)[1:], len(own)) - 1][np.cumsum(fresh) - 1]
                    kept = pa.array(fresh | np.append(fresh[1:], True))
                    row = pa.RecordBatch.from_arrays(
                        [batch.column("h1").take(pa.array(own)), batch.column("h2").take(pa.array(own)), *(pa.array((x - begin[part]).astype(np.int32)) for x in (found[part], lo[part], hi[part], stop)), pa.array(context, pa.binary()), *(pa.array(x, pa.int64()) for x in (left, right, left_all, right_all))],
                        names=["h1", "h2", "at", "lo", "hi", "stop", "context", "left", "right", "left_all", "right_all"],
                    )
                    yield row.filter(kept)
        trim()

    return rows


def _cut_spans(length: int):
    """Adds to each wanted half the bytes its windows cover; of a text's copies in a task one is read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = []
            for key in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            data, offsets = buffer(batch.column("text"))
            wanted = batch.column("wanted")
            flat = wanted.flatten()
            row = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            s0, s1 = (flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            a, b = offsets[row] + s0, offsets[row] + s1 + length
            for i in range(0, len(row), 2048):
                part = slice(i, i + 2048)
                spans = [data[x:y].tobytes() for x, y in zip(a[part], b[part], strict=True)]
                at = pa.array(row[part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1").take(at), batch.column("h2").take(at), *(flat.field(k)[part] for k in range(7)), pa.array(spans, pa.binary())],
                    names=["h1", "h2", "core", "s0", "s1", "n", "m", "f0", "f1", "span"],
                )
        trim()

    return rows


def _repeated_spans(length: int):
    """Within a bucket: the first and last repeated window of each span."""
    used = [0]  # bytes since memory was given back

    def of(table: pa.Table) -> pa.Table:
        span = table.column("span").combine_chunks()
        data, offsets = buffer(span)
        sizes = np.diff(offsets)
        # a zero follows every span; the bytes of UTF-8 leave room to shift all others by one
        text = np.zeros(len(data) + len(sizes), np.uint8)
        start = offsets[:-1] + np.arange(len(sizes))
        inner = np.ones(len(text), bool)
        inner[start + sizes] = False
        text[inner] = data + np.uint8(1)
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
        words = _words(text)
        jump = jump_hashes(words)
        order = suffix_order(text, length, words, jump, (start, start + sizes - length + 1))  # windows alone
        again = common_prefixes(order, words, jump, length) >= length
        del words, jump, text, inner
        s0 = table.column("s0").to_numpy().astype(np.int64)
        n = table.column("n").to_numpy()
        rows = np.unique(np.stack([table.column("h1").to_numpy(), table.column("h2").to_numpy().astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        run = np.cumsum(~again)
        size = np.bincount(run)
        whole = order + length <= (start + sizes)[item[order]]  # windows don't run over a span's end
        inside = np.flatnonzero((size[run] > 1) & whole)
        order, run = order[inside], run[inside]
        out_lo, out_hi, out_item = [], [], np.zeros(0, np.int64)
        if len(order):
            own = item[order]
            window = s0[own] + order - start[own]
            key = (rows[own].astype(np.int64) << 32) | window  # one position, however many spans show it
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            many = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | (np.maximum.reduceat(n[own], first) > 1)
            hit = np.repeat(many, np.diff(np.append(first, len(run))))
            own, window = own[hit], window[hit]
            by = np.lexsort((window, own))
            own, window = own[by], window[by]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            out_item = own[edge]
            out_lo = window[edge]
            out_hi = window[np.append(edge[1:], len(own)) - 1] + length if len(edge) else out_lo
        at = pa.array(out_item)
        used[0] += len(data)
        if used[0] > TRIM_BYTES:
            used[0] = 0
            trim()
        return pa.table({"h1": table.column("h1").take(at), "h2": table.column("h2").take(at), "lo": pa.array(out_lo, pa.int32()), "hi": pa.array(out_hi, pa.int32())})

    return of


INTERVAL = "h1 long, h2 int, lo int, hi int"


def _in_buckets(spans: DataFrame, length: int, total: int) -> DataFrame:
    buckets = max(1, total * int(1.5 * length) // BUCKET_BYTES)
    dealt = spans.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_repeated_spans(length), INTERVAL)


def _either(spots: DataFrame, one: str, other: str) -> DataFrame:
    """A row of ``one``'s struct and a row of ``other``'s for each row, without a generator."""
    return spots.select("*", f"{one}.*").unionAll(spots.select("*", f"{other}.*"))


def repeated_intervals(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """h1, h2, spans: intervals that cover all repeated bytes, of texts keyed by ``text_key``."""
    if length % 8 or not 2 * GRAM <= length <= 1 << 16:
        raise ValueError("length: a multiple of 8, from 64 to 65,536")
    texts = text_key(docs).where(F.octet_length("text") >= length)
    limit = GROUP_BYTES // int(1.5 * length)
    # a text with copies is repeated whole; it is one text in what follows
    copied = texts.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first(F.octet_length("text")).alias("hi")).where("copies > 1")
    found = [copied.select("h1", "h2", F.lit(0).alias("lo"), F.col("hi").cast("int").alias("hi"))]
    anchors = scratch.table(texts.select("h1", "h2", "text").mapInArrow(_anchor_rows(length), "h1 long, h2 int, at int, lo int, hi int, stop int, context binary, left long, right long, left_all long, right_all long"))
    place = F.xxhash64("h1", "h2", "at")
    # one row for each distinct context, from any of its places
    contexts = scratch.table(
        anchors.groupBy("context")
        .agg(F.min(place).alias("p0"), F.max(place).alias("p1"), *(F.first(c).alias(c) for c in ("h1", "h2", "at", "lo", "hi", "left", "right", "left_all", "right_all")))
        .withColumn("n", F.expr("case when p0 <> p1 then 2L else 1L end"))
        .drop("p0", "p1")
    )
    # a row for each anchor of a repeated context at most, however hot it is
    found.append(anchors.select("context", "h1", "h2", "lo", "stop").join(contexts.where("n > 1").select("context"), "context", "left_semi").select("h1", "h2", "lo", F.col("stop").alias("hi")))
    half = (length - GRAM) // 2
    left = F.struct(F.col("left").alias("core"), F.col("left_all").alias("whole"), F.col("lo").alias("s0"), F.least(F.col("at") - half, F.col("hi") - length).alias("s1"), (F.col("at") - (length - GRAM)).alias("f0"), (F.col("at") - half).alias("f1"))
    right = F.struct(F.col("right").alias("core"), F.col("right_all").alias("whole"), F.greatest(F.col("lo"), F.col("at") - half + 1).alias("s0"), F.least(F.col("at"), F.col("hi") - length).alias("s1"), (F.col("at") - half + 1).alias("f0"), F.col("at").alias("f1"))
    sides = _either(contexts.select("h1", "h2", "n", left.alias("x"), right.alias("y")), "x", "y").drop("x", "y").where("core is not null")
    cores = scratch.table(sides.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"))  # written, so that the planner may split the join's hot cores
    shared = scratch.table(sides.join(cores.select("core").hint("shuffle_hash"), "core"))  # eight bytes a row to hash, many times more to sort
    # halves that are equal as a whole are repeated as a whole; one of them stays to be compared with others of its core
    spots = scratch.table(shared.groupBy("core", "whole").agg(F.count("*").alias("k"), F.max("n").alias("top"), *(F.first(c).alias(c) for c in ("h1", "h2", "s0", "s1", "f0", "f1"))))
    told = shared.where("n = 1").join(spots.where("k > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    found.append(told.select("h1", "h2", F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi")))
    several = scratch.table(spots.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"))
    wanted = scratch.table(spots.withColumn("n", F.greatest(F.when(F.col("k") > 1, 2).otherwise(1), "top")).drop("k", "top").join(several, "core"))
    by_row = scratch.table(wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("core", "s0", "s1", "n", "m", "f0", "f1")).alias("wanted")))  # bounded by the row's text
    # copies of a text meet in one place: the planner may split it
    spans = scratch.table(texts.select("h1", "h2", "text").join(by_row.hint("merge"), ["h1", "h2"]).mapInArrow(_cut_spans(length), "h1 long, h2 int, core long, s0 int, s1 int, n long, m long, f0 int, f1 int, span binary"))
    counted = spans.groupBy((F.col("m") > limit).alias("hot")).count().collect()
    total = {r["hot"]: r["count"] for r in counted}
    found.append(_in_buckets(spans.where(F.col("m") <= limit), length, total.get(False, 0)))
    hot, rest = spans.where(F.col("m") > limit).select("h1", "h2", "s0", "s1", "n", "f0", "f1", "span"), total.get(True, 0)
    while rest:
        # halves are counted from the anchor (f0 to f1), so equal windows fall into equal halves; s0 to s1 are those inside the text
        middle = F.expr("g0 + (g1 - g0) div 2").cast("int")
        parts = hot.withColumnsRenamed({"s0": "t0", "s1": "t1", "f0": "g0", "f1": "g1"})
        parts = _either(parts.withColumns({"x": F.struct(F.col("g0").alias("f0"), middle.alias("f1")), "y": F.struct((middle + 1).alias("f0"), F.col("g1").alias("f1"))}), "x", "y")
        parts = parts.withColumns({"s0": F.greatest("f0", "t0"), "s1": F.least("f1", "t1")}).where("f0 <= f1 and s0 <= s1")
        parts = parts.select(
            "h1", "h2", "n", "s0", "s1", "f0", "f1", F.substring("span", F.col("s0") - F.col("t0") + 1, F.col("s1") - F.col("s0") + length).alias("span"), F.substring("span", F.col("f1") - F.col("t0") + 1, F.col("f0") - F.col("f1") + length).alias("held")
        )
        parts = scratch.table(parts.withColumns({"core": F.xxhash64("held"), "e1": F.xxhash64("span"), "e2": F.hash("span"), "place": F.xxhash64("h1", "h2", "s0")}).drop("held"))
        # equal spans at two places are repeated whole; one of them, that with the least place, stays to be compared
        spots = scratch.table(parts.groupBy("core", "e1", "e2").agg(F.max("n").alias("top"), F.min("place").alias("one"), F.max("place").alias("other")).withColumn("twice", F.expr("one <> other or top > 1")).drop("top", "other"))
        told = parts.select("core", "e1", "e2", "h1", "h2", "s0", "s1").join(spots.where("twice").select("core", "e1", "e2"), ["core", "e1", "e2"], "left_semi")
        found.append(told.select("h1", "h2", F.col("s0").alias("lo"), (F.col("s1") + length).alias("hi")))
        large = scratch.table(spots.groupBy("core").agg(F.count("*").alias("m")).where("m > 1"))
        kept = spots.join(large, "core").select("core", "e1", "e2", F.col("one").alias("place"), "m", F.expr("case when twice then 2L else 1L end").alias("n"))
        again = scratch.table(parts.drop("n").join(kept, ["core", "e1", "e2", "place"]).dropDuplicates(["core", "e1", "e2"]).select("h1", "h2", "core", "s0", "s1", "n", "m", "f0", "f1", "span"))
        counted = {r["hot"]: r["count"] for r in again.groupBy((F.col("m") > limit).alias("hot")).count().collect()}
        if counted.get(False, 0):
            found.append(_in_buckets(again.where(F.col("m") <= limit), length, counted[False]))
        hot, rest = again.where(F.col("m") > limit).select("h1", "h2", "s0", "s1", "n", "f0", "f1", "span"), counted.get(True, 0)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    # one row for each text with a repeat; what it lists is bounded by its length
    return out.groupBy("h1", "h2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _merged(spans: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    if not len(spans):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, hi = np.array(spans, np.int64).T
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.append(True, lo[1:] > hi[:-1])
    edge = np.flatnonzero(new)
    return lo[edge], np.minimum(hi[np.append(edge[1:], len(lo)) - 1], size)


def _cut_rows(names: list[str], with_kept: bool, with_text: bool = False):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                data, offsets = buffer(batch.column("text"))
                spans = batch.column(batch.num_columns - 1)
                flat, to = spans.flatten(), np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
                lo, hi = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
                out: list[tuple] = []
                kept, left = [], []
                for i in range(batch.num_rows):
                    raw = data[offsets[i] : offsets[i + 1]]
                    a, b = _merged(np.stack([lo[to[i] : to[i + 1]], hi[to[i] : to[i + 1]]], axis=1), len(raw))
                    edges = np.concatenate([[0], np.stack([a, b], axis=1).ravel(), [len(raw)]])
                    parts = [raw[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True)]
                    rest = b"".join(parts)
                    out.append((len(raw), len(raw) - len(rest), len(a), hashlib.sha256(rest).hexdigest()))
                    kept.append(rest)
                    if with_text:  # part by part: halves of two characters must not become a third
                        left.append("".join(p.decode("utf-8", "ignore") for p in parts))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                arrays = [batch.column(n) for n in names] + [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                more = {"kept": pa.array(kept, pa.binary())} if with_kept else {}
                more |= {"text": pa.array(left, pa.string())} if with_text else {}
                yield pa.RecordBatch.from_arrays([*arrays, *more.values()], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *more])

    return rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_kept: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, or those as text without characters that were cut in two) for every row."""
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        spans = scratch.keep(repeated_intervals(docs, scratch, length))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    joined = own.join(spans, ["h1", "h2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_rows(["doc_id"], with_kept, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept + ", text string" * with_text)


def clean(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes, all columns; characters that were cut in two go.

    Rows are as many as before. ``n_chars`` follows the text where there is such a
    column; null texts stay null, and texts that are repeated whole become empty. Defined
    results are the module's; columns may have any names.
    """
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        spans = scratch.keep(repeated_intervals(docs, scratch, length))
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    own = docs.withColumns({"_row_h1": F.xxhash64(text), "_row_h2": F.hash(text)})
    joined = own.join(spans.select(F.col("h1").alias("_row_h1"), F.col("h2").alias("_row_h2"), F.col("spans").alias("_row_spans")), ["_row_h1", "_row_h2"], "left").select(*names, "_row_spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in _cut_rows(names, True)(batches):
            kept, cut = batch.column(batch.num_columns - 1), batch.column(len(names) + 1).to_pylist()
            texts = batch.column(place)
            text = pa.array([kept[i].as_py().decode("utf-8", "ignore") if c else texts[i].as_py() for i, c in enumerate(cut)], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == place else batch.column(i) for i in range(len(names))], names=names)

    out = joined.mapInArrow(rows, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
