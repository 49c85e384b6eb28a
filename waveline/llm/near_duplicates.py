"""Similarity join on word n-grams with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is
0.8 or more. Texts with the same words in the same order are one text with copies.

1. Each distinct text gets ``BANDS x ROWS`` MinHash values; texts that agree in all
   rows of a band share a bucket (a linked pair shares none with a chance below 1e-6).
2. The pairs of a bucket are compared ``STEP`` MinHash values at a time and dropped as
   soon as the posterior probability of reaching the threshold, from a uniform prior,
   falls below ``TOLERANCE``; pairs that are connected already aren't compared. A
   bucket of more than ``BUCKET`` texts is dealt out by further MinHash values first
   (twelve sub-bands of four). All pairs of what is still as large are compared too,
   beyond twice ``BLOCK`` texts in pairs of blocks.
3. The components of the surviving pairs are verified: all pairs in a component by
   exact set intersections. A component of more than ``CLUSTER`` texts or
   ``CLUSTER_SHINGLES`` shingles is verified in pairs of blocks of at most about that
   size, so no task holds one of unbounded size. A text goes to as many tasks as its
   component has blocks: exact numbers of links cost that.

Only counts and one edge for each linked text leave a task, never all pairs.

Defined results: texts without a word have no links and are a class each; texts of
one to four words have one shingle; null ids are kept (a class is named by its least
id); repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR_SIMILARITY, Scratch, keyed, mix, pieces, prepare, trim
from .common import word_hashes
from .components import components
from .decontaminate import row_shingles

BANDS, ROWS = 36, 5
STEP = 30
TOLERANCE = 1e-5
BUCKET = 512
SUB_BANDS, SUB_ROWS = 12, 4
BLOCK = 2000
CLUSTER, CLUSTER_SHINGLES = 4000, 1 << 20
TILE = 512
BIN_ROWS = 4000
SIGNED = "h1 long, h2 int, doc_id long, c1 long, c2 long, n long, sig binary, bands array<long>"


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(23).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(4)
def needed_matches(threshold: float) -> tuple[int, ...]:
    """For STEP, 2 STEP, ... values: the fewest agreements that keep a pair."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # P(J >= t | m of n agree) is a binomial sum, rising in m
        total, m = 0.0, -1
        while total < TOLERANCE:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _multipliers()
    for whole in batches:
        for batch in pieces(whole):
            flat, at = row_shingles(batch.column("text"))
            words, word_at = word_hashes(batch.column("text"))
            rows = np.flatnonzero(np.diff(at) > 0)
            cuts = at[:-1][rows]
            least = np.zeros((len(rows), len(hashes)), np.uint32)
            if len(rows):
                for j, m in enumerate(hashes):
                    least[:, j] = np.minimum.reduceat(flat * m, cuts) >> np.uint64(32)
            band = np.zeros((len(rows), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
            small = least.astype(np.uint16)
            n, c1, c2, sig, bands = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for k, i in enumerate(rows.tolist()):
                key = xxhash.xxh3_128_digest(words[word_at[i] : word_at[i + 1]].tobytes())
                c1[i], c2[i] = int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)
                n[i], sig[i], bands[i] = len(np.unique(flat[at[i] : at[i + 1]])), small[k].tobytes(), band[k]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("h1", "h2", "doc_id")] + [pa.array(x, t) for x, t in zip((c1, c2, n, sig, bands), kinds, strict=True)], names=["h1", "h2", "doc_id", "c1", "c2", "n", "sig", "bands"])
    trim()


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least member) of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def surviving_pairs(sig: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that aren't dropped while their MinHash values are compared step by step."""
    size = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])  # no similarity can be larger than the sizes' ratio
    a, b = a[size], b[size]
    agreed = np.zeros(len(a), np.int64)
    for k, least in enumerate(needed_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        agreed += (sig[a, part] == sig[b, part]).sum(axis=1)
        keep = agreed >= least
        a, b, agreed = a[keep], b[keep], agreed[keep]
    return a, b


def _bucket_edges(threshold: float):
    def of(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("c1").to_numpy(), table.column("key").to_numpy()))
        table = table.take(pa.array(order))
        key, ids, n = (table.column(c).to_numpy() for c in ("key", "c1", "n"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(key), BANDS * ROWS)
        names, node = np.unique(ids, return_inverse=True)
        label = np.arange(len(names))
        first, d = np.arange(len(key)), 1
        while len(first):  # members d places apart in one bucket
            first = first[first + d < len(key)]
            first = first[key[first] == key[first + d]]
            for at in range(0, len(first), 100_000):
                a = first[at : at + 100_000]
                a = a[label[node[a]] != label[node[a + d]]]  # what is connected needs no further edge
                a, b = surviving_pairs(sig, n, a, a + d, threshold)
                if len(a):
                    label = _least_labels(len(names), label[node[a]], label[node[b]])[label]
            d += 1
        inner = np.flatnonzero(label != np.arange(len(label)))
        trim()
        return pa.table({"a": names[label[inner]], "b": names[inner]})

    return of


def _sub_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deals a large bucket's texts out by groups of MinHash values chosen by the bucket."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, BANDS * ROWS)
        key = batch.column("key").to_numpy().view(np.uint64)
        out = []
        with np.errstate(over="ignore"):
            for s in range(SUB_BANDS):
                h = mix(key + np.uint64(s + 1))
                sub = h.copy()
                for r in range(SUB_ROWS):
                    column = (mix(h + np.uint64(r)) % np.uint64(BANDS * ROWS)).astype(np.int64)
                    sub = mix(sub * np.uint64(0x9E3779B97F4A7C15) + sig[np.arange(len(sig)), column])
                out.append(sub.view(np.int64))
        sub = np.stack(out, axis=1).ravel()
        at = pa.array(np.repeat(np.arange(batch.num_rows), SUB_BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(sub), *(batch.column(c).take(at) for c in ("c1", "n", "sig"))], names=["key", "c1", "n", "sig"])


MEMBER = "key long, c1 long, n long, sig binary"


def _edges_of(members: DataFrame, rows: int, threshold: float) -> DataFrame:
    bins = max(1, rows // BIN_ROWS)
    return members.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(bins))).groupBy("bin").applyInArrow(_bucket_edges(threshold), "a long, b long")


def _split(members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int, int]:
    """Members of buckets that a task can take, those of larger ones, and their numbers."""
    sizes = members.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    held = scratch.table(members.join(sizes.hint("merge"), "key"))
    counts = {r["large"]: r["count"] for r in held.groupBy((F.col("k") > BUCKET).alias("large")).count().collect()}
    return held.where(F.col("k") <= BUCKET).drop("k"), held.where(F.col("k") > BUCKET), counts.get(False, 0), counts.get(True, 0)


def candidate_edges(texts: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """a, b: edges that connect whatever survives pruning; ``texts`` has c1, n, sig, bands of distinct texts."""
    keys = texts.select("c1", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    own = keys.join(shared.hint("merge"), "key").groupBy("c1").agg(F.collect_list("key").alias("keys"))  # at most BANDS
    members = texts.select("c1", "n", "sig").join(own.hint("merge"), "c1").select(F.explode("keys").alias("key"), "c1", "n", "sig")
    small, large, n_small, n_large = _split(members, scratch)
    out = _edges_of(small, n_small, threshold)
    if n_large:
        small, large, n_small, n_large = _split(large.select("key", "c1", "n", "sig").mapInArrow(_sub_keys, MEMBER).dropDuplicates(["key", "c1"]), scratch)
        out = out.unionAll(_edges_of(small, n_small, threshold))
    if n_large:
        # all pairs of a dense bucket: whole, or each pair of its blocks in a group of its own
        blocks = F.when(F.col("k") <= 2 * BLOCK, F.lit(1)).otherwise(F.ceil(F.col("k") / BLOCK)).cast("long")
        rows = large.agg(F.sum(F.greatest(blocks - 1, F.lit(1)))).first()[0]
        dealt = large.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("c1"), blocks), "other": F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))}).where("blocks = 1 or block <> other")
        dealt = dealt.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "c1", "n", "sig")
        out = out.unionAll(_edges_of(dealt, rows, threshold))
    return out


def _tiles(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exact links of some of the sets to others of them: (``TILE`` of the rows, linked rows x columns) at a time."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[word] > 1
    word, owner = word[use], owner[use]
    _, word = np.unique(word, return_inverse=True)
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    words = int(word[-1]) + 1 if len(word) else 0
    width = max(1, min(words, max(64, (4 << 20) // len(sets))))  # words at a time, in 16 MB
    for first in range(0, len(rows), TILE):
        own = rows[first : first + TILE]
        common = np.zeros((len(own), len(columns)), np.float32)
        for a in range(0, words, width):
            lo, hi = np.searchsorted(word, [a, a + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[lo:hi], word[lo:hi] - a] = 1
            common += part[own] @ part[columns].T
        # in whole numbers below 2**24: threshold * union <= common
        both = common.astype(np.int64)
        union = n[own][:, None] + n[columns][None, :] - both
        yield own, both >= np.ceil(union * threshold - 1e-9)


def links(sets: list[np.ndarray], copies: np.ndarray, threshold: float, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least member of each set's component, and the copies linked to it; with ``side``, of pairs across two sides alone."""
    total, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
    rows = np.arange(len(sets)) if side is None else np.flatnonzero(side)
    columns = rows if side is None else np.flatnonzero(~side)
    if not len(rows) or not len(columns):
        return label, total
    for own, linked in _tiles(sets, rows, columns, threshold):
        if side is None:
            linked[np.arange(len(own)), own] = False
        total[own] += linked @ copies[columns]
        if side is not None:
            total[columns] += copies[own] @ linked
        x = np.flatnonzero(linked.any(axis=1))
        y = linked[x].argmax(axis=1)  # what one link connects already needs no other
        while len(x):
            label = _least_labels(len(sets), label[own[x]], label[columns[y]])[label]
            x, y = np.nonzero(linked & (label[own][:, None] != label[columns][None, :]))
    return label, total


def _verify(threshold: float):
    """c1, label, links for the texts of whole components, or of pairs of their blocks."""

    def of(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster", "ascending"), ("p", "ascending"), ("q", "ascending"), ("c1", "ascending")])
        flat, at = row_shingles(table.column("text").combine_chunks())
        sets = [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        del flat
        group = np.stack([table.column(c).to_numpy() for c in ("cluster", "p", "q")])
        ids, copies, block = (table.column(c).to_numpy() for c in ("c1", "copies", "block"))
        new = np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0)))
        out: list[tuple] = []
        for a, b in zip(new, np.append(new[1:], len(ids)), strict=True):
            p, q = group[1, a], group[2, a]
            label, total = links(sets[a:b], copies[a:b], threshold, None if p == q else block[a:b] == p)
            out.append((ids[a:b], ids[a + label], total))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        trim()
        return pa.table({"c1": columns[0], "label": columns[1], "links": columns[2].astype(np.int64)})

    return of


def join(docs: DataFrame, threshold: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every row.

    ``class_id`` is the least id of the row's connected class; ``n_links`` counts the
    other rows linked to it, copies included; ``n_copies`` its copies.
    """
    spark = docs.sparkSession
    prepare(spark)
    with Scratch(spark) as scratch:
        signed = scratch.table(keyed(docs).mapInArrow(_signatures, SIGNED))
        counts = signed.where("c1 is not null").groupBy("c1", "c2").agg(F.count("*").alias("copies"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
        counts = scratch.table(counts)
        texts = scratch.table(signed.where("c1 is not null").join(counts, ["c1", "c2", "h1", "h2"]).dropDuplicates(["c1", "c2"]))
        edges = scratch.table(candidate_edges(texts, scratch, threshold))
        # what is grouped and then joined by the same key is written first, so that the planner may split hot keys
        clusters = scratch.table(components(edges, scratch).select(F.col("id").alias("c1"), F.col("label").alias("cluster")).join(texts.select("c1", "n", "h1", "h2", "copies").hint("merge"), "c1"))
        sizes = scratch.table(clusters.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).cast("long").alias("blocks")))
        placed = scratch.table(clusters.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("c1"), F.col("blocks"))))
        found = placed.join(keyed(docs).select("h1", "h2", "text").hint("merge"), ["h1", "h2"]).dropDuplicates(["c1"])
        other = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        found = found.withColumn("other", F.explode(other)).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
        total = placed.agg(F.sum("blocks").alias("rows"), F.sum(F.col("blocks") * F.col("n")).alias("shingles"), F.max("blocks").alias("most")).first()
        bins = max(1, (total["rows"] or 0) // 300, (total["shingles"] or 0) // (CLUSTER_SHINGLES // 4))
        found = found.select("cluster", "p", "q", "c1", "copies", "block", "text").withColumn("bin", F.pmod(F.xxhash64("cluster", "p", "q"), F.lit(bins)))
        checked = scratch.table(found.groupBy("bin").applyInArrow(_verify(threshold), "c1 long, label long, links long"))
        if (total["most"] or 0) > 1:
            labels = components(checked.select(F.col("c1").alias("a"), F.col("label").alias("b")).where("a <> b"), scratch)
            links = checked.groupBy("c1").agg(F.sum("links").alias("links"))
            checked = links.join(labels.select(F.col("id").alias("c1"), "label"), "c1", "left").withColumn("label", F.coalesce("label", "c1"))
        known = counts.select("c1", "c2", "copies").join(checked, "c1", "left").select("c1", "c2", "copies", F.coalesce("label", "c1").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
        rows = signed.select("doc_id", "c1", "c2").join(known.hint("merge"), ["c1", "c2"], "left")
        rows = scratch.table(rows.select("doc_id", "label", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies")))
        names = scratch.table(rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id")))
        return scratch.keep(rows.join(names, "label", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links", "n_copies"))


def keep_first(docs: DataFrame, threshold: float = NEAR_SIMILARITY) -> DataFrame:
    """One document of each class (that with the least id), all columns; of repeated rows one.

    Defined results: rows without an id can't be named and stay; documents without a word
    (null and empty texts too) are classes of their own and stay; of several texts with the
    class's least id each stays; columns may have any names; an empty table gives no rows.
    """
    classes = join(docs, threshold)
    firsts = classes.where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionAll(docs.where("doc_id is null"))
