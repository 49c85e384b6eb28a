"""Test items inside documents: size-partitioned MinHash containment search.

Items of more than ``SMALLEST`` distinct word shingles fall into classes by their
number (powers of two). For a class of up to ``u`` shingles a document is read as
overlapping windows of ``2u`` shingles, so an item meets a set of its own order of
size however long the document is. An item and a window that agree in any of
``HASHES`` MinHash values are candidates; an item of which four fifths lie in one
window is missed with a probability below 2e-6.

Smaller items are looked up exactly: a document that holds the threshold's share of
an item holds one at least of any ``s - ceil(threshold * s) + 1`` of its ``s``
shingles, and those that fewest items have are the keys to it. None is missed.

The share of the item's distinct shingles that occur in the whole document decides
exactly about all candidates.

Items are taken in blocks of bounded size, each searched against all documents.

Defined results: shingles are runs of five words; a text of one to four words is one
shingle, equal only to a text of the same words; null and empty texts match
nothing; repeated documents and items give a row each; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR_SIMILARITY, pieces, prepare, shingle_hashes, with_text, word_hashes

HASHES = 64
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
SMALLEST = 32
_BITS = 22


def _multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(1 << 62, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows, one after the other, and where each row begins."""
    words, at = word_hashes(texts)
    sizes = np.diff(at)
    if not len(words):
        return words, np.zeros(len(at), np.int64)
    every = shingle_hashes(words)
    counts = np.where(sizes >= 5, sizes - 4, np.minimum(sizes, 1))
    to = np.append(0, np.cumsum(counts))
    first = np.repeat(at[:-1], counts) + np.arange(to[-1]) - np.repeat(to[:-1], counts)
    out = every[np.minimum(first, len(every) - 1)]
    for i in np.flatnonzero((sizes > 0) & (sizes < 5)):
        out[to[i]] = shingle_hashes(words[at[i] : at[i + 1]])[0]
    return out, to


class Index:
    """A block of items: their shingles, keys to the small ones, and MinHash values by size class."""

    def __init__(self, ids: list, texts: list[str], threshold: float = NEAR_SIMILARITY):
        flat, at = row_shingles(pa.array(texts, pa.string()))
        self.ids, self.sets = [], []
        for i, a, b in zip(ids, at[:-1], at[1:], strict=True):
            if b > a:
                self.ids.append(i)
                self.sets.append(np.unique(flat[a:b]))
        self.seen = np.zeros(1 << _BITS, bool)
        multipliers = _multipliers()
        by_class: dict[int, list[int]] = defaultdict(list)
        small: list[int] = []
        for k, s in enumerate(self.sets):
            self.seen[s >> np.uint64(64 - _BITS)] = True
            if len(s) <= SMALLEST:
                small.append(k)
            else:
                by_class[1 << (len(s) - 1).bit_length()].append(k)
        self.threshold = threshold
        self._key(small)
        self.classes = {}
        for u, members in by_class.items():
            least = np.array([[(self.sets[k] * m).min() for m in multipliers] for k in members]).T
            order = np.argsort(least, axis=1)
            self.classes[u] = (np.take_along_axis(least, order, 1), np.array(members)[order])

    def _key(self, small: list[int]) -> None:
        """Shingles of which a document that holds a small item has one at least, in order, and their items."""
        every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.sets[k] for k in small)]), return_counts=True)
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for k in small:
            s = self.sets[k]
            needed = max(1, int(np.ceil(self.threshold * len(s) - 1e-9)))
            rare = np.argsort(count[np.searchsorted(every, s)], kind="stable")[: len(s) - needed + 1]
            keys.append(s[rare])
            owners.append(np.full(len(rare), k))
        flat, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], owner[order]

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, float, int]]:
        """(row, item position, containment, size of the item's set), for the index's threshold or a higher one."""
        assert threshold >= self.threshold
        flat, at = row_shingles(texts)
        if not len(flat) or not self.sets:
            return []
        # a document without any shingle of any item is no candidate
        may = np.append(0, np.cumsum(self.seen[flat >> np.uint64(64 - _BITS)]))
        rows = np.flatnonzero(may[at[1:]] > may[at[:-1]])
        if not len(rows):
            return []
        sizes = np.diff(at)[rows]
        ends = np.cumsum(sizes)
        own = flat[np.repeat(at[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]
        pairs: set[tuple[int, int]] = set()
        if len(self.keys):
            left, right = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
            hit = np.flatnonzero(right > left)
            doc = np.searchsorted(ends, hit, "right")
            for d, a, b in np.unique(np.stack([doc, left[hit], right[hit]], axis=1), axis=0).tolist():
                pairs.update((d, k) for k in self.owners[a:b].tolist())
        for u, (least, members) in self.classes.items():
            blocks = -(-sizes // u)
            cuts = np.repeat(ends - sizes, blocks) + u * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            doc = np.repeat(np.arange(len(rows)), blocks)
            next_same = np.append(doc[1:] == doc[:-1], False)
            for j, m in enumerate(_multipliers()):
                low = np.minimum.reduceat(own * m, cuts)
                window = np.where(next_same, np.minimum(low, np.append(low[1:], low[-1])), low)
                left = np.searchsorted(least[j], window)
                for w in np.flatnonzero(least[j][np.minimum(left, len(least[j]) - 1)] == window):
                    k = left[w]
                    while k < len(least[j]) and least[j][k] == window[w]:
                        pairs.add((int(doc[w]), int(members[j][k])))
                        k += 1
        out, held, have = [], -1, None
        for d, k in sorted(pairs):
            if d != held:
                held, have = d, np.unique(own[ends[d] - sizes[d] : ends[d]])
            item = self.sets[k]
            place = np.minimum(np.searchsorted(have, item), len(have) - 1)
            share = float((have[place] == item).sum()) / len(item)
            if share >= threshold:
                out.append((int(rows[d]), k, share, len(item)))
        return out


def _blocks(items: DataFrame, threshold: float) -> Iterator[Index]:
    """Blocks of items of a bounded number of rows and bytes."""
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-2 * size["n"] // BLOCK_ITEMS), -(-2 * size["b"] // BLOCK_BYTES)) if size["n"] * 2 > BLOCK_ITEMS or size["b"] * 2 > BLOCK_BYTES else 1
    spread = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n))
    for k in range(n):
        held = rows.where(spread == k).orderBy("item_id", "text").toArrow()
        yield Index(held.column("item_id").to_pylist(), held.column("text").to_pylist(), threshold)


def search(docs: DataFrame, items: DataFrame, threshold: float = NEAR_SIMILARITY) -> DataFrame:
    """doc_id, item_id, n_shingles, containment of every document that holds an item."""
    prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for index in _blocks(items, threshold):
        held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the block

        def rows(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for whole in batches:
                for batch in pieces(whole):
                    got = index.matches(batch.column("text"), threshold)
                    doc = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([index.ids[g[1]] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64())], names=["doc_id", "item_id", "n_shingles", "containment"])

        part = with_text(docs).mapInArrow(rows, f"doc_id long, item_id {kind}, n_shingles long, containment double")
        found = part if found is None else found.unionAll(part)
    return found


def clean(docs: DataFrame, items: DataFrame, threshold: float = NEAR_SIMILARITY) -> DataFrame:
    """The documents that hold no item, all columns; those without a word stay, of repeated rows all or none."""
    prepare(docs.sparkSession)
    for index in _blocks(items, threshold):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for whole in batches:
                for batch in pieces(whole):
                    keep = np.ones(batch.num_rows, bool)
                    keep[[g[0] for g in index.matches(batch.column("text"), threshold)]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
