"""Packing documents into token sequences by a configuration linear program.

Lengths are counted into a histogram (at most ``capacity`` entries, however many
documents). A configuration is a multiset of length classes (multiples of
capacity / ``CLASSES``) that fits one sequence; the program covers the whole histogram
with the least sum of configurations. Multiplicative weights on the classes approach
its dual, each round pricing the best configuration by a knapsack dynamic program over
the capacity. The fractions are rounded so that their running sum stays within a half
of the program's, and each sequence gets lengths of its classes that fill it. What this
leaves over (some tenth of the tokens) is filled in best fit first, longest lengths
first, on the histogram. Pieces get their place from their rank among pieces of equal
length.

Defined results: a null or empty text is the end token alone; only documents longer
than the capacity are cut; repeated rows are packed each on its own; an empty table
gives no rows; sequence ids count from 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, prepare, scratch_dir, trim, with_text
from .tokens import tokenizer

CAPACITY = 4096
END_ID = 1
CLASSES = 256
ROUNDS = 1500
RATE = 1.0
TOKENIZER = "word_bpe_49k.json"

Pattern = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def price(weights: np.ndarray) -> np.ndarray:
    """How often each class is in the heaviest configuration (an unbounded knapsack; class z takes z of the capacity).

    ``weights`` has one entry for each class from 0 to the capacity; classes of no weight are left out.
    """
    capacity = len(weights) - 1
    best = np.zeros(capacity + 1)  # by what is left of the capacity
    choice = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        value = weights[1 : c + 1] + best[capacity - c + 1 :]
        i = int(value.argmax())
        best[capacity - c], choice[c] = value[i], i + 1
    used, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        used[choice[c]] += weights[choice[c]] > 0
        c -= int(choice[c])
    return used


def fractions(demand: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many of each, fractionally, so that each class is covered as often as it occurs.

    A class's price falls by the factor exp(-RATE) whenever the demand for it is covered
    once more, so later configurations hold what is covered least. The most frequent first.
    """
    found: dict[bytes, float] = defaultdict(float)
    there, cover, size = demand > 0, np.zeros(len(demand)), np.arange(len(demand)) / len(demand)
    for _ in range(rounds):
        used = price(np.where(there, np.exp(-RATE * np.maximum(cover - cover[there].min(), 0)) * size, 0.0))
        on = used > 0
        step = float((demand[on] / used[on]).min())
        found[used.tobytes()] += step
        cover[on] += used[on] * step / demand[on]
    scale = max(cover[there].mean(), 1e-9)
    return sorted(((np.frombuffer(u, np.int64), x / scale) for u, x in found.items()), key=lambda p: -p[1])


class _Pools:
    """Lengths that there are, by class."""

    def __init__(self, histogram: dict[int, int], unit: int):
        self.unit = unit
        self.counts: dict[int, dict[int, int]] = defaultdict(dict)
        for length in sorted(histogram):
            self.counts[self.of(length)][length] = histogram[length]
        self.lengths = {z: list(held) for z, held in self.counts.items()}

    def of(self, length: int) -> int:
        return max(1, (length + self.unit // 2) // self.unit)

    def there(self, length: int) -> int:
        return self.counts[self.of(length)].get(length, 0)

    def take(self, length: int, n: int) -> None:
        z = self.of(length)
        self.counts[z][length] -= n
        if not self.counts[z][length]:
            del self.counts[z][length]
            self.lengths[z].remove(length)

    def fill(self, members: list[int], capacity: int) -> Counter | None:
        """Lengths of the classes, each the longest that leaves room for the others; one is changed to close a gap."""
        if not all(self.lengths.get(z) for z in members):
            return None
        later, taken = sum(self.lengths[z][0] for z in members), Counter()
        for z in members:
            later -= self.lengths[z][0]
            i = bisect_right(self.lengths[z], capacity - later) - 1
            while i >= 0 and self.there(self.lengths[z][i]) <= taken[self.lengths[z][i]]:
                i -= 1
            if i < 0:
                return None
            taken[self.lengths[z][i]] += 1
            capacity -= self.lengths[z][i]
        if capacity:
            for length in sorted(taken, reverse=True):
                if taken[length] and self.there(length + capacity) > taken[length + capacity]:
                    taken[length] -= 1
                    taken[length + capacity] += 1
                    break
        return +taken


def configurations(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """The linear program's configurations, rounded, as sequences of lengths that there are."""
    if not histogram:
        return []
    unit = max(1, capacity // CLASSES)
    pools = _Pools(histogram, unit)
    demand = np.zeros(pools.of(capacity) + 1)
    for z, held in pools.counts.items():
        demand[z] = sum(held.values())
    out: list[Pattern] = []
    due = 0.5
    for used, x in fractions(demand):
        members = [int(z) for z in np.flatnonzero(used)[::-1] for _ in range(used[z])]
        due += x
        n = int(due)
        due -= n
        while n > 0 and (taken := pools.fill(members, capacity)):
            k = min(n, *(pools.there(length) // c for length, c in taken.items()))
            for length, c in taken.items():
                pools.take(length, c * k)
            out.append((tuple(taken.elements()), k))
            n -= k
    return out


def best_fit(histogram: dict[int, int], capacity: int, open_bins: list[Pattern] = ()) -> list[Pattern]:
    """Best fit decreasing on counts; groups of equal sequences are filled together."""
    by_room: dict[int, list[Pattern]] = defaultdict(list)
    for pattern, n in open_bins:
        by_room[capacity - sum(pattern)].append((pattern, n))
    rooms = np.zeros(capacity + 1, bool)
    rooms[[r for r in by_room]] = True
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fit = np.flatnonzero(rooms[length:])
            if len(fit):
                room = int(fit[0]) + length
                pattern, n = by_room[room].pop()
                if not by_room[room]:
                    rooms[room] = False
                # as many copies of the length as fit, in as many sequences as there are
                copies = min(room // length, left)
                k = min(n, left // copies)
                if k < n:
                    by_room[room].append((pattern, n - k))
                    rooms[room] = True
            else:
                pattern, room = (), capacity
                copies = min(capacity // length, left)
                k = left // copies
            left -= k * copies
            rest = room - copies * length
            by_room[rest].append((pattern + (length,) * copies, k))
            rooms[rest] = True
    return [p for held in by_room.values() for p in held]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences that hold every length as often as it occurs."""
    whole = [((capacity,), histogram[capacity])] if histogram.get(capacity) else []
    short = {n: c for n, c in histogram.items() if n < capacity and c}
    chosen = configurations(short, capacity)
    left = Counter(short)
    for pattern, n in chosen:
        for length in pattern:
            left[length] -= n
    return whole + best_fit(+left, capacity, chosen)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): ranks from the first on go to sequences in order."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, n in sorted(patterns, reverse=True):
        offset = 0
        for length in sorted(pattern, reverse=True):
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def tokens(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, with its place among the task's pieces of that length."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for whole in batches:
            for batch in pieces(whole, limit=3 << 20):
                ids, at = tokenizer(path).encode(batch.column("text"))
                out: list[tuple] = []
                end = np.array([END_ID], "<u4")
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], end)
                    for k, start in enumerate(range(0, len(own), capacity)):
                        x = own[start : start + capacity]
                        out.append((doc, k, start, len(x), zlib.crc32(x.tobytes()), part, seen[len(x)], x.astype(np.int32).tolist() if keep_ids else None))
                        seen[len(x)] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)][: 8 if keep_ids else 7], names=names[: 8 if keep_ids else 7])
        trim()

    return with_text(docs).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset (and ids with ``keep_ids``)."""
    scratch_dir(docs.sparkSession)
    # the checkpoint pins the places that tasks gave to their pieces
    cut = tokens(docs, path or tokenizer_path(), capacity, keep_ids).checkpoint()
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    tasks = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(tasks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
    kind = [("length", np.int64), ("rank", np.int64)]
    keys = np.array(list(map(tuple, table[:, :2])), kind)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = keys["length"] * (1 << 44) + keys["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(flat, length * (1 << 44) + rank, "right") - 1
            sequence = table[row, 2] + rank - table[row, 1]
            named = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            named |= {"sequence_id": pa.array(sequence), "offset": pa.array(table[row, 3])}
            yield pa.RecordBatch.from_arrays([named[n] for n in order], names=order)

    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from a result with ids."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("held"))  # a sequence holds `capacity` ids at most
    return held.select("sequence_id", F.flatten(F.transform("held", lambda x: x["ids"])).alias("ids"))
