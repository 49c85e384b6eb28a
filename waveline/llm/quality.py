"""Quality scores from Bradley-Terry pairwise ranking.

A preference pair is a training document labelled 1 over one labelled 0. The chance
that one document beats another is the logistic function of the difference of their
scores, scores being linear in text features, so the weights minimise the logistic loss
on feature differences. The cut is a quantile of the training scores; a reported score
is the logistic function of the distance to it.

The fit takes at most ``MAX_FIT`` labelled rows (those with the smallest hash of
their id) and ``PAIRS`` pairs drawn from them; features and scores cover every whole
text.

Defined results: null and empty texts have the features of an empty text and get a
score like any other; without both labels among the training rows every score is
0.5; null ids count as training remainder 0 but have no label; repeated rows and
ids give one result row each; several labels of one id are each a training row; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer, pieces, prepare, with_text

MAX_FIT = 20_000
PAIRS = 200_000


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, newline, full stop and comma, !, ?, |, symbols, other ASCII, other."""
    of = np.full(256, 11)
    of[:128] = 10
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    for c, chars in ((3, " \t\r"), (4, "\n"), (5, ".,"), (6, "!"), (7, "?"), (8, "|"), (9, "#$%&*@^~=+<>")):
        of[[ord(x) for x in chars]] = c
    return np.eye(12)[of]


CLASSES = _classes()
N_FEATURES = 2 * 12 + 10


def text_features(raw: np.ndarray) -> np.ndarray:
    """Features of one text's UTF-8 bytes."""
    n = max(len(raw), 1)
    share = np.bincount(raw, minlength=256) @ CLASSES / n
    text = raw.tobytes().decode("utf-8", "replace")
    words, lines = text.split(), text.split("\n")
    m = max(len(words), 1)
    counts = Counter(words)
    twice = sum(map(str.__eq__, words, words[1:])) / m
    again = sum(map(str.__eq__, words, words[2:])) / m
    capital = sum(map(str.isupper, words)) / m
    alpha = sum(map(str.isalpha, words)) / m
    top = max(counts.values(), default=0) / m
    more = (
        twice,
        again,
        capital,
        alpha,
        top,
        len(counts) / m,
        np.log1p(len(counts)) / np.log1p(m),
        len(set(lines)) / len(lines),
        np.log1p(len(words)) / 10,
        sum(map(len, words)) / m / 10,
    )
    return np.concatenate([share, np.sqrt(share), more])


@dataclass
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cut: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = ((features - self.mean) / self.spread) @ self.weights - self.cut
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, quantile: float | None = None, pairs: int = PAIRS, penalty: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton steps on the pairwise logistic loss; ``quantile`` None: the one with the best balanced accuracy."""
    mean, spread = (features.mean(axis=0), features.std(axis=0) + 1e-6) if len(features) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    none = Ranker(np.zeros(N_FEATURES), mean, spread, 0.0)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return none
    x = (features - mean) / spread
    rng = np.random.default_rng(seed)
    first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1])
    for _ in range(12):
        gradient, curvature = penalty * w, penalty * np.eye(len(w))
        for a in range(0, pairs, 20_000):
            d = x[first[a : a + 20_000]] - x[second[a : a + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance given to the wrong order
            gradient -= d.T @ p / pairs
            curvature += (d * (p * (1 - p) + 1e-6)[:, None]).T @ d / pairs
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 2 / (np.linalg.norm(step) + 1e-12))
    score = x @ w
    if quantile is None:
        levels = np.linspace(0, 1, 401)[1:-1]
        cuts = np.quantile(score, levels)
        right = [(score[good] >= c).mean() + (score[bad] < c).mean() for c in cuts]
        best = np.flatnonzero(np.isclose(right, max(right)))
        quantile = float(levels[best].mean())
    return Ranker(w, mean, spread, float(np.quantile(score, quantile)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer(batch.column("text"))
        rows = [text_features(data[a:b]).tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("o1", "o2", "quality")), pa.array(rows, pa.list_(pa.float64()))], names=["o1", "o2", "quality", "features"])


def held_out() -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, quantile: float | None = None) -> Ranker:
    """Fits on labelled documents that aren't held out."""
    prepare(docs.sparkSession)
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("long").alias("quality"))
    marks = marks.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_fit)  # bounded by max_fit
    sample = with_text(docs).join(F.broadcast(marks), "doc_id").select(F.xxhash64("doc_id").alias("o1"), F.xxhash64("text").alias("o2"), "quality", "text")
    # rows with one id may be many; the limit keeps the bound
    sample = sample.mapInArrow(_features, "o1 long, o2 long, quality long, features array<double>").orderBy("o1", "o2", "quality").limit(max_fit).toArrow()
    x = np.array(sample.column("features").to_pylist(), float).reshape(-1, N_FEATURES)
    y = np.array(sample.column("quality").to_pylist(), int)
    order = np.lexsort((*x.T, y)) if len(x) else []  # the same model however rows arrive
    return fit(x[order], y[order], quantile)


def _scores(batch: pa.RecordBatch, ranker: Ranker) -> np.ndarray:
    data, offsets = buffer(batch.column("text"))
    x = np.array([text_features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(-1, N_FEATURES)
    return ranker.score(x)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score, predicted for every row."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                s = _scores(batch, ranker)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns, repeated rows and null texts judged alike."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                yield batch.filter(pa.array(_scores(batch, ranker) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)
