"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes a space, and the 1- to 3-grams
of characters fall into ``2**BITS`` hashed features. Document frequencies come from
all training documents. The weights are trained by follow-the-regularised-leader
with elastic-net penalties on at most ``MAX_FIT`` training documents, of which only
counts of n-grams are gathered; one in ``CALIBRATE`` of these is kept back to fit the
temperature of the probabilities.

Defined results: a null text or one without a letter gets ``und`` and score 0, as
does every text where no training language exists; null languages teach nothing;
ties go to the language first in order; repeated rows are separate rows; an empty table
gives no rows; other columns than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer, pieces, prepare
from .quality import held_out

BITS = 15
GRAMS = (1, 2, 3)
MAX_FIT = 4_000
CALIBRATE = 5
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])  # every code point


LETTER = _letters()


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with counts, in order of row, and whether rows have letters."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    data, _ = buffer(lower)
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = np.int32 if len(lengths) < 1 << (31 - BITS) else np.int64
    row = np.repeat(np.arange(len(lengths), dtype=kind) << BITS, lengths)
    letter = LETTER[codes]
    has = np.zeros(len(lengths), bool)
    has[row[letter] >> BITS] = True
    codes = np.where(letter, codes, 32).astype(np.uint64)
    found = []
    for n in GRAMS:
        end = len(codes) - n + 1
        if end <= 0:
            continue
        x = codes[:end]
        for j in range(1, n):
            x = (x << np.uint64(21)) | codes[j : end + j]
        with np.errstate(over="ignore"):  # multiplicative hashing
            x = ((x + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        inside = row[:end] == row[n - 1 :]
        found.append((row[:end] | x.astype(kind))[inside])
    both = np.sort(np.concatenate(found)) if found else np.zeros(0, kind)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(both)))
    both = both[first]
    return (both >> BITS).astype(np.int64), (both & ((1 << BITS) - 1)).astype(np.int64), n, has


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages, zero where the penalty holds it
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, feature, n, has = counts(texts)
        x = _tfidf(row, n, self.idf[feature], len(has))
        out = np.zeros((len(has), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(row, x * self.weights[feature, k], minlength=len(has))
        return out + self.bias, has

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        z, has = self.logits(texts)
        p = _softmax(z / self.temperature)
        best = p.argmax(axis=1)
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, p[np.arange(len(best)), best], 0.0)


def _tfidf(row: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """(1 + ln count) x idf, of unit length in each row."""
    x = (1 + np.log(n)) * idf
    length = np.sqrt(np.bincount(row, x * x, minlength=rows))
    return x / np.maximum(length, 1e-12)[row]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(row: np.ndarray, feature: np.ndarray, n: np.ndarray, langs: list[str], idf: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, epochs: int = 2, batch: int = 8) -> Model:
    """FTRL-proximal on (row, feature, count) in order of row: per-coordinate rates, exact zeros by the l1 part."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), idf)
    x = _tfidf(row, n, idf[feature], len(langs))
    starts = np.searchsorted(row, np.arange(len(langs) + 1))
    y = np.array([names.index(v) for v in langs])
    kept = np.arange(len(langs)) % CALIBRATE == 0
    if len(langs) < 10 * CALIBRATE:
        kept[:] = False
    shape = ((1 << BITS) + 1, len(names))  # the last row is the bias
    z, squares = np.zeros(shape), np.zeros(shape)

    def weights(at: np.ndarray) -> np.ndarray:
        v = z[at]
        return np.where(np.abs(v) <= l1, 0.0, -(v - np.sign(v) * l1) / ((beta + np.sqrt(squares[at])) / alpha + l2))

    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~kept))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in own])
            f = np.append(feature[at], np.full(len(own), 1 << BITS))
            r = np.append(np.repeat(np.arange(len(own)), starts[own + 1] - starts[own]), np.arange(len(own)))
            v = np.append(x[at], np.ones(len(own)))
            used, where = np.unique(f, return_inverse=True)
            w = weights(used)
            scores = np.stack([np.bincount(r, v * w[where, k], minlength=len(own)) for k in range(len(names))], axis=1)
            error = _softmax(scores)
            error[np.arange(len(own)), y[own]] -= 1
            g = np.stack([np.bincount(where, v * error[r, k], minlength=len(used)) for k in range(len(names))], axis=1)
            rate = (np.sqrt(squares[used] + g * g) - np.sqrt(squares[used])) / alpha
            z[used] += g - rate * w
            squares[used] += g * g
    w = weights(np.arange(shape[0]))
    model = Model(names, w[:-1], w[-1], idf)
    if kept.any():
        logits = np.stack([np.bincount(row, x * w[feature, k], minlength=len(langs)) for k in range(len(names))], axis=1)[kept] + w[-1]
        truth = y[kept]
        # golden-section search for the temperature of the least log loss
        loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(truth)), truth] + 1e-12).mean()
        a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            c, d = b - g * (b - a), a + g * (b - a)
            a, b = (a, d) if loss(c) <= loss(d) else (c, b)
        model.temperature = float(np.exp((a + b) / 2))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(1 << BITS, np.int64), 0
    for whole in batches:
        for batch in pieces(whole):
            _, feature, _, has = counts(batch.column("text"))
            total += np.bincount(feature, minlength=1 << BITS)
            docs += len(has)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], names=["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram counts of each row: at most 2**BITS features of 2 bytes and counts of 4, however long the text."""
    for whole in batches:
        for batch in pieces(whole):
            row, feature, n, _ = counts(batch.column("text"))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            feature, n = feature.astype("<u2"), np.minimum(n, np.iinfo(np.uint32).max).astype("<u4")
            vectors = [(feature[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = list(zip(*vectors, strict=True)) if vectors else [[], []]
            yield pa.RecordBatch.from_arrays([batch.column("o1"), batch.column("o2"), batch.column("lang"), *(pa.array(c, pa.binary()) for c in columns)], names=["o1", "o2", "lang", "feature", "n"])


def train(docs: DataFrame, max_fit: int = MAX_FIT) -> Model:
    """Learns from rows with a language that aren't held out; frequencies from all of them."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # at most 2**BITS + 1 rows, whatever the corpus
    frequency = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n, feature = frequency.column("n").to_numpy(), frequency.column("feature").to_numpy()
    idf = np.zeros(1 << BITS)
    idf[feature[feature >= 0]] = np.log((1 + n[feature < 0].sum()) / (1 + n[feature >= 0])) + 1
    own = rows.select(F.xxhash64("doc_id").alias("o1"), F.xxhash64("text").alias("o2"), "text", "lang")
    last = own.select("o1", "o2").orderBy("o1", "o2").limit(max_fit).agg(F.max("o1")).first()[0]
    # of the texts only counts leave their tasks; several rows with one id share an order, and the limit keeps the bound
    sample = own.where(F.col("o1") <= F.lit(last if last is not None else 0)).mapInArrow(_vectors, "o1 long, o2 long, lang string, feature binary, n binary")
    sample = sample.orderBy("o1", "o2", "lang").limit(max_fit).toArrow()
    flat = [np.concatenate([np.zeros(0, kind), *(np.frombuffer(v, kind) for v in sample.column(c).to_pylist())]) for c, kind in (("feature", "<u2"), ("n", "<u4"))]
    row = np.repeat(np.arange(sample.num_rows, dtype=np.int32), [len(v) // 2 for v in sample.column("feature").to_pylist()])
    return fit(row, flat[0].astype(np.int32), flat[1], sample.column("lang").to_pylist(), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                langs, score = model.predict(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")
