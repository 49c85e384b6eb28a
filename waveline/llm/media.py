"""Audio features of a byte payload kept losslessly as 8-bit samples.

A payload is stored as a WAV file (mono, unsigned 8 bit, 16 kHz), the stored file
is read again, and its samples pass polyphase resampling (5/8, to 10 kHz),
overlapped log-mel filterbanks and a two-threshold (hysteresis) energy
segmentation. The features are a tensor of fixed shape (``SLOTS`` equal time spans
x ``MELS`` bands) and a list of voiced time spans. Spark has no tensor type: its rows
and files hold the tensor as an array of SLOTS * MELS numbers, and ``to_tensors`` makes
Arrow's fixed-shape type of it without a copy of the numbers.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts
give equal values; texts of any length are read in blocks, so memory besides the
stored file is bounded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import buffer, pieces, prepare, with_text

RATE, UP, DOWN, TAPS = 16_000, 5, 8, 12
FRAME, HOP, MELS, SLOTS = 256, 128, 16, 8
PAD = 64
BLOCK = 1 << 18  # samples, a multiple of DOWN
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, log_mel array<float>, span_start array<double>, span_end array<double>"


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


@lru_cache(1)
def _filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The polyphase filter as a matrix, the frame window, and the mel filterbank."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    phases = (taps / taps.sum() * UP / 128).reshape(TAPS, UP)
    resampler = np.zeros((TAPS - 1 + DOWN, UP), np.float32)  # from a window of samples to UP outputs
    for m in range(UP):
        for k in range(TAPS):
            resampler[m * DOWN // UP + TAPS - 1 - k, m] = phases[k, m * DOWN % UP]
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    up = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    bank = np.clip(np.minimum(up, down), 0, None).astype(np.float32)
    return resampler, np.hanning(FRAME).astype(np.float32), bank


def _frames(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Log-mel rows, block by block; the last frame is padded with silence."""
    resampler, window, bank = _filters()
    rest = np.zeros(0, np.float32)
    for at in range(0, len(samples), BLOCK):
        n = min(BLOCK, len(samples) - at)
        steps = -(-n // DOWN)
        x = np.zeros(TAPS - 1 + steps * DOWN, np.float32)  # the filter's history, the block, silence
        past = min(at, TAPS - 1)
        x[TAPS - 1 - past : TAPS - 1 + n] = samples[at - past : at + n]
        x[TAPS - 1 - past : TAPS - 1 + n] -= 128
        # DOWN samples in, UP samples out: every phase of the filter is a column
        y = (np.lib.stride_tricks.as_strided(x, (steps, TAPS - 1 + DOWN), (DOWN * 4, 4)) @ resampler).ravel()
        y = np.concatenate([rest, y[: -(-n * UP // DOWN)]])
        if at + BLOCK >= len(samples):
            y = np.concatenate([y, np.zeros(-(-max(len(y) - FRAME, 0) // HOP) * HOP + FRAME - len(y), np.float32)])
        n = max(0, (len(y) - FRAME) // HOP + 1)
        if n:
            spectrum = np.fft.rfft(np.lib.stride_tricks.as_strided(y, (n, FRAME), (HOP * 4, 4)) * window, axis=1)
            yield np.log((spectrum.real**2 + spectrum.imag**2) @ bank + np.float32(1e-6))
        rest = y[n * HOP :]


def features(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (SLOTS, MELS) log-mel tensor and the voiced spans in seconds, shape (n, 2)."""
    rows = np.concatenate(list(_frames(samples)))
    cuts = np.arange(SLOTS) * len(rows) // SLOTS
    ends = np.maximum(cuts + 1, np.append(cuts[1:], len(rows)))
    total = np.zeros((len(rows) + 1, MELS))
    np.cumsum(rows, axis=0, out=total[1:])
    tensor = ((total[ends] - total[cuts]) / (ends - cuts)[:, None]).astype(np.float32)
    energy = rows.mean(axis=1)
    high, low = energy.mean() + 0.5 * energy.std(), energy.mean()
    # a span opens at `high` and lasts while energy stays at or above `low`
    over = energy >= low
    edges = np.diff(np.concatenate([[0], over.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges > 0), np.flatnonzero(edges < 0)
    loud = np.concatenate([[0], np.cumsum(energy >= high)])
    keep = loud[ends] > loud[starts]
    step = HOP * DOWN / UP / RATE
    return tensor, np.stack([starts[keep], ends[keep]], axis=1) * step


def told(tensor: np.ndarray, spans: np.ndarray) -> str:
    """A sha256 of the tensor and the spans, to three digits."""
    digits = lambda x: np.round(x.astype(np.float64) * 1000).astype("<i8").tobytes()
    return hashlib.sha256(digits(tensor) + b"|" + digits(spans)).hexdigest()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "log_mel", "span_start", "span_end"]
    for whole in batches:
        for batch in pieces(whole):
            data, offsets = buffer(batch.column("text"))
            out, tensors, starts, ends, at = [], [np.zeros(0, np.float32)], [np.zeros(0)], [np.zeros(0)], [0]
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                media = store(raw + bytes(-len(raw) % PAD if raw else PAD))
                payload = load(media)
                tensor, spans = features(np.frombuffer(payload, np.uint8))
                out.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), told(tensor, spans)))
                tensors.append(tensor.ravel())
                starts.append(spans[:, 0])
                ends.append(spans[:, 1])
                at.append(at[-1] + len(spans))
            arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            slots = pa.array(np.arange(len(out) + 1) * SLOTS * MELS, pa.int32())
            lists = [pa.ListArray.from_arrays(o, pa.array(np.concatenate(x))) for o, x in ((slots, tensors), (pa.array(at, pa.int32()), starts), (pa.array(at, pa.int32()), ends))]
            yield pa.RecordBatch.from_arrays(arrays + lists, names=names)


def extract(docs: DataFrame) -> DataFrame:
    """One row per document with checksums of the stored form, a digest of the features, the tensor and the spans."""
    prepare(docs.sparkSession)
    return with_text(docs).mapInArrow(_rows, SCHEMA)


def to_tensors(table: pa.Table) -> pa.Table:
    """A collected or read result with ``log_mel`` as Arrow's fixed-shape tensor type; rows of another size are an error."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SLOTS, MELS))
    held = table.column("log_mel").combine_chunks()
    if pc.any(pc.not_equal(pc.list_value_length(held), SLOTS * MELS)).as_py() or held.null_count:
        raise ValueError(f"log_mel: {SLOTS * MELS} numbers in each row")
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(held.flatten(), SLOTS * MELS))
    return table.set_column(table.schema.get_field_index("log_mel"), pa.field("log_mel", kind), tensors)
