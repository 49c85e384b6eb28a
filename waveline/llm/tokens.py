"""Token ids of a public word-level BPE file, equal to the tokenizers library's.

Text between white space is tokenized on its own (no pattern of the file spans
white space), so the ids of a run of characters are kept in a table. New runs of
plain characters go through the merge ranks with a compiled byte-pair loop; all
others go to the tokenizers library itself. Texts of ASCII and Western European
letters without apostrophes are cut into words for a whole batch at once; equal words
of a batch are found by a 64-bit hash, and each distinct one is looked up by its bytes.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import buffer, run_hashes

TABLE_ENTRIES = 600_000
TABLE_CHARS = 24_000_000
#: Characters that Python's split() takes for white space and the file's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
END = b"\xff"  # never occurs in UTF-8


SPACE, LETTER, DIGIT, OTHER, ODD = range(5)


def _kinds() -> np.ndarray:
    """Kinds of bytes; an apostrophe, odd space or a byte beyond U+00FF isn't plain."""
    kind = np.full(256, ODD, np.uint8)
    kind[:128] = OTHER
    kind[[ord(c) for c in " \t\n\v\f\r"]] = SPACE
    kind[ord("a") : ord("z") + 1] = LETTER
    kind[0x80:0xC0] = kind[0xC3] = LETTER
    kind[ord("0") : ord("9") + 1] = DIGIT
    kind[[ord("'"), *range(0x1C, 0x20)]] = ODD
    return kind


KIND = _kinds()


def _plain_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of ASCII and letters up to U+00FF alone, without apostrophes and special tokens."""
    if not len(data):
        return np.ones(len(offsets) - 1, bool)
    odd = KIND[data] == ODD
    beyond = data >= 0x80
    if beyond.any():  # after a lead byte 0xC3 only letters may follow, and nothing else but they
        lead = np.append(False, data[:-1] == 0xC3)
        odd |= beyond & (data < 0xC0) & ~lead | lead & ((data == 0x97) | (data == 0xB7))
    odd[np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))] = True
    at = np.flatnonzero(odd)
    return np.searchsorted(at, offsets[1:]) == np.searchsorted(at, offsets[:-1])


def _bytes_of_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class WordTokenizer:
    """ids(text) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.seen: dict[bytes, bytes] = {}
        self.seen_bytes = 0
        self.chars = 0
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol = _bytes_of_symbols()
        raw = lambda t: (bytes(symbol[c] for c in t.removesuffix("</w>")) + (END if t.endswith("</w>") else b""))
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ranks: single bytes, then a byte with the word end, then the merges in order
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b]) + END: 256 + b for b in range(255)}
        ids = {rank: vocab[t] for t in vocab if (rank := ranks.get(raw(t))) is not None and not t.startswith("<|")}
        for n, (a, b) in enumerate(merges):
            ranks.setdefault(raw(a + b), 1000 + n)
            ids[ranks[raw(a + b)]] = vocab[a + b]
        self.id_bytes = {rank: i.to_bytes(4, "little") for rank, i in ids.items()}
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.bpe = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        """A lower-cased match of the pattern."""
        return b"".join(map(self.id_bytes.__getitem__, self.bpe.encode_single_piece(word + END)))

    def _new(self, run: str) -> bytes:
        ascii = run.isascii()
        if not (ascii or (max(run) < "ɐ" and "İ" not in run and unicodedata.is_normalized("NFC", run))) or "<|" in run:
            return self._library(run)
        run = run.lower()
        words, last = (run,), run[-1]
        if not run.isalpha():
            words = (run[:-1], last) if last in ".,!?;:" and run[:-1].isalpha() else self.pattern.findall(run)
        table = self.words
        for word in words:
            if word not in table:
                table[word] = self._word(word.encode())
        return b"".join(map(table.__getitem__, words))

    def ids_bytes(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self._library(text)
        runs, table = text.split(), self.table
        for run in set(runs).difference(table):
            table[run] = self._new(run)
            self.chars += len(run)
        out = b"".join(map(table.__getitem__, runs))
        if len(table) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            table.clear()
            self.words.clear()
            self.chars = 0
        return out


    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, one after the other, and where each row begins."""
        texts = texts.cast(pa.large_string()).fill_null("")
        plain = _plain_rows(*buffer(texts))
        data, offsets = buffer(pc.utf8_lower(texts))
        kind = KIND[data]
        flat, counts = self._plain(data, offsets, kind, plain)
        if plain.all():
            return flat, np.append(0, np.cumsum(counts))
        ends = np.append(0, np.cumsum(counts))
        parts = []
        for i, fast in enumerate(plain):
            if fast:
                parts.append(flat[ends[i] : ends[i + 1]])
            else:
                parts.append(np.frombuffer(self.ids_bytes(texts[i].as_py() or ""), "<u4"))
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(plain), np.int64)
        change = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        change[offsets[:-1][offsets[:-1] < n]] = True
        cuts = np.append(np.flatnonzero(change), n)
        words = np.flatnonzero(kind[cuts[:-1]] != SPACE)
        starts, ends = cuts[:-1][words], cuts[1:][words]
        row = np.searchsorted(starts, offsets)
        if not plain.all():
            keep = np.repeat(plain, np.diff(row))
            starts, ends = starts[keep], ends[keep]
            row = np.append(0, np.cumsum(np.diff(row) * plain))
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(plain), np.int64)
        key = run_hashes(data, starts, ends)
        order = np.argsort(key)
        ranked = key[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        where = np.empty(len(key), np.int64)
        where[order] = np.cumsum(first) - 1
        sample = order[first]
        found = []
        raw = data.tobytes()
        for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True):
            word = raw[a:b]
            ids = self.seen.get(word)
            if ids is None:
                ids = self.seen[word] = self._word(word)
                self.seen_bytes += len(word)
            found.append(ids)
        length = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        if len(self.seen) > TABLE_ENTRIES or self.seen_bytes > TABLE_CHARS:
            self.seen.clear()
            self.seen_bytes = 0
        begin = np.append(0, np.cumsum(length))[:-1]
        each = length[where]
        to = np.append(0, np.cumsum(each))
        ids = flat[np.repeat(begin[where] - to[:-1], each) + np.arange(to[-1])]
        return ids, to[row[1:]] - to[row[:-1]]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker."""
    return WordTokenizer(path)
