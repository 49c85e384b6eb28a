"""Suffix order of a byte buffer by two-stage sorting, and adjacent common prefixes.

Only suffixes smaller than their successors are sorted directly; a scan over the
first-byte buckets in ascending order induces the place of all others (a suffix
larger than its successor follows from the successor's place). Orders and common
prefixes are exact up to ``depth`` bytes, 64 equal bytes being told by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np

from .common import mix

_JUMP = 64


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros follow the end."""
    out = np.zeros(len(text) + 1, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8))
    for k in range(8):
        out <<= np.uint64(8)
        out[: len(text)] |= padded[k : k + len(text)]
    return out


def jump_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the 64 bytes from each position."""
    h, size = mix(words), 8
    with np.errstate(over="ignore"):
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            far = h[size:] * np.uint64(odd)
            h = h + np.uint64(size)
            h[: len(far)] += far
            size *= 2
    return h


def _sort_small(at: np.ndarray, words: np.ndarray, jump: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of their next ``depth`` bytes, by refining groups of equal prefixes."""
    end = len(words) - 1
    order = at[np.argsort(words[at])]
    key = words[order]
    fresh = np.append(True, key[1:] != key[:-1])  # where a group of equal prefixes begins
    where = np.arange(len(order), dtype=np.int32)  # places still in a group of several
    same = np.full(len(order), 8, np.int32)  # bytes known to be equal
    while len(where):
        many = ~(fresh & np.append(fresh[1:], True)) & (same < depth)
        where, fresh, same = where[many], fresh[many], same[many]
        if not len(where):
            break
        starts = np.flatnonzero(fresh)
        each = np.diff(np.append(starts, len(where)))
        pos = order[where]
        # groups that agree on a long block skip it
        h = jump[np.minimum(pos + same, end)]
        odd = h != np.repeat(h[starts], each)
        agree = np.repeat(~np.logical_or.reduceat(odd, starts), each)
        same[agree] += _JUMP
        if agree.all():
            continue
        act = np.flatnonzero(~agree)
        word = words[np.minimum(pos[act] + same[act], end)]
        by_word = np.argsort(word)
        sorted_words = word[by_word]
        rank = np.empty(len(act), np.int64)
        rank[by_word] = np.cumsum(np.append(False, sorted_words[1:] != sorted_words[:-1]))
        both = (np.cumsum(fresh)[act] << 32) | rank
        again = np.argsort(both)
        order[where[act]] = pos[act][again]
        same[act] += 8
        both = both[again]
        fresh[act[1:]] = both[1:] != both[:-1]  # the first of all begins its group already
    return order


def suffix_order(text: np.ndarray, depth: int, words: np.ndarray | None = None, jump: np.ndarray | None = None, ranges: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Positions of all suffixes (of less than 2**31 bytes), ordered by their first ``depth`` bytes at least.

    With ``ranges`` (starts, stops), in order and apart: of the suffixes from each start
    to the first one at or after its stop that is smaller than its successor, which is
    as far as the induced places reach back.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    if words is None:
        words = _words(text)
    if jump is None:
        jump = jump_hashes(words)
    nxt = np.append(text[1:].astype(np.int16), -1)
    decided = np.where(text != nxt, np.arange(n, dtype=np.int32), np.int32(n - 1))
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the end of a run of equal bytes decides
    small = text[decided] < nxt[decided]
    del nxt, decided
    asked = np.ones(n, bool)
    if ranges is not None:
        smaller = np.append(np.flatnonzero(small), n - 1)
        last = smaller[np.minimum(np.searchsorted(smaller, ranges[1]), len(smaller) - 1)]
        edges = np.zeros(n + 1, np.int64)
        np.add.at(edges, ranges[0], 1)
        np.add.at(edges, last + 1, -1)
        asked = np.cumsum(edges[:n]) > 0
    direct = _sort_small(np.flatnonzero(small & asked).astype(np.int32), words, jump, depth)
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if asked[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1], np.int32))  # its successor is the empty suffix
    parts = [np.zeros(0, np.int32)]
    induced = ~small & asked

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """Hands larger predecessors to their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        first = text[before]
        other = first != byte
        own, before, first = before[~other], before[other], first[other]
        if len(before):
            by = np.argsort(first, kind="stable")
            first, before = first[by], before[by]
            edge = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(edge, np.append(edge[1:], len(first)), strict=True):
                waiting[first[a]].append(before[a:b])
        return own

    for byte in range(256):
        front = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int32)
        while len(front):
            parts.append(front)
            front = induce(front, byte)
        front = direct[cuts[byte] : cuts[byte + 1]]
        if len(front):
            parts.append(front)
            induce(front, byte)
    return np.concatenate(parts)


def common_prefixes(order: np.ndarray, words: np.ndarray, jump: np.ndarray, depth: int) -> np.ndarray:
    """Bytes (at most ``depth``) that each suffix shares with the one before it in the order."""
    end = len(words) - 1
    got = np.zeros(len(order), np.int32)
    on = np.arange(1, len(order), dtype=np.int32)
    for size, h in ((_JUMP, jump), (8, words)):
        at, a, b = on, order[:-1], order[1:]
        if size < _JUMP:
            at = on[got[1:] < depth]
            a, b = order[at - 1] + got[at], order[at] + got[at]
        done = 0
        while len(at):
            same = np.flatnonzero(h[a] == h[b])
            at, a, b = at[same], a[same], b[same]
            inside = np.maximum(a, b) + size <= end
            if not inside.all():
                at, a, b = at[inside], a[inside], b[inside]
            got[at] += size
            done += size
            if size == _JUMP and done >= depth or size < _JUMP and done >= _JUMP:
                break
            a, b = np.minimum(a + size, end), np.minimum(b + size, end)
    on = on[got[1:] < depth]
    a, b = order[on - 1] + got[on], order[on] + got[on]
    odd = words[a] ^ words[b]
    inside = end - np.maximum(a, b)  # zeros follow the end, and a suffix has none of them
    # of the word that differs, its leading equal bytes
    more = sum((odd < np.uint64(1 << (64 - 8 * k))).astype(np.int32) for k in range(1, 8))
    got[on] += np.minimum(more, inside).astype(np.int32)
    return np.minimum(got, depth)
