"""License notices in documents by patience alignment against templates.

A template of which all but ``t`` words must be matched has its ``t + 1`` rarest words
as cues, so whatever reaches the coverage has one of them. Around each cue word the
words of the document are aligned with the template's: equal ends are matched, words unique
to both sides and in increasing order on both (a longest increasing subsequence) are
anchors, and the gaps between anchors are aligned in the same way. The share of the
template's words that are matched is its coverage. The words aligned reach further out
while that matches more of an end that is missing, each time by twice the words the
template has: foreign words in one place may be as many as the template has, and a
notice ends where they are twice as many.

Of overlapping spans the one with most matched words stays, ties going to the higher
coverage and then to the first name. Defined results: null and empty texts have no
notice; repeated rows give rows of their own; an empty table gives
no rows; positions count the words of the whole text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, prepare, with_text, word_hashes

COVERAGE = 0.8
SLACK = 4

#: Notices and whole short texts by license name.
TEMPLATES = {
    "0BSD text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "Copyright line": "Copyright (c)",
    "CC0-1.0": "Licensed under CC0 1.0 Universal.",
    "Creative Commons": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Rights reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "SPDX line": "SPDX-License-Identifier",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words of templates that are common in any text and are cues last.
COMMON = frozenset("a all and any are as at by c following for free in into is it may no not of or part person published purpose source terms that the this to under use v version with without work you".split())
WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def hashes(texts: list[str]) -> list[np.ndarray]:
    flat, at = word_hashes(pa.array(texts, pa.string()))
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of equal places of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if cb[x] == 1}
        both = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and x in place]
        # longest increasing subsequence of the places in b, by piles
        tops: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(both):
            pile = bisect_left(tops, j)
            tops[pile:] = [j] + tops[pile + 1 :]
            ends[pile:] = [n] + ends[pile + 1 :]
            back.append(ends[pile - 1] if pile else -1)
        n = ends[-1] if ends else -1
        anchors = []
        while n >= 0:
            anchors.append(both[n])
            n = back[n]
        if not anchors:
            continue
        last = (a0, b0)
        for i, j in reversed(anchors):
            todo.append((last[0], i, last[1], j))
            out.append((i, j))
            last = (i + 1, j + 1)
        todo.append((last[0], a1, last[1], b1))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        templates = TEMPLATES if templates is None else templates
        self.words = dict(zip(templates, (h.tolist() for h in hashes(list(templates.values()))), strict=True))
        self.places: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for name, words in self.words.items():
            told = WORD.findall(templates[name].lower())
            # long words stand for rare ones
            rare = sorted(range(len(words)), key=lambda j: (told[j] in COMMON, -len(told[j])))
            cues = {words[j] for j in rare[: len(words) - max(1, math.ceil(coverage * len(words) - 1e-9)) + 1]}
            for j, w in enumerate(words):
                if w in cues:
                    self.places[w].append((name, j))
        self.cues = np.array(sorted(self.places), np.uint64)

    def spans(self, words: np.ndarray, cues: list[int], coverage: float) -> list[tuple[int, int, str, float]]:
        """(first word, end, license, coverage) of a document with cue words at some places."""
        found, seen = [], set()
        for p in cues:
            for name, j in self.places[int(words[p])]:
                template = self.words[name]
                if (name, p - j) in seen:
                    continue
                seen.add((name, p - j))
                lo, hi = max(0, p - j - SLACK), p - j + len(template) + SLACK
                pairs: list[tuple[int, int]] = []
                while True:
                    longer = [(lo + i, k) for i, k in patience(words[lo:hi].tolist(), template)]
                    if len(longer) <= len(pairs):
                        break
                    pairs = longer
                    if pairs[0][1] > 0:
                        lo = max(0, min(lo, pairs[0][0] - 2 * len(template)))
                    if pairs[-1][1] < len(template) - 1:
                        hi = max(hi, pairs[-1][0] + 1 + 2 * len(template))
                if pairs and len(pairs) >= coverage * len(template):
                    found.append((-len(pairs), -len(pairs) / len(template), name, pairs[0][0], pairs[-1][0] + 1))
        out: list[tuple[int, int, str, float]] = []
        taken = np.zeros(len(words) + 1, bool)
        for _, share, name, a, b in sorted(found):
            if not taken[a:b].any():
                taken[a:b] = True
                out.append((a, b, name, -share))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, end_word for every notice."""
    prepare(docs.sparkSession)
    scanner = Scanner(templates, coverage)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words, at = word_hashes(batch.column("text"))
                hit = np.zeros(0, np.int64)
                if len(words) and len(scanner.cues):
                    where = np.minimum(np.searchsorted(scanner.cues, words), len(scanner.cues) - 1)
                    hit = np.flatnonzero(scanner.cues[where] == words)
                doc = np.searchsorted(at, hit, "right") - 1
                out = []
                for i in np.unique(doc).tolist():
                    own = words[at[i] : at[i + 1]]
                    for a, b, name, share in scanner.spans(own, (hit[doc == i] - at[i]).tolist(), coverage):
                        out.append((i, name, share, a, b))
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True))], names=["doc_id", "license", "coverage", "first_word", "end_word"])

    return with_text(docs).mapInArrow(rows, "doc_id long, license string, coverage double, first_word long, end_word long")
