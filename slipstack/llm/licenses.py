"""Licence notices found by conditional compression.

Every marking word of a text (licence, copyright, warranty, ...) is laid on the same marking words of each known notice;
the stretch of text that the notice would then take is its candidate block. A block is cut to its notice: in words, so
line breaks, comment signs and what stands around it in the same line play no part. It is compressed on its own and
with the notice as a raw zstandard dictionary; the gain is the reduction as a share of the notice's own compressed
size, so that a short notice in long prose gains as much as one that stands alone. Blocks are ranked by gain, and
those that gain enough are aligned with the notice word by word: a notice is confirmed when no more than a tenth of
its words are missing or inserted, and these words are given. Every confirmed notice is reported; where two overlap,
the one with more words in place stands. Marks that no confirmed notice holds are reported with the best of their
candidates, unconfirmed.

A notice is sought around its marking words: it is found if at least one of them is in place.

Scale: no shuffle at all. Texts without any of the marking words are left out by a test in the scan;
every other text is read whole. The work is linear in the words around marks, whatever the length of the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that speak of a licence, and the wording of common notices.
MARKS = ("licen", "copyright", "warrant", "hereby", "redistribut", "public domain", "creative commons", "spdx")
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-header-full": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work; it is in the public domain.",
}
LEAST_GAIN = 0.25
DIFFERING = 0.1
APART = 200  # characters between marks of one unconfirmed block
LEVEL = 3
FOUND = "doc_id long, block int, block_start int, block_chars int, license string, gain double, differing_words int, missing array<string>, extra array<string>, confirmed boolean"

MARK = re.compile("|".join(f"({m.replace(' ', '[^a-z0-9]+')})" for m in MARKS), re.I)
WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
PLAIN = dict(level=LEVEL, write_content_size=False, write_checksum=False)


class Notice:
    """A known notice: its words, the places of marks in them by kind, and what is needed to measure gains."""

    def __init__(self, text: str):
        found = list(WORD.finditer(text))
        starts = [m.start() for m in found]
        self.words = [m[0].lower() for m in found]
        self.anchors = defaultdict(list)
        for mark in MARK.finditer(text):
            self.anchors[mark.lastindex].append(bisect_right(starts, mark.start()) - 1)
        data = " ".join(self.words).encode()
        self.slack = math.ceil(DIFFERING * len(self.words)) + 1
        self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **PLAIN)
        self.size = len(zstandard.ZstdCompressor(**PLAIN).compress(data))


class Block(NamedTuple):
    """A stretch of words [start, end) and what explains it."""

    start: int
    end: int
    name: str | None
    gain: float
    missing: list[str]
    extra: list[str]
    confirmed: bool


@lru_cache(1)
def notices() -> dict[str, Notice]:
    return {name: Notice(text) for name, text in NOTICES.items()}


@lru_cache(1)
def alone() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(**PLAIN)


def aligned(words: list[str], notice: list[str]) -> tuple[int, int, list[str], list[str]]:
    """The part of ``words`` nearest to the notice: start, end, words missing and words inserted there, as few as can be."""
    rows = [[0] * (len(words) + 1)]
    for i, want in enumerate(notice, 1):
        above, row = rows[-1], [i]
        left = i
        for j, word in enumerate(words):
            left = above[j] if word == want else min(above[j + 1], left) + 1
            row.append(left)
        rows.append(row)
    i, j = len(notice), min(range(len(words) + 1), key=rows[-1].__getitem__)
    same, missing, extra = [], [], []
    while i:
        if j and words[j - 1] == notice[i - 1]:
            i, j = i - 1, j - 1
            same.append(j)
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            extra.append(words[j])
        else:
            i -= 1
            missing.append(notice[i])
    # Words before the first that agrees are outside, not inserted.
    return (same[-1], same[0] + 1, missing[::-1], extra[::-1]) if same else (0, 0, missing[::-1], [])


@lru_cache(4096)
def compared(name: str, text: str) -> tuple[float, tuple[int, int, list[str], list[str]] | None]:
    """Gain of a candidate block, and its alignment where it gains enough."""
    notice, data = notices()[name], text.encode()
    gain = (len(alone().compress(data)) - len(notice.compressor.compress(data))) / notice.size
    return gain, aligned(text.split(" "), notice.words) if gain >= LEAST_GAIN else None


def candidates(words: list[str], marks: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(notice, start, end) in words: where each notice would lie with one of its marks on a mark (word, kind) of the text.

    Starts that differ by no more than the words that may differ share a block, which is as much longer.
    """
    for name, notice in notices().items():
        starts = sorted({at - place for at, kind in marks for place in notice.anchors.get(kind, ())})
        k = 0
        while k < len(starts):
            first = last = starts[k]
            while k < len(starts) and starts[k] <= first + notice.slack:
                last = starts[k]
                k += 1
            yield name, max(0, first - notice.slack), min(len(words), last + len(notice.words) + notice.slack)


def blocks_of(text: str) -> Iterator[tuple[int, int, Block]]:
    """(first character, characters, block) of all notices and of the marks outside of them, in order."""
    found = list(WORD.finditer(text))
    starts, words = [m.start() for m in found], [m[0].lower() for m in found]
    # A mark may stand behind an underscore, which is no word: it then counts with the word before it.
    marks = [(max(0, bisect_right(starts, m.start()) - 1), m.lastindex) for m in MARK.finditer(text)]
    if not marks:
        return
    tried = []
    for name, low, high in candidates(words, marks):
        gain, fit = compared(name, " ".join(words[low:high]))
        if fit is None:
            continue
        start, end, missing, extra = fit
        confirmed = len(missing) + len(extra) <= DIFFERING * len(notices()[name].words)
        tried.append(Block(low + start, low + end, name, gain, missing, extra, confirmed))
    tried.sort(key=lambda b: (-b.gain, b.name, b.start))
    # Confirmed notices: more words in place first; then fewer differing, then by rank.
    taken: dict[int, Block] = {}
    chosen = []
    for block in sorted((b for b in tried if b.confirmed), key=lambda b: (len(b.missing) - len(notices()[b.name].words), len(b.missing) + len(b.extra))):
        if not any(i in taken for i in range(block.start, block.end)):
            taken.update(dict.fromkeys(range(block.start, block.end), block))
            chosen.append(block)
    near = [b for b in tried if not b.confirmed]
    best: dict[int, int] = {}
    for rank, block in enumerate(near):
        for i in range(block.start, block.end):
            best.setdefault(i, rank)
    rest: list[list[int]] = []
    before = None
    for at in sorted({at for at, _ in marks}):
        if at in taken:
            before = None
            continue
        if before is not None and found[at].start() - found[before].end() <= APART:
            rest[-1][1] = at + 1
        else:
            rest.append([at, at + 1])
        before = at
    for low, high in rest:
        ranks = [best[i] for i in range(low, high) if i in best]
        explained = near[min(ranks)] if ranks else Block(low, high, None, 0.0, [], [], False)
        chosen.append(explained._replace(start=low, end=high))
    for block in sorted(chosen):
        first = found[block.start].start()
        yield first, found[block.end - 1].end() - first, block


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed notice of ``docs(doc_id, text)`` and per stretch of marks outside of them, columns as in FOUND.

    Stretches that no notice explains have a null licence and are not confirmed. Null and empty texts have
    no rows; repeated rows give repeated rows.
    """
    folded = F.lower(F.col("text"))
    marked = reduce(lambda a, b: a | b, [folded.contains(m.split()[-1]) for m in MARKS])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (start, size, b) in enumerate(blocks_of(text)):
                    row = (doc_id, i, start, size, b.name, round(b.gain, 6), len(b.missing) + len(b.extra), b.missing, b.extra, b.confirmed)
                    for cells, cell in zip(rows, row, strict=True):
                        cells.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return docs.where(marked).select("doc_id", "text").mapInArrow(find, FOUND)
