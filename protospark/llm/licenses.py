"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports spans and coverage."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half width of the alignment band.
BAND = 8
#: Part of a template's words that an alignment must match to be reported.
LEAST = 0.8
WORDS = re.compile(rb"[A-Za-z0-9\x80-\xff]+(?:[.\-][A-Za-z0-9\x80-\xff]+)*")
#: Words too common to be a fingerprint where another word stands in its window.
COMMON = frozenset(b"a an and any are as at be by for from in is it not of on or such that the this to under was with you your".split())

#: Notices and licenses looked for. Fixed texts.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} {_BSD_NAME} {_BSD_TAIL}",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-header": _GNU.format("", "2"),
    "GPL-3.0-header": _GNU.format("", "3"),
    "LGPL-2.1-header": _GNU.format("Lesser ", "2.1"),
    "AGPL-3.0-header": _GNU.format("Affero ", "3"),
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
}


def words(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-case words (inner dots and hyphens kept) and their byte spans."""
    found = [(m.group().lower(), m.span()) for m in WORDS.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def fingerprints(tokens: list[bytes], least: float = LEAST) -> list[int]:
    """Places of a template's winnowed fingerprints: of each window of words, the one that comes first by rarity.

    A fingerprint is a single word, since words may be put between any two in a text. Rare means not COMMON, then long.
    An alignment of `least` coverage misses `spare` words at most and so matches (words - spare) / (spare + 1) template
    words in a row somewhere, which is the window's length. COMMON words are left out again where windows hold nothing
    else; the rarest other words make up for them, for with more than `spare` places every such alignment holds one.
    """
    spare = len(tokens) - math.ceil(least * len(tokens) - 1e-9)
    window = -(-(len(tokens) - spare) // (spare + 1))
    rarity = lambda i: (tokens[i] in COMMON, -len(tokens[i]), zlib.crc32(tokens[i]), -i)
    chosen = {min(range(at, at + window), key=rarity) for at in range(len(tokens) - window + 1)}
    chosen = {i for i in chosen if tokens[i] not in COMMON}
    for i in sorted(range(len(tokens)), key=rarity):
        if len(chosen) > spare:
            break
        chosen.add(i)
    return sorted(chosen)


@dataclass
class Index:
    """Inverted index from fingerprints to (template, place)."""

    templates: dict[str, str] = field(default_factory=lambda: TEMPLATES)
    least: float = LEAST

    def __post_init__(self) -> None:
        self.names = sorted(self.templates)
        self.tokens = [words(self.templates[n].encode())[0] for n in self.names]
        self.posts: dict[bytes, list[tuple[int, int]]] = {}
        for t, tokens in enumerate(self.tokens):
            for at in fingerprints(tokens, self.least):
                self.posts.setdefault(tokens[at], []).append((t, at))
        # what a text with a fingerprint matches
        self.anchor = "(?i)" + "|".join(rf"(?:\b|_){re.escape(w.decode())}" for w in sorted(self.posts))

    def candidates(self, tokens: list[bytes], band: int = BAND) -> dict[int, list[int]]:
        """template -> diagonals, in order, within the band of a fingerprint's, on whose cells enough of the template's words stand."""
        found: dict[int, set[int]] = {}
        for i, posts in enumerate(map(self.posts.get, tokens)):
            for t, at in posts or ():
                found.setdefault(t, set()).add(i - at)
        out = {}
        for t, own in found.items():
            template = self.tokens[t]
            known = set(template)
            hits = list(accumulate((w in known for w in tokens), initial=0))
            enough = self.least * len(template) - 1e-9
            if hits[-1] < enough:
                continue
            near = sorted({x + k for x in own for k in range(-band, band + 1)})
            kept = [d for d in near if hits[max(0, min(len(tokens), d + len(template) + band))] - hits[max(0, min(len(tokens), d - band))] >= enough]
            if kept:
                out[t] = kept
        return out


def align(template: list[bytes], text: list[bytes], diagonals: list[int], band: int = BAND) -> list[tuple[int, int, int]]:
    """Banded alignments of a whole template along diagonals of the text: words matched, and the first and last word hit + 1.

    A longest common subsequence over cells at most `band` off the diagonal (text place - template place); gaps are free,
    so coverage is matched words by the template's words. Each cell keeps its score and the text words it began and last
    matched at, as one number; of equal scores it keeps the one that began last. Of the last row's cells the shortest
    span wins, then the one nearest the diagonal, so that a repeated notice close by is not taken for this one. All
    diagonals go forward together, a template word at a time; places are counted from the band's lower edge.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(template))}
    said = np.array([number.get(w, -1) for w in text] or [-1], np.int64)
    width, low = 2 * band + 1, (1 << 20) - 1
    out = []
    for at in range(0, len(diagonals), 4096):
        d = np.array(diagonals[at : at + 4096], np.int64)[:, None]
        row = np.zeros((len(d), width), np.int64)
        for i, word in enumerate(template):
            r = i + np.arange(width)
            j = d - band + r
            score = row >> 40
            equal = (j >= 0) & (j < len(text)) & (said[np.clip(j, 0, len(said) - 1)] == number[word])
            hit = np.where(equal, score + 1 << 40 | np.where(score > 0, row >> 20 & low, r) << 20 | r + 1, 0)
            hit[:, :-1] = np.maximum(hit[:, :-1], row[:, 1:])
            row = np.maximum.accumulate(hit, axis=1)
        score, first, last = row >> 40, row >> 20 & low, row & low
        best = (score << 40 | low - (last - first) << 20 | low - np.abs(first - band)).argmax(axis=1)
        pick = np.arange(len(d)), best
        out += zip(score[pick].tolist(), (first[pick] + d[:, 0] - band).tolist(), (last[pick] + d[:, 0] - band).tolist())
    return out


def scan(index: Index, text: bytes | None, least: float = LEAST, band: int = BAND) -> list[tuple[str, float, int, int]]:
    """(template, coverage, first byte, end byte) of each template found in a whole text, in order of place.

    Every diagonal within the band of a fingerprint is a candidate. Where spans overlap, the one with more matched words
    stays (a notice inside a longer header goes), then the one of the shorter template, then the shorter span.
    """
    if not text:
        return []
    tokens = list(map(bytes.lower, WORDS.findall(text)))
    hits = set()
    for t, diagonals in index.candidates(tokens, band).items():
        hits |= {(-m, len(index.tokens[t]), b - a, a, t) for m, a, b in align(index.tokens[t], tokens, diagonals, band) if m >= least * len(index.tokens[t]) - 1e-9}
    if not hits:
        return []
    spans = words(text)[1]
    kept: list[tuple[int, int, int, int]] = []  # by place, without overlap
    for m, n, size, a, t in sorted(hits):
        k = bisect_left(kept, (a, a))
        if (not k or kept[k - 1][1] <= a) and (k == len(kept) or a + size <= kept[k][0]):
            kept.insert(k, (a, a + size, t, -m))
    return [(index.names[t], m / len(index.tokens[t]), spans[a][0], spans[b - 1][1]) for a, b, t, m in kept]


SPANS = "array<struct<license: string, coverage: double, start: long, end: long>>"


def licenses(text: Column, templates: dict[str, str] | None = None, least: float = LEAST) -> Column:
    """Array of (license, coverage, start, end) found in a whole text; start and end are offsets in its UTF-8 bytes.

    A text that is null, empty or without a license gives an empty array. Repeated notices are reported each.
    """
    index = Index(templates or TEMPLATES, least)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        held = pc.match_substring_regex(texts, index.anchor)
        found = (scan(index, t.as_py(), least) if h else [] for t, h in zip(texts.cast(pa.binary()), held.to_pylist()))
        return pa.array([[dict(zip(("license", "coverage", "start", "end"), h)) for h in hits] for hits in found], kind)

    return run.asNondeterministic()(text)
