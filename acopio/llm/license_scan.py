"""License scan (list item 7).

Templates are cut into words, every run of K words is hashed, and winnowing
keeps the smallest hash of each W neighbouring ones.  The kept fingerprints of
all templates form an inverted index.  A document's own winnowed fingerprints
are looked up in it; places that agree on a template and a diagonal are a
candidate.  A banded alignment of the template with the words there gives what
is matched, its coverage and its span; matched words are masked and the
alignment repeats, so that a notice that is said n times is found n times.

A run of K + W - 1 words that a text and a template share always has a
fingerprint in common.  Templates under ``SHORT`` words have few such runs:
they are indexed by all their word pairs, which are looked up at every place,
and as many of the pairs must meet as changes of every fifth word would leave.

The templates are a fixed set, so the index has a fixed size; texts are
scanned where they lie.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table
from .words import Chunk, chunks, windows

K, W, BAND, MIN_COVERAGE = 3, 3, 8, 0.8
SHORT = 16  # templates of fewer words are found by word pairs

#: Public license notices and texts.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def winnow(hashes: np.ndarray, docs: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest of each w neighbouring hashes of a document (of all, if it has fewer)."""
    n = len(hashes)
    keep = np.zeros(n, bool)
    if not n:
        return np.flatnonzero(keep)
    least = hashes.copy()
    for k in range(1, w):  # least[i]: of i .. i + w - 1, as far as the document goes
        own = docs[k:] == docs[: n - k]
        least[: n - k] = np.where(own, np.minimum(least[: n - k], hashes[k:]), least[: n - k])
    for k in range(w):
        own = docs[k:] == docs[: n - k]
        keep[k:] |= own & (hashes[k:] == least[: n - k])
    return np.flatnonzero(keep)


def _words(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, docs = c.spans(_WORD[c.buf])
    return starts, ends, docs, c.hashes(starts, ends)


class Index:
    """keys (sorted hashes) and their (template, place): winnowed runs of K words, and the pairs of short templates."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        self.need: list[int] = []
        runs, pairs = [], []
        for k, text in enumerate(templates.values()):
            (c,) = chunks(pa.array([text]), lower=True)
            _, _, docs, words = _words(c)
            n = len(words)
            self.words.append(words)
            h, at = windows(words, docs, 2 if n < SHORT else K)
            kept = range(len(h)) if n < SHORT else winnow(h, np.zeros(len(h), int), W).tolist()
            (pairs if n < SHORT else runs).extend((int(h[x]), k, int(at[x])) for x in kept)
            # A changed word breaks two pairs; one pair more may be broken by an added word.
            self.need.append(max(1, min(2, n - 1), n - 2 - 2 * int((1 - min_coverage) * n + 1e-9)) if n < SHORT else 1)
        self.tables = []
        for size, places in ((2, pairs), (K, runs)):
            places.sort()
            keys = np.array([p[0] for p in places], np.uint64)
            seen = np.zeros(1 << 16, bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.tables.append((size, keys, np.array([p[1:] for p in places], np.int64).reshape(-1, 2), seen))

    def candidates(self, words: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, template, least and largest word the template may start at), BAND words wide at most."""
        hits = defaultdict(set)
        for size, keys, places, seen in self.tables:
            h, at = windows(words, docs, size)
            kept = np.arange(len(h)) if size == 2 else winnow(h, docs[at], W)
            kept = kept[seen[(h[kept] & np.uint64(0xFFFF)).astype(np.int64)]]
            low, high = np.searchsorted(keys, h[kept], "left"), np.searchsorted(keys, h[kept], "right")
            for x in np.flatnonzero(high > low):
                word = int(at[kept[x]])
                for template, place in places[low[x] : high[x]].tolist():
                    hits[int(docs[word]), template].add((word - place, place))
        for (doc, template), found in hits.items():
            met, need = sorted(found), self.need[template]
            a = 0
            while a < len(met):
                b = a
                while b < len(met) and met[b][0] - met[a][0] <= BAND:
                    b += 1
                if b - a >= need:
                    yield doc, template, met[a][0], met[b - 1][0]
                    # The next group may begin inside this one, where its own diagonal begins.
                    rest = [k for k in range(a + 1, b) if met[k][0] > met[a][0] + BAND // 2]
                    a = rest[0] if rest else b
                else:
                    a += 1


def align(text: np.ndarray, template: np.ndarray, low: int, high: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment with starts low - band .. high + band: matched words, first word, word after the last.

    A match counts 1, a mismatch, insertion or deletion -1.
    """
    shift, width = low - band, high - low + 2 * band + 1
    # cell: (score, matched, first word); cell k of row i is text word shift + i + k
    none = (0, 0, -1)
    row, best = [none] * (width + 1), (0, 0, -1, -1)
    for i, word in enumerate(template):
        new, left = [], none
        for k in range(width):
            at = shift + i + k
            here = none
            if 0 <= at < len(text):
                s, m, f = row[k]
                here = (s + 1, m + 1, at if f < 0 else f) if text[at] == word else (s - 1, m, f)
            up = row[k + 1]
            here = max(here, (up[0] - 1, up[1], up[2]), (left[0] - 1, left[1], left[2]), key=lambda x: (x[0], x[1]))
            left = here if here[0] > 0 else none
            new.append(left)
            if (left[0], left[1]) > best[:2]:
                best = (left[0], left[1], left[2], at + 1)
        row = [*new, none]
    return best[1], best[2], best[3]


def matches(text: np.ndarray, template: np.ndarray, low: int, high: int, min_coverage: float, band: int = BAND) -> Iterator[tuple[int, int, int]]:
    """The alignments of at least min_coverage, the best first; their words in text become 0, which is no word."""
    while True:
        matched, a, b = align(text, template, low, high, band)
        if matched < min_coverage * len(template) - 1e-9:
            return
        yield matched, a, b
        text[a:b] = 0


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each place where a template is matched to at least min_coverage.

    Columns: id_col, license, start_char and end_char (code points, end
    excluded), matched_words, template_words, coverage.  Words are runs of
    lower-cased letters and digits.  A template that overlaps a match of
    higher coverage, or of as high coverage with more matched words, is not
    reported at that place (ties: the template that comes first).  A notice
    that is repeated is reported at each place.  Null and empty texts have no
    match; null ids are kept; rows that repeat are reported each; long texts
    are searched whole; an empty table gives an empty one; other columns are
    not read.
    """
    index = Index(templates or TEMPLATES, min_coverage)
    schema = T.StructType([docs.schema[id_col], T.StructField("license", T.StringType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("matched_words", T.IntegerType()), T.StructField("template_words", T.IntegerType()), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in chunks(batch.column(1), lower=True):
                starts, ends, docs, words = _words(c)
                first = np.searchsorted(docs, np.arange(c.n + 1))
                points = np.concatenate(([0], np.cumsum((c.buf & 0xC0) != 0x80)))
                found = defaultdict(list)
                masked: dict[tuple[int, int], np.ndarray] = {}
                for doc, template, low, high in index.candidates(words, docs):
                    base, target = int(first[doc]), index.words[template]
                    if (doc, template) not in masked:
                        masked[doc, template] = words[base : first[doc + 1]].copy()
                    own, origin = masked[doc, template], points[c.bounds[doc]]
                    for matched, a, b in matches(own, target, low - base, high - base, min_coverage):
                        found[doc].append((matched / len(target), matched, template, int(points[starts[base + a]] - origin), int(points[ends[base + b - 1]] - origin)))
                for doc, spans in found.items():
                    kept = []
                    for s in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], s[3])):
                        if all(s[3] >= x[4] or s[4] <= x[3] for x in kept):
                            kept.append(s)
                            rows.append((c.first + doc, index.names[s[2]], s[3], s[4], s[1], len(index.words[s[2]]), s[0]))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
