"""Licence scan: normalised text against templates by the Dice coefficient over word bigrams.

Units of a document are its whole text, its paragraphs (runs of lines without a blank one) and its lines.  A unit with a
bigrams and a template with b share at most min(a, b), so 2 * min(a, b) / (a + b) bounds their coefficient: templates
whose size makes that less than LEAST are pruned before any bigram is compared.  The best template of the best unit is
the document's; every unit is judged, over the whole text.

A licence that is none of these units is found by windows: stretches of the whole text's words, of any size that the bound
allows.  A window that reaches LEAST lacks at most (1 - LEAST) / (2 - LEAST) * 2 of a template's bigrams, a third at 0.8, so
it holds some of the half of them with the longest words (anchors).  Only where enough anchors are close are windows
scored: from starts some steps apart, then from every start that could still be the best, which the bound on a step's
change tells.  Windows are compared with the notices and with the full texts of licences.  A window inside a longer match
of a larger template is part of that one; overlapping windows leave the best.

Normalising: lower case, the spellings licence and license are one, copyright lines and punctuation go, numbers stay.
The templates are fixed: notices in this file, full texts here and in `licenses/`, some hundred kilobytes in all.

Defined results: null and blank texts have no unit and no licence; equal coefficients go to the longer unit, then to the
first template; repeated rows are judged row by row; other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 0.8

#: fixed values: wordings of licences and of the notices that name them
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)

_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = next(text for name, text in TEMPLATES if name == "BSD-2-Clause")
_ISC = next(text for name, text in TEMPLATES if name == "ISC")
_UNLICENSE = next(text for name, text in TEMPLATES if name == "Unlicense")
_FILES = Path(__file__).parent / "licenses"
#: fixed values: full texts, compared with windows only
FULL = (
    ("BSD-2-Clause", f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("ISC", f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", f"{_UNLICENSE} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    *((name, (_FILES / file).read_text(encoding="utf-8")) for name, file in (("Apache-2.0", "Apache-2.0.txt"), ("GPL-2.0", "GPL-2.txt"), ("GPL-3.0", "GPL-3.txt"), ("MPL-2.0", "MPL-2.0.txt"), ("CC0-1.0", "CC0-1.0.txt"))),
)

_COPYRIGHT = re.compile(r"(?mi)^[^\w\n]*(?:copyright|\(c\)|©)[ \t]+(?:\(c\)|©)?[^\n]*$")
_WORDS = re.compile(r"\w+")


def normalised(text: str) -> list[str]:
    text = _COPYRIGHT.sub(" ", text) if "opyright" in text or "OPYRIGHT" in text or "(c)" in text or "©" in text else text
    return _WORDS.findall(text.lower().replace("licence", "license"))


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return 2 * sum(min(n, large[g]) for g, n in small.items() if g in large) / total if total else 0.0


def _apart(matches: list[tuple[float, int, int, int]], n: int) -> list[tuple[float, int, int, int]]:
    """Of matches in order those that overlap with none before them."""
    taken, out = bytearray(n), []
    for m in matches:
        if not any(taken[m[3] : m[3] + m[1]]):
            taken[m[3] : m[3] + m[1]] = b"\x01" * m[1]
            out.append(m)
    return out


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, full: tuple[tuple[str, str], ...] = FULL) -> None:
        self.least = least
        self.templates = [(name, bigrams(normalised(text))) for name, text in templates]
        self.sizes = [t.total() for _, t in self.templates]
        self.longest = max(self.sizes) * (2 - least) / least if self.sizes else 0
        self.shortest = min(self.sizes) * least / (2 - least) if self.sizes else 0
        # templates of windows: the notices under their own numbers, then the full texts
        per_line = lambda text: [w for line in text.split("\n") for w in normalised(line)]
        self.sought = [*self.templates, *((name, bigrams(per_line(text))) for name, text in full)]
        self.anchors: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.needed = []
        for i, (_, t) in enumerate(self.sought):
            m, held = t.total(), 0
            absent = m - least / (2 - least) * m  # what a window that reaches least may lack
            for g in sorted(t, key=lambda g: (-len(g[0]) - len(g[1]), g)):
                if held > max(absent, m / 2):
                    break
                self.anchors[g].append(i)
                held += t[g]
            self.needed.append(held - absent)
        self.anchors = dict(self.anchors)

    def fitting(self, n: int) -> list[int]:
        """Templates whose size does not rule out the least coefficient for a unit of n bigrams."""
        return [i for i, m in enumerate(self.sizes) if 2 * min(n, m) >= self.least * (n + m)]

    def best(self, words: list[str]) -> tuple[float, int, int] | None:
        """Coefficient, bigrams and template of the best match of one unit."""
        n = len(words) - 1
        if not self.shortest <= n <= self.longest:
            return None
        own, found = None, None
        for i in self.fitting(n):
            own = own or bigrams(words)
            score = dice(own, self.templates[i][1])
            if score >= self.least and (found is None or score > found[0]):
                found = (score, n, i)
        return found

    def windows(self, words: list[str]) -> list[tuple[float, int, int, int]]:
        """Coefficient, bigrams, template and first word of the best windows, none of which overlap."""
        grams = list(zip(words, words[1:]))
        near: dict[int, list[int]] = defaultdict(list)
        for at in [at for at, g in enumerate(grams) if g in self.anchors]:
            for i in self.anchors[grams[at]]:
                near[i].append(at)
        found = []
        for i, places in near.items():
            reach = int(self.sought[i][1].total() * (2 - self.least) / self.least)
            # starts from which one window holds enough anchors, joined to regions
            regions: list[list[int]] = []
            for k, at in enumerate(places):
                if bisect_right(places, at + reach) - k >= self.needed[i]:
                    low, high = max(0, at - reach), min(len(grams), at + reach)
                    if regions and low <= regions[-1][1]:
                        regions[-1][1] = high
                    else:
                        regions.append([low, high])
            for low, high in regions:
                found += self.inside(grams, i, low, high)
        size = lambda m: self.sought[m[2]][1].total()
        # the size of the largest template that has a match over a place
        over = [0] * len(grams)
        for m in sorted(found, key=size):
            over[m[3] : m[3] + m[1]] = [size(m)] * m[1]
        part = lambda m: min(over[m[3]], over[m[3] + m[1] - 1]) > 2 * size(m)
        return _apart(sorted(found, key=lambda m: (part(m), -m[0], -m[1], m[2], m[3])), len(grams))

    def inside(self, grams: list[tuple[str, str]], i: int, low: int, high: int) -> list[tuple[float, int, int, int]]:
        """The best windows of template i in grams[low:high], apart from each other."""
        t = self.sought[i][1]
        m = t.total()
        reach = int(m * (2 - self.least) / self.least)
        shared_at = [g in t for g in grams[low:high]]
        ahead: dict[int, tuple[float, int]] = {}

        def score(at: int) -> tuple[float, int]:
            """The best coefficient of a window from a start, and its bigrams."""
            if at not in ahead:
                seen, shared, best = Counter(), 0, (0.0, 0)
                for end in range(at, min(high, at + reach + 1)):
                    g = grams[end]
                    if shared_at[end - low] and seen[g] < t[g]:
                        seen[g] += 1
                        shared += 1
                        best = max(best, (2 * shared / (m + end + 1 - at), end + 1 - at))
                ahead[at] = best
            return ahead[at]

        step = max(1, m // 64)
        starts = range(low, high)
        if step > 1:
            # a start less than `step` places off changes the coefficient by less than slack: only near the best of a reach
            slack = 2 * step / m
            coarse = list(range(low, high, step))
            value = [score(at)[0] for at in coarse]
            side = reach // step
            close = [c for k, c in enumerate(coarse) if value[k] >= max(self.least, *value[max(0, k - side) : k + side + 1]) - slack]
            starts = [at for c in close for at in range(c, min(high, c + step))]
        found = [(*score(at), i, at) for at in starts if shared_at[at - low]]  # the best window begins with a shared bigram
        return _apart(sorted((x for x in found if x[0] >= self.least), key=lambda x: (-x[0], -x[1], x[3])), len(grams))

    def scan(self, text: str | None) -> tuple[str | None, float | None, int, int]:
        """Licence, coefficient, units that match, units."""
        lines = (text or "").split("\n")
        parts, paragraph, units = [normalised(x) for x in lines], [], []
        for line, words in zip([*lines, ""], [*parts, []], strict=True):
            if line.strip():
                units.append(words)
                paragraph.append(words)
            else:
                if len(paragraph) > 1:
                    units.append([w for p in paragraph for w in p])
                paragraph = []
        whole = [w for p in parts for w in p]
        if len(units) > 1 and len(whole) > max(map(len, units)):
            units.append(whole)
        found = [m for m in map(self.best, units) if m]
        inner = self.windows(whole)
        if inner:
            # a window that a matching unit already stands for is no match of its own; one of a larger template outdoes it
            known = Counter(self.templates[i][0] for _, _, i in found)
            size = max((self.templates[i][1].total() for _, _, i in found), default=0)
            larger = [m for m in inner if self.sought[m[2]][1].total() > 2 * size]
            new = larger if larger else [m for m in inner if not known[self.sought[m[2]][0]]]
            if larger:
                found = [m for m in found if m[1] > max(x[1] for x in larger)]
            found += [m[:3] for m in new]
        if not found:
            return None, None, 0, len(units)
        score, _, i = max(found, key=lambda m: (m[0], m[1], -m[2]))
        return self.sought[i][0], score, len(found), len(units)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license (null if none), score, n_matches, n_units of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column(1)]
            names, scores, matches, units = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(matches, pa.int64()), pa.array(units, pa.int64())], ["doc_id", "license", "score", "n_matches", "n_units"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, score double, n_matches long, n_units long")
