"""Operator 8: license scan by patience alignment.

A text's words are aligned with each license template: anchors are the words that both hold once, the longest
increasing sequence of them is kept, and the gaps between are aligned in the same way (gaps without such words by a
longest common subsequence). The share of the template's words that are aligned is its coverage.

At scale: one pass without a shuffle. A text that lacks too many of a template's words cannot reach the coverage, which
a count of words shows before anything is aligned; alignments run in windows around the words that remain.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .lines import increasing

COVERAGE, DENSITY = 0.8, 0.5

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
    "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_MIT_END = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
    DEALINGS IN THE SOFTWARE."""
_BSD_TOP = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met:"""
_BSD_TWO = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
    EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
    USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
    LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
    OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
    IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
    OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
    CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_FREE = """This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License
    as published by the Free Software Foundation, either version of the License, or (at your option) any later version."""
_ONLY = """This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License
    version as published by the Free Software Foundation."""


@dataclass(frozen=True)
class License:
    """A template: its text (without the version, where that is read from the place that is found) and what makes it this license.

    must: words of the template that have to be aligned, whatever the coverage. without: words that may not stand between
    the first and the last aligned one. reads: which details of the name are read around the place: "version", "cc" (the
    elements NC, SA and ND) or "bsd" (the number of clauses).
    """

    name: str
    text: str
    must: str = ""
    without: str = ""
    reads: tuple[str, ...] = ()


_V = ("version",)
TEMPLATES = [
    License("MIT", f"{_MIT} {_MIT_END}"),
    License("MIT", _MIT),
    License("MIT", "Released under the MIT License", "mit license"),
    License("Apache", "Licensed under the Apache License, Version", "apache license", reads=_V),
    License("Apache-2.0", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http www.apache.org licenses LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""", "apache 2"),
    License("BSD-2-Clause", f"{_BSD_TOP} {_BSD_TWO} {_BSD_END}"),
    License("BSD-2-Clause", f"{_BSD_TOP} {_BSD_TWO}"),
    License("BSD-3-Clause", f"{_BSD_TOP} {_BSD_TWO} {_BSD_NAME} {_BSD_END}", "neither endorse promote"),
    License("BSD-3-Clause", f"{_BSD_TOP} {_BSD_TWO} {_BSD_NAME}", "neither endorse promote"),
    License("BSD-3-Clause", _BSD_NAME, "neither endorse promote"),
    License("BSD", "Released under the BSD License", "bsd license", reads=("bsd",)),
    License("ISC", f"{_ISC}, {_ISC_NOTICE} {_ISC_END}", "provided notice appear"),
    License("ISC", f"{_ISC}, {_ISC_NOTICE}", "provided notice appear"),
    License("0BSD", f"{_ISC}. {_ISC_END}", without="notice appear"),
    License("ISC", "Released under the ISC License", "isc license"),
    License("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution."""),
    License("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
        furnished to do so, all subject to the following"""),
    License("WTFPL", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing
        it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"""),
    License("GPL", "This work is licensed under the GNU General Public License, version", "general public license", "lesser library affero", _V),
    License("LGPL", "This work is licensed under the GNU Lesser General Public License, version", "lesser general public license", reads=_V),
    License("LGPL", "This work is licensed under the GNU Library General Public License, version", "library general public license", reads=_V),
    License("AGPL", "This work is licensed under the GNU Affero General Public License, version", "affero general public license", reads=_V),
    *(License(short, text.format(kind=kind, name=name), f"{name.lower()} public license", "lesser library affero" if short == "GPL" else "", _V)
      for text in (_FREE, _ONLY) for short, kind, name in (("GPL", "program", "General"), ("LGPL", "library", "Lesser General"), ("LGPL", "library", "Library General"), ("AGPL", "program", "Affero General"))),
    License("MPL", """This Source Code Form is subject to the terms of the Mozilla Public License, v. If a copy of the MPL was not
        distributed with this file, You can obtain one at""", "mozilla", reads=_V),
    License("MPL", "Licensed under the Mozilla Public License, version", "mozilla public", reads=_V),
    License("EPL", """This program and the accompanying materials are made available under the terms of the Eclipse Public License v""", "eclipse public", reads=_V),
    License("CC-BY", "This work is licensed under a Creative Commons Attribution License", "creative commons attribution", reads=("cc", "version")),
    License("CC-BY", "Licensed under CC BY", "cc by", reads=("cc", "version")),
    License("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    License("CC0", "Licensed under CC0", "cc0", reads=_V),
    License("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software"""),
    License("Proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"),
]
_WORD = re.compile(r"[a-z0-9]+")
#: Words that prose is full of: they never start a window.
_COMMON = frozenset("a all an and any are as at be but by can for from if in into is it may no nor not of on one or so that the their them this to was were which will with you your".split())


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _common(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """A longest common subsequence."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        old, new = rows[-1], [0]
        for j, y in enumerate(b):
            new.append(old[j] + 1 if x == y else max(old[j + 1], new[j]))
        rows.append(new)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places in a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if ca[a[i]] == 1 and cb.get(a[i]) == 1}
        anchors = [(at[b[j]], j) for j in range(b0, b1) if b[j] in at]
        anchors = [anchors[i] for i in increasing([i for i, _ in anchors])]
        if anchors:
            out.extend(anchors)
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo.extend((i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(edges, edges[1:], strict=False))
        elif not ca.keys().isdisjoint(cb):
            out.extend((a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1]))
    return sorted(out)


class Template:
    def __init__(self, license: License, coverage: float):
        self.license, self.words = license, tokens(license.text)
        self.counts = Counter(self.words)
        self.need = -(-len(self.words) * coverage // 1)
        self.first = {w: self.words.index(w) for w in self.counts if w not in _COMMON}
        self.free = sum(n for w, n in self.counts.items() if w in _COMMON)
        # a span of aligned words is no longer than this, or it isn't dense enough
        self.width = int(len(self.words) / DENSITY) + 1
        self.must, self.without = set(tokens(license.must)), frozenset(tokens(license.without))

    def find(self, words: list[str], at: dict[str, list[int]]) -> Iterator[tuple[int, int, int]]:
        """(first word, end, aligned words) of each place that covers enough. at: the places of each word that starts windows."""
        if self.free + sum(min(n, len(at.get(w, ()))) for w, n in self.counts.items() if w in self.first) < self.need or not all(w in at for w in self.must if w in self.first):
            return
        hits = sorted((p, w) for w in self.first for p in at.get(w, ()))
        near: Counter[str] = Counter()
        have, last, done = self.free, 0, 0  # have: how many words of the window may be aligned at most
        for i, (p, w) in enumerate(hits):
            while last < len(hits) and hits[last][0] < p + self.width:
                x = hits[last][1]
                near[x] += 1
                have += near[x] <= self.counts[x]
                last += 1
            if p >= done and have >= self.need:
                begin, end = max(done, p - int(self.first[w] / DENSITY) - 1), min(len(words), p + self.width)
                pairs = align(self.words, words[begin:end])
                if len(pairs) >= self.need and len(pairs) >= DENSITY * (pairs[-1][1] - pairs[0][1] + 1) and self.must <= {self.words[i] for i, _ in pairs}:
                    first, stop = begin + pairs[0][1], begin + pairs[-1][1] + 1
                    if self.without.isdisjoint(words[first:stop]):
                        done = stop
                        yield first, done, len(pairs)
            near[w] -= 1
            have -= near[w] < self.counts[w]


_ELEMENTS = {"nc": "NC", "noncommercial": "NC", "sa": "SA", "sharealike": "SA", "nd": "ND", "noderivatives": "ND", "noderivs": "ND"}
_JOINED = {("non", "commercial"): "noncommercial", ("share", "alike"): "sharealike", ("no", "derivatives"): "noderivatives", ("no", "derivs"): "noderivs", ("no", "derivative"): "noderivatives"}
#: Words that may stand between a name and its elements or version.
_LINKS = frozenset("version v license licence international unported generic universal public gpl lgpl agpl mpl gnu the or later of by cc and".split())


def named(license: License, words: list[str], first: int, end: int, gap: Callable[[int], str]) -> str:
    """The license's name with what is read from the place [first, end) and the words right behind it, in the same sentence. gap: what stands between a word and the next."""
    name, here = license.name, []
    i, behind = first, 0
    while i < len(words) and behind < 8:
        w = _JOINED.get((words[i], words[i + 1]) if i + 1 < len(words) else (), words[i])
        if i >= end:
            if re.search(r"[.!?;:]\s|\n\s*\n", gap(i - 1)) or not (w in _LINKS or w in _ELEMENTS or re.fullmatch(r"v?\d{1,2}|clause", w)):
                break
            behind += 1
        here.append((i, w))
        i += 1 + (w != words[i])
    if "cc" in license.reads:
        found = {_ELEMENTS[w] for _, w in here if w in _ELEMENTS}
        name += "".join(f"-{x}" for x in ("NC", "SA", "ND") if x in found)
    if "bsd" in license.reads:
        n = next((w for (_, w), (_, x) in zip(here, here[1:], strict=False) if w in "234" and x == "clause"), None)
        name += f"-{n}-Clause" if n else ""
    if "version" in license.reads:
        n = next((i for i, w in here if re.fullmatch(r"v?\d{1,2}", w)), None)
        if n is not None:
            minor = words[n + 1] if n + 1 < len(words) and re.fullmatch(r"\d{1,2}", words[n + 1]) and gap(n) == "." else "0"
            name += f"-{words[n].lstrip('v')}.{minor}"
    return name


def scan(text: str, templates: list[Template], starters: frozenset[str]) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first character, end) in order; of overlapping finds the one with more aligned words."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would shift places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = _WORD.findall(low)
    if starters.isdisjoint(words):
        return []
    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in starters:
            at.setdefault(w, []).append(i)
    found = [(n, t.license, n / len(t.words), a, b) for t in templates for a, b, n in t.find(words, at)]
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(low)]
    out: list[tuple[str, float, int, int]] = []
    begun: list[int] = []  # of what is reported, in order
    ended: list[int] = []
    for _, license, cover, a, b in sorted(found, key=lambda x: (-x[0], -x[2], x[3], x[1].name)):
        i = bisect_left(begun, a)
        if (i == 0 or ended[i - 1] <= a) and (i == len(begun) or b <= begun[i]):
            begun.insert(i, a)
            ended.insert(i, b)
            name = named(license, words, a, b, lambda n: low[spans[n][1] : spans[n + 1][0]])
            out.append((name, round(cover, 4), spans[a][0], spans[b - 1][1]))
    return sorted(out, key=lambda x: x[2])


def licenses(docs: DataFrame, templates: list[License] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, license, coverage, start_char, end_char), one for each place where a template is covered.

    A find covers at least the share coverage of the template's words in their order, at least half of the words between
    its first and last are aligned, and so are all that its License says must be. Versions, the elements of Creative
    Commons licenses and numbers of clauses are read from the place; where none is written, the name has none.
    Null cases: null and empty texts hold none; a null id is reported as null; of repeated rows each is reported; equal
    finds go to the template that is covered better, then by name; an empty table gives an empty one. Whole texts are
    scanned, whatever their length. Other columns are not read.
    """
    made = [Template(x, coverage) for x in templates or TEMPLATES]
    for t in made:
        if t.free >= t.need:
            raise ValueError(f"template {t.license.name} has too few words of its own")
    starters = frozenset(w for t in made for w in t.first)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(i, *found) for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if t for found in scan(t, made, starters)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "license", "coverage", "start_char", "end_char"])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return some.mapInArrow(apply, "doc_id bigint, license string, coverage double, start_char bigint, end_char bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir))
