"""License notices in whole texts by patience alignment with templates.

Words of the text and a template are matched at anchors, the words that occur once in either; of the anchors the longest
increasing subsequence is kept, and the gaps between them are aligned in the same way, until a gap has no anchor; there only equal words
at its ends match. The share of the template's words that match is its coverage. The words that tell a license from others, its name and
version, must be among the matched ones and stand together as in the template. A notice may stand anywhere, more than once and with changed
words: the alignment runs over each region of the text that holds enough of the template's words close together.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_NEITHER = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
#: Public notices by the name of their license, and whole texts of MIT, BSD, ISC and Zlib. The opening of the BSD texts alone
#: doesn't say which of them it is.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "This project is licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "Released under the Zlib License.",
        "This project is licensed under the Zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        _BSD + _NEITHER + _WARRANTY,
        _BSD + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission. " + _WARRANTY,
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _BSD + _WARRANTY],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: What tells a license from others: where a template holds such words, its first place of them must be matched as it stands.
DISTINGUISHING: dict[str, list[str]] = {
    "Apache-2.0": ["apache", "2 0"],
    "MIT": ["mit"],
    "ISC": ["isc"],
    "Zlib": ["zlib"],
    "GPL-3.0": ["gnu general public", "version 3"],
    "GPL-2.0": ["gnu general public", "version 2"],
    "LGPL-2.1": ["gnu lesser general public", "version 2 1"],
    "LGPL-3.0": ["gnu lesser general public", "version 3"],
    "AGPL-3.0": ["gnu affero general public", "version 3"],
    "BSD-3-Clause": ["bsd 3 clause", "neither the name", "endorse or promote"],
    "BSD-2-Clause": ["bsd 2 clause"],
    "MPL-2.0": ["mozilla public", "2 0"],
    "CC-BY-4.0": ["cc by 4 0", "commons attribution 4 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "commons attribution sharealike 4 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "commons attribution noncommercial 4 0"],
}
#: Places of a license's whole text where nothing of its own may stand but a list mark: another clause there makes it another license.
NOTHING_BETWEEN: dict[str, list[str]] = {"BSD-2-Clause": ["distribution this software"]}
MIN_COVERAGE = 0.8
SPREAD = 2
_WORD = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Template:
    """The words of a notice, how many of them a match needs, and the places (first, after last) of those that it can't do without."""

    name: str
    words: tuple[str, ...]
    counts: Counter
    need: int
    must: tuple[tuple[int, int], ...] = ()
    tight: tuple[int, ...] = ()

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        """Whether the distinguishing words are matched, each run of them without a word between, and no clause stands where none may: a place is followed by the next after one word, a list mark, at most."""
        at = {y: x for x, y in pairs}
        return all(a in at and all(at.get(y) == at[a] + y - a for y in range(a, b)) for a, b in self.must) and all(y in at and y + 1 in at and at[y + 1] - at[y] <= 2 for y in self.tight)


def make_templates(notices: dict[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE) -> list[Template]:
    out = []
    for name, texts in (notices or TEMPLATES).items():
        for t in texts:
            words = tuple(_WORD.findall(t.lower()))
            if words:
                need = next(k for k in range(1, len(words) + 1) if k / len(words) >= min_coverage)
                runs = [tuple(r.split()) for r in DISTINGUISHING.get(name, [])]
                firsts = [next(((i, i + len(r)) for i in range(len(words)) if words[i : i + len(r)] == r), None) for r in runs]
                breaks = [r.split() for r in NOTHING_BETWEEN.get(name, [])]
                tight = [i for r in breaks for i in range(len(words)) if list(words[i : i + len(r)]) == r]
                out.append(Template(name, words, Counter(words), need, tuple(f for f in firsts if f), tuple(tight)))
    return out


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: tuple[str, ...]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of matched words, ascending in both."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if ours[w] == 1 and w in place]
        anchors = [anchors[k] for k in longest_increasing([y for _, y in anchors])]
        for x, y in anchors:
            pairs.append((x, y))
            todo.append((a, x, c, y))
            a, c = x + 1, y + 1
        if anchors:
            todo.append((a, b, c, d))
    return sorted(pairs)


def regions(hits: list[int], need: int, spread: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text (first, after last) made of windows of fewer than ``spread`` words with ``need`` hits."""
    begin = end = -1
    for j in range(len(hits) - need + 1):
        a, b = hits[j], hits[j + need - 1] + 1
        if b - a > spread:
            continue
        if begin >= 0 and a < end:
            end = b
        else:
            if begin >= 0:
                yield begin, end
            begin, end = a, b
    if begin >= 0:
        yield begin, end


def scan_text(text: str | None, templates: list[Template], vocabulary: frozenset[str], spread: int = SPREAD) -> list[dict]:
    """All notices of a text, in order and apart from each other: of matches that overlap, the one with the most matched words stays."""
    lower = (text or "").lower()
    if len(lower) != len(text or ""):  # a letter whose lower case is longer: keep the places right
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    words = _WORD.findall(lower)
    present = vocabulary.intersection(words)
    likely = [t for t in templates if sum(n for w, n in t.counts.items() if w in present) >= t.need]
    if not likely:
        return []
    spans = [m.span() for m in _WORD.finditer(lower)]
    places: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        if w in present:
            places.setdefault(w, []).append(i)
    found = []
    for t in likely:
        hits = sorted(i for w in t.counts for i in places.get(w, ()))
        for a, b in regions(hits, t.need, spread * len(t.words)):
            while b - a >= t.need:
                pairs = align(words[a:b], t.words)
                if len(pairs) < t.need or not t.named(pairs):
                    # two copies side by side leave no word unique, or another license's notice lies beside: take the shortest windows one by one
                    break
                begin, end = a + pairs[0][0], a + pairs[-1][0] + 1
                found.append((len(pairs), len(pairs) / len(t.words), t.name, begin, end))
                a = end
            if b - a >= t.need:
                found += _windows(words, [h for h in hits if a <= h < b], t, spread)
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[1] * m[0], -m[0], m[2], m[3])):
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return [{"license": name, "coverage": cov, "n_matched": n, "begin": spans[i][0], "end": spans[j - 1][1]} for n, cov, name, i, j in sorted(kept, key=lambda m: m[3])]


def _windows(words: list[str], hits: list[int], t: Template, spread: int) -> Iterator[tuple]:
    """Matches in a region that does not align as a whole: windows as long as the template, from each of its hits on."""
    after = -1
    for h in hits:
        if h < after:
            continue
        window = words[h : h + len(t.words) + len(t.words) // 4 + 1]
        shared = Counter(window) & t.counts
        if sum(shared.values()) < t.need:
            continue
        pairs = align(window, t.words)
        if len(pairs) >= t.need and t.named(pairs):
            after = h + pairs[-1][0] + 1
            yield len(pairs), len(pairs) / len(t.words), t.name, h + pairs[0][0], after


MATCHES = "array<struct<license: string, coverage: double, n_matched: int, begin: int, end: int>>"


def scan_licenses(docs: DataFrame, text_col: str = "text", notices: dict[str, list[str]] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Each row without its text and with ``matches``: license, coverage of its template, matched words, and the notice's first and
    after-last character, in order of place.

    A null or empty text, and one without a notice, has an empty list. Repeated rows each get a row and an empty table gives none; a
    column named ``matches`` is an error. Rows are not shuffled; templates are few and of a fixed size.
    """
    templates = make_templates(notices, min_coverage)
    vocabulary = frozenset(w for t in templates for w in t.words)
    keep = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in keep]
    if "matches" in names:
        raise ValueError("a column named matches would clash")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in keep], *T.StructType.fromDDL(f"matches {MATCHES}").fields])
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                found = [scan_text(t.as_py(), templates, vocabulary) for t in batch.column(text_col)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, kind)], [*names, "matches"])

    return docs.select(*[f"`{c}`" for c in names], f"`{text_col}`").mapInArrow(run, schema)
