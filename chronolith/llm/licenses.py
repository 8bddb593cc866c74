"""License scans by patience alignment of texts with license templates.

A text's words are aligned with a template's: words that occur exactly once in both are anchors, the
longest increasing subsequence of their places keeps the order, and every gap between two anchors
is aligned in the same way, where other words have become unique; equal words next to an anchor or
a gap's border extend it. Coverage is the share of the template's words that are aligned. A match
must reach ``coverage``, lie within ``SPREAD`` times the template's length, and hold one of the
template's key words; it is looked for where each occurrence of a key word would place the template: there
exactly, in a window around it, and in one as wide as a compact match can reach. Aligned words at the ends of a match
are left out where more foreign words lie between them and the rest than they are. So several licenses,
and several copies of one, are found in one text.

Defined results: null or empty text has no match; overlapping matches are resolved by aligned words,
then coverage, then the shorter stretch, then place; offsets are code points of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.frames import keyed_text, map_batches

COVERAGE = 0.8
SPREAD = 1.6
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

# Public license notices by SPDX-like name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-notice": "Released under the BSD License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
# Words of which a match must hold one.
KEY_WORDS = frozenset("license licensed licenses mit apache gnu bsd cc copyright permission redistribute warranty".split())


class Template(NamedTuple):
    name: str
    words: tuple[str, ...]


class Match(NamedTuple):
    name: str
    coverage: float
    aligned: int
    first: int  # word numbers in the text
    last: int


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def templates(texts: dict[str, str] = TEMPLATES) -> list[Template]:
    return [Template(name, tuple(w for w, _, _ in words_of(text))) for name, text in texts.items()]


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    pile: list[int] = []
    back: list[int] = []
    for i, value in enumerate(values):
        at = bisect_left(tops, value)
        back.append(pile[at - 1] if at else -1)
        if at == len(tops):
            tops.append(value)
            pile.append(i)
        else:
            tops[at], pile[at] = value, i
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[str], template: list[str] | tuple[str, ...]) -> list[tuple[int, int]]:
    """Aligned (text word, template word) pairs, increasing in both; recursion by a worklist."""
    pairs: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict[str, int] = {}
        for i in range(a, b):
            once[text[i]] = -1 if text[i] in once else i
        there: dict[str, int] = {}
        for j in range(c, d):
            there[template[j]] = -1 if template[j] in there else j
        anchors = [(once[w], j) for w, j in there.items() if j >= 0 and once.get(w, -1) >= 0]
        kept = [anchors[k] for k in longest_increasing([i for i, _ in anchors])]
        if not kept:
            continue
        pairs += kept
        for (i, j), (k, m) in zip([(a - 1, c - 1), *kept], [*kept, (b, d)], strict=True):
            work.append((i + 1, k, j + 1, m))
    return sorted(pairs)


def _core(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretch of pairs with most aligned words after one is taken off for every word that the text has in between beyond the template's."""
    best, begins, ends, run, first = 0, 0, 0, 0, 0
    for n, (i, j) in enumerate(pairs):
        run -= max(0, i - pairs[n - 1][0] - (j - pairs[n - 1][1])) if n else 0
        if run < 0:
            run, first = 0, n
        run += 1
        if run >= best:
            best, begins, ends = run, first, n + 1
    return pairs[begins:ends]


def find_licenses(words: list[str], known: list[Template], coverage: float = COVERAGE) -> list[Match]:
    """Non-overlapping matches in a text's words."""
    keys = [i for i, w in enumerate(words) if w in KEY_WORDS]
    found: set[Match] = set()
    for template in known if keys else []:
        size = len(template.words)
        vocabulary = set(template.words)
        # a compact match reaches at most this far beyond where the template would lie
        wide = int(SPREAD * size) - ceil(coverage * size) + 1
        # a match may lack this many words of the template, each of which may be the only one of its kind
        least = len(vocabulary) - (size - ceil(coverage * size))
        places: dict[str, list[int]] = {}
        for j, w in enumerate(template.words):
            if w in KEY_WORDS:
                places.setdefault(w, []).append(j)
        windows: set[tuple[int, int]] = set()
        # where the template would start, for each key word of the text and each of its places in the template
        for start in sorted({key - j for key in keys for j in places.get(words[key], ())}):
            lo, hi = max(0, start - wide), min(len(words), start + size + wide)
            if len(vocabulary.intersection(words[lo:hi])) < least:
                continue
            if start >= 0 and tuple(words[start : start + size]) == template.words:
                found.add(Match(template.name, 1.0, size, start, start + size - 1))
                continue
            windows |= {(max(0, start - slack), min(len(words), start + size + slack)) for slack in (0, wide // 3, wide)}
        for lo, hi in windows:
            if len(vocabulary.intersection(words[lo:hi])) < least:
                continue
            pairs = patience(words[lo:hi], template.words)
            # drop outliers at the ends until the match is compact
            while pairs and pairs[-1][0] - pairs[0][0] + 1 > SPREAD * size:
                pairs = pairs[1:] if pairs[1][0] - pairs[0][0] >= pairs[-1][0] - pairs[-2][0] else pairs[:-1]
            core = _core(pairs)
            pairs = core if len(core) >= coverage * size else pairs
            if len(pairs) >= coverage * size and any(words[lo + i] in KEY_WORDS for i, _ in pairs):
                found.add(Match(template.name, round(len(pairs) / size, 6), len(pairs), lo + pairs[0][0], lo + pairs[-1][0]))
    out: list[Match] = []
    for match in sorted(found, key=lambda m: (-m.aligned, -m.coverage, m.last - m.first, m.first, m.name)):
        if all(match.last < m.first or m.last < match.first for m in out):
            out.append(match)
    return sorted(out, key=lambda m: m.first)


def license_scan(documents: DataFrame, texts: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, n_licenses, licenses, coverage) of every row; licenses are name:start:end, comma-joined."""
    known = templates(texts)

    def kernel(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("n_licenses", "licenses", "coverage")}
        for text in batch.column("text").to_pylist():
            low = (text or "").lower()
            words = words_of(text) if any(k in low for k in KEY_WORDS) else []
            found = find_licenses([w for w, _, _ in words], known, coverage)
            out["n_licenses"].append(len(found))
            out["licenses"].append(",".join(f"{m.name}:{words[m.first][1]}:{words[m.last][2]}" for m in found))
            out["coverage"].append(max((m.coverage for m in found), default=0.0))
        return {"doc_id": batch.column("doc_id"), **out}

    return map_batches(keyed_text(documents), kernel, "doc_id long, n_licenses int, licenses string, coverage double")
