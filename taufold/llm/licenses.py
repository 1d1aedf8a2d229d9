"""License notices in documents: winnowed fingerprints find them, banded alignment measures them.

Templates are cut into runs of words whose hashes are winnowed (the least of
every few neighbours) into an inverted index.  Texts are winnowed alike; equal
fingerprints propose (template, shift).  Shifts that lie close together are
aligned in a band around them, which tolerates changed, missing and added words,
and gives the share of the template that is there and its span in the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taufold.llm import words as W

#: Words in a fingerprint, and neighbours of which the least is kept: a shared run of GRAM + KEEP - 1 words is never missed.
GRAM = 3
KEEP = 3
#: Words that a span may be shifted within its template.
BAND = 8
#: Least share of a template's words that a reported span matches.
COVERAGE = 0.7
#: Alignments that a task remembers, by words and template.
REMEMBERED = 4_096

#: Notices and permission texts of widely used public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_2 = (
    TEMPLATES["bsd"] + " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
#: Whole texts of those of which the templates above are the beginning: more matched words win, so a whole or shortened text is
#: reported by these names and its share of the whole; one cut to less than ``COVERAGE`` by its beginning's.
TEMPLATES |= {
    "mit-text": TEMPLATES["mit"] + " " + _AS_IS + "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-text": _BSD_2 + _BSD_END,
    "bsd-3-text": _BSD_2 + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission." + _BSD_END,
    "isc-text": TEMPLATES["isc"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
    "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "unlicense-text": TEMPLATES["unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
    "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
    "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act "
    "of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + "BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
    "USE OR OTHER DEALINGS IN THE SOFTWARE.",
}


def winnowed(grams: np.ndarray, inside: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """Which grams are the least of some ``keep`` neighbours; a run of fewer grams between outside ones keeps all."""
    kept = np.zeros(len(grams), bool)
    run = inside.copy()  # a gram from which ``keep`` in a row are inside
    for k in range(1, keep):
        run[: len(run) - k] &= inside[k:]
        run[len(run) - k :] = False
    start = np.flatnonzero(run)
    best = start.copy()
    for k in range(1, keep):
        best = np.where(grams[start + k] <= grams[best], start + k, best)
    kept[best] = True
    covered = run.copy()
    for k in range(1, keep):
        covered[k:] |= run[: len(run) - k]
    return kept | (inside & ~covered)


class _Index:
    """Fingerprint -> (template, place) of all templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [W.hash_text(t.encode(), W.ALNUM) for t in templates.values()]
        entries = []
        for t, hashes in enumerate(self.words):
            grams = W.shingle_hashes(hashes, min(GRAM, max(1, len(hashes))))
            # Short notices keep every fingerprint: a text's winnowing may choose any of them.
            places = np.arange(len(grams)) if len(grams) < 2 * KEEP else np.flatnonzero(winnowed(grams, np.ones(len(grams), bool)))
            entries += [(int(grams[p]), t, int(p)) for p in places]
        entries.sort()
        keys = np.array([e[0] for e in entries], np.uint64)
        self.keys, self.first = np.unique(keys, return_index=True)
        self.count = np.diff(np.append(self.first, len(keys)))
        self.template = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)
        self.table = W.HashTable(max(4, (2 * len(self.keys)).bit_length()))
        self.table.add(self.keys, 0)
        # A run of fewer than GRAM + KEEP - 1 words may lose all its grams to neighbours: those are looked up unwinnowed.
        short = {int(g) for h in self.words if 0 < len(h) < GRAM + KEEP - 1 for g in W.shingle_hashes(h, min(GRAM, len(h)))}
        self.short = W.HashTable(max(4, (2 * len(short)).bit_length()))
        self.short.add(np.array(sorted(short), np.uint64), 0)
        self.sizes = sorted({min(GRAM, max(1, len(h))) for h in self.words if len(h)})


def align(text: list[int], template: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """(score, matches, start, end) of the best local alignment whose shift text - template lies in low..high.

    A match is worth 2; a changed, missing or added word costs 1.
    """
    best = (0, 0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}  # shift -> (score, matches, start) at the template word before
    for t, want in enumerate(template):
        now: dict[int, tuple[int, int, int]] = {}
        for shift in range(low, high + 1):
            at = t + shift
            if not 0 <= at < len(text):
                continue
            score, matches, start = before.get(shift, (0, 0, at))
            if score <= 0:
                score, matches, start = 0, 0, at
            if text[at] == want:
                cell = (score + 2, matches + 1, start)
            else:
                cell = (score - 1, matches, start)
            skip = before.get(shift + 1)  # a template word is missing from the text
            if skip is not None and skip[0] - 1 > cell[0]:
                cell = (skip[0] - 1, skip[1], skip[2])
            added = now.get(shift - 1)  # the text has a word more
            if added is not None and added[0] - 1 > cell[0]:
                cell = (added[0] - 1, added[1], added[2])
            if cell[0] > 0:
                now[shift] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], at + 1)
        before = now
    return best


def _proposals(words: W.Words, index: _Index) -> np.ndarray:
    """(text, template, first word, shift) of equal fingerprints, sorted; winnowing is over each text by itself."""
    found = []
    doc_of = words.texts()
    for size in index.sizes:
        grams = W.shingle_hashes(words.hashes, size)
        if not len(grams):
            continue
        # A run of grams ends where one would cross a text border.
        inside = np.zeros(len(grams), bool)
        inside[W.shingle_starts(words, size)] = True
        doc = doc_of[: len(grams)]
        at = np.flatnonzero(winnowed(grams, inside) | (inside & (index.short.find(grams) >= 0)))
        number = index.table.find(grams[at])
        at, number = at[number >= 0], number[number >= 0]
        times = index.count[number]
        entry = np.repeat(index.first[number], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        own = at - words.first[doc[at]]
        found.append(np.stack([doc[at], index.template[entry], own, own - index.place[entry]]))
    out = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return out[:, np.lexsort(out[::-1])]


def _spans(text: np.ndarray, template: int, want: np.ndarray, at: list[int], shift: np.ndarray, coverage: float, known: dict) -> Iterator[tuple[int, int, int]]:
    """(matches, start, end) of a template's spans, none overlapping, until every proposal (at, shift) is in one or fits none."""
    order = np.argsort(shift, kind="stable")
    ranked, place = shift[order], np.argsort(order, kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(ranked) > BAND)])  # shifts that lie close together
    starts, ends = [], []  # of the spans found, in order
    for k, word in enumerate(at):
        while True:
            near = bisect_right(starts, word)
            if near and word < ends[near - 1]:
                break
            # More added words than twice the template's would cost more than all matches are worth.
            own = ranked[(run == run[place[k]]) & (np.abs(ranked - shift[k]) <= 2 * len(want))]
            low, high = int(own[0]) - BAND, int(own[-1]) + BAND
            a = max(ends[near - 1] if near else 0, low)
            b = min(starts[near] if near < len(starts) else len(text), len(want) + high)
            part = text[a:b]
            key = (template, low - a, high - a, part.tobytes())
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = align(part.tolist(), want.tolist(), low - a, high - a)
            _, matches, start, stop = known[key]
            if matches < coverage * len(want) or not matches:
                break
            yield matches, a + start, a + stop
            spot = bisect_right(starts, a + start)
            starts.insert(spot, a + start)
            ends.insert(spot, a + stop)


def _matches(words: W.Words, index: _Index, coverage: float, known: dict) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, template, matches, first word, end word), the best of overlapping spans only."""
    proposed = _proposals(words, index)
    by_text: dict[int, list[tuple[int, int, int, int]]] = {}
    changes = np.flatnonzero((proposed[:2, 1:] != proposed[:2, :-1]).any(axis=0)) + 1
    edges = [0, *changes.tolist(), proposed.shape[1]] if proposed.shape[1] else [0]
    for at, end in zip(edges[:-1], edges[1:]):
        doc, template = proposed[:2, at].tolist()
        text = words.hashes[int(words.first[doc]) : int(words.first[doc + 1])]
        own = _spans(text, template, index.words[template], proposed[2, at:end].tolist(), proposed[3, at:end], coverage, known)
        by_text.setdefault(doc, []).extend((matches, template, start, stop) for matches, start, stop in own)
    for doc, spans in sorted(by_text.items()):
        chosen: list[tuple[int, int]] = []
        for matches, template, start, stop in sorted(set(spans), key=lambda s: (-s[0], -s[0] / len(index.words[s[1]]), s[2], s[1])):
            if all(stop <= x or start >= y for x, y in chosen):
                chosen.append((start, stop))
                yield doc, template, matches, start, stop


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, license, coverage, n_matched, start_word, end_word, start_byte, end_byte), one row per span found.

    Words are counted from 0 in their text, bytes are UTF-8; ends are behind the
    last.  Spans of one text do not overlap: more matched words win, then the
    higher coverage, the earlier span, the earlier template.  Texts that are
    NULL, empty or without a notice give no row; copies and rows of equal or
    NULL ids each give their own.  Templates without words are never found.
    """
    shared = docs.sparkSession.sparkContext.broadcast(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = _Index(shared.value), {}
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            for low, high in W.text_slices(offsets):
                words = W.find_words(data, offsets[low : high + 1], W.ALNUM)
                rows = list(_matches(words, index, coverage, known))
                if not rows:
                    continue
                doc, template, matched, start, stop = np.array(rows, np.int64).T
                first = words.first[doc]
                columns = [
                    batch.column(0).take(pa.array(doc + low)),
                    pa.array([index.names[t] for t in template.tolist()], pa.string()),
                    pa.array(matched / np.array([len(index.words[t]) for t in template.tolist()])),
                    *map(pa.array, (matched, start, stop)),
                    pa.array(words.starts[first + start] - offsets[doc + low]),
                    pa.array(words.ends[first + stop - 1] - offsets[doc + low]),
                ]
                yield pa.record_batch(columns, [doc_id, "license", "coverage", "n_matched", "start_word", "end_word", "start_byte", "end_byte"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, license string, coverage double, n_matched long, start_word long, end_word long, start_byte long, end_byte long"
    return docs.select(doc_id, text).mapInArrow(scan, schema)
