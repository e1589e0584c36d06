"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Words are runs of ASCII letters and digits (lower-cased) and of other non-ASCII bytes; all else
parts words.  Each template's hashed runs of ``gram`` words are winnowed: of each ``window`` in a
row the smallest is kept, so a shared run of ``gram + window - 1`` words always meets one; both are
chosen per template by the edits that the coverage allows (``fingerprint``).  All runs of a whole text are looked up in the inverted index of these; hits on neighbouring diagonals are one
candidate, which is aligned with its template inside a band.  Hot license lines are cheap: equal
pieces of text are aligned once per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import table
from .words import Words, split

GRAM, WINDOW, BAND = 3, 3, 12
#: Of templates with fewer words all runs of two words are indexed.
SHORT = GRAM + 2 * WINDOW - 1
#: Least share of a template's words that a match must cover.
COVERAGE = 0.8

#: The notices and license texts that are looked for.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

_KEPT = np.full(256, 0x20, dtype=np.uint8)
for _b in range(256):
    if _b >= 128 or chr(_b).isalnum():
        _KEPT[_b] = ord(chr(_b).lower()) if _b < 128 else _b


def _plain(texts: pa.Array) -> pa.Array:
    """The texts with all but word characters blanked, byte for byte."""
    texts = texts.fill_null("")
    if not len(texts) or texts.buffers()[2] is None:
        return texts
    data = _KEPT[np.frombuffer(texts.buffers()[2], np.uint8)]
    return pa.Array.from_buffers(texts.type, len(texts), [None, texts.buffers()[1], pa.py_buffer(data.tobytes())], offset=texts.offset)


def fingerprint(size: int, coverage: float) -> tuple[int, int]:
    """gram and window for a template of size words.

    As many edits as the coverage allows words to be lost, each a word lost, replaced or put in,
    leave a run of gram + window - 1 words, however they are spread.
    """
    least = min(size, max(1, math.ceil(coverage * size)))
    run = -(-least // (size - least + 1))
    gram = min(run, 2 if size < SHORT else GRAM)
    return gram, 1 if size < SHORT else min(WINDOW, run - gram + 1)


class Index:
    """Inverted index from fingerprints to (template, word), by gram."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for t, text in enumerate(templates.values()):
            (w,) = split(_plain(pa.array([text])))
            if len(w.hash) < GRAM:
                raise ValueError(f"template {self.names[t]} has fewer than {GRAM} words")
            self.words.append(w.hash)
            gram, window = fingerprint(len(w.hash), coverage)
            at, g = w.grams(gram)
            for i in sorted({int(i + np.argmin(g[i : i + window])) for i in range(max(1, len(g) - window + 1))}):
                found.setdefault(gram, []).append((int(g[i]), t, int(at[i])))
        self.parts = []
        for gram, rows in sorted(found.items()):
            keys = np.array([r[0] for r in rows], np.uint64)
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            may = np.zeros(1 << 16, dtype=bool)
            may[(keys >> np.uint64(48)).astype(np.int64)] = True
            self.parts.append((gram, keys, np.array([r[1] for r in rows])[by], np.array([r[2] for r in rows])[by], may))
        self.bands = np.array([min(BAND, max(1, len(x) // 3)) for x in self.words])  # hits farther apart are different matches

    def candidates(self, w: Words) -> list[tuple[int, int, int]]:
        """(row, template, first word of the slice if nothing is inserted or lost), each once."""
        hits = []
        for gram, keys, owners, places, filtered in self.parts:
            at, g = w.grams(gram)
            may = filtered[(g >> np.uint64(48)).astype(np.int64)]
            at, g = at[may], g[may]
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            n = hi - lo
            spot = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at = np.repeat(at, n)
            hits.append((w.doc[at], owners[spot], at - places[spot]))
        if not hits:  # no templates
            return []
        row, owner, begin = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((begin, owner, row))
        row, owner, begin = row[order], owner[order], begin[order]
        if not len(row):
            return []
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (np.diff(begin) > self.bands[owner[1:]])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(row)]]) - 1
        return [(int(row[i]), int(owner[i]), int(begin[(i + j) // 2])) for i, j in zip(first, last, strict=True)]


def align(template: np.ndarray, piece: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order inside the band, and the words of the piece from the first to the last match.

    Word i of the template may match word j of the piece if |j - i - shift| <= band.  Each match
    scores 2 and each word passed over, in either, costs 1, from the first match to the last: the
    best-scoring stretch counts, of equal ones the earliest that ends first.
    """
    width = 2 * band + 1
    below = -(10**9)
    # State per diagonal: score, matches, first matched word.  A stretch starts at any match.
    score, count, first = [below] * width, [0] * width, [0] * width
    best = (0, 0, 0, 0)
    for i in range(len(template)):
        new_score, new_count, new_first = [below] * width, [0] * width, [0] * width
        for d in range(width):
            j = i + shift + d - band
            if not 0 <= j < len(piece):
                continue
            s, c, f = below, 0, 0
            if score[d] - 2 > s:  # both words differ
                s, c, f = score[d] - 2, count[d], first[d]
            if d + 1 < width and score[d + 1] - 1 > s:  # a template word is missing
                s, c, f = score[d + 1] - 1, count[d + 1], first[d + 1]
            if d and new_score[d - 1] - 1 > s:  # a word was inserted
                s, c, f = new_score[d - 1] - 1, new_count[d - 1], new_first[d - 1]
            if template[i] == piece[j]:
                t, n, b = (score[d] + 2, count[d] + 1, first[d]) if score[d] > 0 else (2, 1, j)
                if t >= s:
                    s, c, f = t, n, b
                    if s > best[0]:
                        best = (s, c, f, j + 1)
            new_score[d], new_count[d], new_first[d] = s, c, f
        score, count, first = new_score, new_count, new_first
    return best[1:]


def outermost(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (n, template, lo, hi), best first, those that no better one contains.

    By ascending lo, with a tree of the best rank at or beyond each hi: n log n, however many there are.
    """
    his = sorted({x[3] for x in found}, reverse=True)
    place = {hi: i + 1 for i, hi in enumerate(his)}
    best = [len(found)] * (len(his) + 1)
    kept, i = [], 0
    by = sorted(range(len(found)), key=lambda r: found[r][2])
    while i < len(by):
        j = i
        while j < len(by) and found[by[j]][2] == found[by[i]][2]:
            at = place[found[by[j]][3]]
            while at < len(best):
                best[at] = min(best[at], by[j])
                at += at & -at
            j += 1
        for r in by[i:j]:
            at, least = place[found[r][3]], len(found)
            while at:
                least = min(least, best[at])
                at -= at & -at
            if least >= r:
                kept.append(r)
        i = j
    return [found[r] for r in sorted(kept)]


def matches(index: Index, w: Words, aligned, coverage: float) -> list[tuple[int, str, float, int, int, int]]:
    """(row, template, coverage, matched words, first byte, end byte) in a slice; a match inside a larger one is left out."""
    by_row: dict[int, list[tuple[int, int, int, int]]] = {}
    for row, t, begin in index.candidates(w):
        size = len(index.words[t])
        band = int(index.bands[t])
        a = max(int(w.offset[row]), begin - band)
        z = min(int(w.offset[row + 1]), begin + size + band)
        n, lo, hi = aligned(t, w.hash[a:z].tobytes(), begin - a)
        if n >= coverage * size:
            by_row.setdefault(row, []).append((n, t, a + lo, a + hi))
    out = []
    for row, found in sorted(by_row.items()):
        for n, t, lo, hi in outermost(sorted(set(found), key=lambda x: (-x[0], x[2], x[1]))):
            out.append((row, index.names[t], n / len(index.words[t]), n, int(w.start[lo]), int(w.end[hi - 1])))
    return out


def _scanner(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, coverage)
        aligned = lru_cache(maxsize=50_000)(lambda t, piece, shift: align(index.words[t], np.frombuffer(piece, np.uint64), shift, int(index.bands[t])))
        for b in batches:
            at, rows = 0, []
            texts = b.column(1).fill_null("")
            for w in split(_plain(texts), lower=False):
                found = matches(index, w, aligned, coverage)
                chars = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)]) if found else []
                for row, name, share, n, lo, hi in found:
                    begin = chars[w.bounds[row]]
                    rows.append((at + row, name, share, n, int(chars[lo] - begin), int(chars[hi] - begin)))
                at += w.n_docs
            ids = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            types = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "license", "coverage", "matched_words", "start_char", "end_char"])

    return run


#: Characters of a table of templates, at most: each task holds its index.
TEMPLATE_CHARS = 20_000_000


def templates_of(rows: DataFrame) -> dict[str, str]:
    """A table license, text as templates; it must fit in every task, and names must differ."""
    rows = rows.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text")
    size, n, names = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*"), F.count_distinct("license")).first()
    if size > TEMPLATE_CHARS or n != names:
        raise ValueError("too many characters of templates, or several templates of one name")
    return {r.license: r.text for r in rows.collect()}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, coverage, matched_words, start_char, end_char: a row per match in the whole texts.

    templates: by name, or a table license, text; None: the library's own; none at all match nothing.  coverage is the share of the template's words that the alignment matches.  A text may match
    several templates, and one several times; a match inside a larger one is left out.  With at most
    as many edits (a word lost, replaced or put in) as words may be lost, a notice shares an indexed
    run.  Missed can be one with more words put in than that, or with words that lie more than the
    band (a third of the template, 12 words at most) off the middle of its runs' diagonals.  Null, empty
    and blank texts match nothing.  Ids may be null or repeat; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    templates = TEMPLATES if templates is None else templates
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scanner(templates, coverage), f"doc_id {kind}, license string, coverage double, matched_words long, start_char long, end_char long")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
