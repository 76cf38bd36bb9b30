"""License scans by MinHash over overlapping windows, verified by exact containment.

A text is cut into blocks of words, and two neighbouring blocks are a window, for several lengths of block. A window's
MinHash values, one a band, retrieve the templates that share one of them; a template is found in a window if it holds
enough of the template's five-word shingles, compared word for word.

A window of two blocks of b words holds any passage of b + 1 words, so a template of t words has a window of fewer
than 4 t words. Where a share c of its n shingles is there, the Jaccard index with that window is at least
c n / (4 t + (1 - c) n), and BANDS bands of one value each miss it with the chance (1 - index) ** BANDS: 4e-6 for a
template of 24 words or more of which 0.8 are there, and less for longer ones. That is no guarantee for templates of few
shingles. Up to FEW of them, the windows that are retrieved are those around each of the template's shingles, each a
window of its own whose MinHash is the shingle: no band can miss.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import Memo, quoted, read, slices

SHINGLE, CONTAINED, BANDS = 5, 0.8, 64
#: Words a block, for templates of up to as many words.
BLOCKS = (8, 16, 32, 64, 128, 256)
#: Shingles up to which a template is retrieved by each of them.
FEW = 20

# Notices of common public licenses, as their licensors give them.
TEMPLATES = (
    ("Apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("MIT-short", "Released under the MIT License."),
    ("GPL-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-short", "Licensed under CC BY-NC 4.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ),
    (
        "MIT-disclaimer",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL '
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause-endorsement",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-disclaimer",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR '
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU Affero General Public License for more details.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)

EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
MULTIPLIERS = np.random.default_rng(5).integers(1, 2**62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def plain(word: str) -> str:
    """A word in lower case without marks at its ends; words of marks alone are empty and left out."""
    return EDGES.sub("", word.lower())


def hashed(word: str) -> int:
    """The word's hash, 0 for words that are left out."""
    return xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass")) or 1 if (p := plain(word)) else 0


def shingles(words: np.ndarray) -> np.ndarray:
    """One number for each five words in a row: their hashes, mixed in order."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        out = (out ^ words[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def permuted(numbers: np.ndarray, band: int) -> np.ndarray:
    """The numbers in a band's order of them."""
    mixed = numbers * MULTIPLIERS[band]
    mixed ^= mixed >> np.uint64(31)
    return mixed * MIX


@dataclass
class Template:
    name: str
    words: tuple[str, ...]
    numbers: np.ndarray
    shingles: frozenset[tuple[str, ...]]


class Index:
    """Templates by length of block, and for each band the templates of each MinHash value.

    few: the shingles of templates that have few, in order, and for each the templates and their lengths of block.
    """

    def __init__(self, templates: list[tuple[str, str]], blocks: tuple[int, ...] = BLOCKS):
        self.tables: dict[int, list[tuple[np.ndarray, dict[int, list[Template]]]]] = {}
        self.few: dict[int, list[tuple[int, Template]]] = defaultdict(list)
        by_block = defaultdict(list)
        for name, text in templates:
            words = tuple(p for w in (text or "").split() if (p := plain(w)))
            grams = frozenset(words[i : i + SHINGLE] for i in range(len(words) - SHINGLE + 1))
            if grams:
                template = Template(name, words, np.unique(shingles(np.array([hashed(w) for w in words], np.uint64))), grams)
                block = next((b for b in blocks if b >= len(words)), len(words))
                if len(grams) > FEW:
                    by_block[block].append(template)
                for number in template.numbers.tolist() if len(grams) <= FEW else ():
                    self.few[number].append((block, template))
        self.values = np.array(sorted(self.few), np.uint64)
        for block, found in by_block.items():
            bands = []
            for band in range(BANDS):
                table: dict[int, list[Template]] = defaultdict(list)
                for t in found:
                    table[int(permuted(t.numbers, band).min())].append(t)
                bands.append((np.array(sorted(table), np.uint64), dict(table)))
            self.tables[block] = bands


class Blocks:
    """Where the blocks of some texts, laid end to end, begin, and which of them is a text's last."""

    def __init__(self, sizes: np.ndarray, block: int):
        counts = -(-sizes // block)
        self.text = np.repeat(np.arange(len(sizes)), counts)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.starts = (np.cumsum(sizes) - sizes)[self.text] + self.number * block
        self.last = self.number == counts[self.text] - 1

    def windows(self, values: np.ndarray) -> np.ndarray:
        """The least value of each window of two blocks; the window of a text's last block is that block."""
        least = np.minimum.reduceat(values, self.starts)
        return np.where(self.last, least, np.minimum(least, np.append(least[1:], least[-1])))


def retrieved(numbers: list[np.ndarray], index: Index) -> dict[tuple[int, int], tuple[int, Template, set[int]]]:
    """By text and template: the length of the blocks, the template, and the windows that share a MinHash value with it.

    A shingle of a template that has few retrieves the two windows it begins in.
    """
    sizes, flat = np.array([len(x) for x in numbers], np.int64), np.concatenate(numbers)
    out: dict[tuple[int, int], tuple[int, Template, set[int]]] = {}
    if not len(flat):
        return out
    if len(index.values):
        begins = np.cumsum(sizes) - sizes
        at = np.minimum(np.searchsorted(index.values, flat), len(index.values) - 1)
        for p in np.nonzero(index.values[at] == flat)[0].tolist():
            text = int(np.searchsorted(begins, p, side="right")) - 1
            for block, t in index.few[int(flat[p])]:
                number = (p - int(begins[text])) // block
                out.setdefault((text, id(t)), (block, t, set()))[2].update({number, max(number - 1, 0)})
    places = {block: Blocks(sizes, block) for block in index.tables}
    for band in range(BANDS):
        mixed = permuted(flat, band)
        for block, bands in index.tables.items():
            values, table = bands[band]
            least = places[block].windows(mixed)
            at = np.minimum(np.searchsorted(values, least), len(values) - 1)
            for w in np.nonzero(values[at] == least)[0]:
                for t in table[int(least[w])]:
                    text = int(places[block].text[w])
                    out.setdefault((text, id(t)), (block, t, set()))[2].add(int(places[block].number[w]))
    return out


def found_in(texts: list[str], index: Index, word: Memo) -> list[tuple[int, str, float, int, int, int]]:
    """(text, template, containment, first word, its end, windows) of each template that some window of a text holds.

    Containment is the largest of its windows' and the place the first window of it; words are those that are not left out.
    """
    raw = [t.split() for t in texts]
    hashes = [np.fromiter(map(word.__getitem__, ws), np.uint64, len(ws)) for ws in raw]
    kept = [np.nonzero(h)[0] for h in hashes]
    candidates = retrieved([shingles(h[k]) for h, k in zip(hashes, kept, strict=True)], index) if texts else {}
    out = []
    for (i, _), (block, t, places) in candidates.items():
        best, hits = (0.0, 0), 0
        for w in sorted(places):
            words = [plain(raw[i][j]) for j in kept[i][w * block : (w + 2) * block + SHINGLE - 1]]
            grams = {tuple(words[j : j + SHINGLE]) for j in range(len(words) - SHINGLE + 1)}
            share = len(grams & t.shingles) / len(t.shingles)
            if share >= CONTAINED:
                hits += 1
                best = max(best, (share, -w))
        if hits:
            first = -best[1] * block
            out.append((i, t.name, best[0], first, min(first + 2 * block + SHINGLE - 1, len(kept[i])), hits))
    return sorted(out)


SCHEMA = "doc_id long, template string, containment double, first_word long, end_word long, windows long"


def _scanner(templates: list[tuple[str, str]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, word = Index(templates), Memo(hashed, 700_000)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches):
            ids = batch.column("id").to_pylist()
            rows = [(ids[i], *hit) for i, *hit in found_in([t.as_py() or "" for t in batch.column("text")], index, word)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and template that it holds: where, how much of it, and in how many windows.

    Null and empty texts, and texts or templates of fewer than five words, match nothing. Rows that repeat match as often
    as they are there; null ids stay null. Templates are a list on the driver, which bounds what the tasks hold.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(_scanner([tuple(t) for t in templates]), SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "template", F.round("containment", 6).alias("containment"), "first_word", "end_word", "windows")
