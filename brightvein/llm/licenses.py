"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts are read as words of letters and digits, lower-cased. Templates are put in
classes by length, C words in each class (C / GROWTH < length <= C). For a
class, windows of 2C words start every C words, so any C words in a row lie
whole in some window. A window's signature is the least value of each of
`BANDS` hash functions over its word shingles, one row to a band; each band is
a sorted table from value to templates, so a window costs a look-up a band
whatever the number of templates.

A window that holds the share c of a template's S shingles is as alike to it as
c S / (2C + (1 - c) S) or more, with S >= C / GROWTH - SHINGLE + 1; `least_likeness`
gives the least over all classes, 0.2 for c = 0.8, and all bands miss a pair
with a chance of (1 - likeness) ** BANDS, below 1e-6 (below 1e-8 for
exact copies). Retrieved pairs are then verified on the words themselves: the
share of the template's shingles that the window holds must reach `CONTAINED`,
and the words that tell its licence from its siblings (`TELLING`) must be there.

Notices of sibling licences differ in a few words. Where matches of different
licences cover the same words, the best contained one stays, then the longest.

Defined results: null and empty texts match nothing; repeated rows match alike;
an empty table gives an empty result; extra columns are not read. Of
overlapping windows that match one template, the best counts, then the first.
Spans are code points, from the first shingle's start to the last's end of the
shortest stretch that holds all the template's shingles that the window holds.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shingles
from ._shared import text_of

SHINGLE = 3
BANDS = 64
GROWTH = 1.25
CONTAINED = 0.8
#: Notices as their publishers word them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mit-warranty-text": 'The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.',
    "bsd-warranty-text": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.',
    "bsd-3-clause-text": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-text": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0.",
    "0bsd-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}
#: Words in a row that a match of a licence's templates must have, where the template itself has them.
TELLING = {
    "apache-2.0": ("apache license", "version 2 0"),
    "cc-by-nc-4.0": ("by nc 4 0",),
    "cc-by-4.0": ("by 4 0",),
    "cc-by-sa-4.0": ("by sa 4 0",),
    "gpl-2.0": ("gnu general public license", "version 2"),
    "gpl-3.0": ("gnu general public license", "version 3"),
    "lgpl-2.0": ("gnu library general public license", "version 2"),
    "lgpl-2.1": ("gnu lesser general public license", "version 2 1"),
    "lgpl-3.0": ("gnu lesser general public license", "version 3"),
    "agpl-3.0": ("gnu affero general public license", "version 3"),
    "bsl-1.0": ("boost software license", "version 1 0"),
    "mit": ("mit license",),
    "mpl-2.0": ("mozilla public license", "v 2 0"),
}
_WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")
_rng = np.random.default_rng(77)
_ODD = _rng.integers(1, 1 << 62, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].translate(_lower), m.start(), m.end()) for m in _WORD.finditer(text)]


def licence_of(template: str) -> str:
    return template.removesuffix("-header").removesuffix("-text")


def shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))}


class Matcher:
    """The band index over the templates, by length class, and the verification of what it retrieves."""

    def __init__(self, templates: dict[str, str], contained: float):
        self.contained = contained
        self.names, self.sets, self.telling, sizes = list(templates), [], [], []
        for i, text in enumerate(templates.values()):
            words = [w for w, _, _ in tokens(text)]
            if len(words) < SHINGLE:
                raise ValueError(f"{self.names[i]}: a template needs {SHINGLE} words")
            self.sets.append(shingle_set(words))
            self.telling.append([p for p in TELLING.get(licence_of(self.names[i]), ()) if f" {p} " in f" {' '.join(words)} "])
            sizes.append(len(words))
        #: class length -> its templates; classes end at lengths that occur
        self.classes: dict[int, list[int]] = {}
        top = math.inf
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            if not self.classes or sizes[i] * GROWTH <= top:
                top = sizes[i]
            self.classes.setdefault(top, []).append(i)
        #: per class and band the values, ascending, and the template of each
        self.bands = {length: self._bands([list(templates.values())[i] for i in members], members) for length, members in self.classes.items()}

    @staticmethod
    def _bands(texts: list[str], members: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        rows = []
        for text in texts:
            least = np.full(BANDS, np.iinfo(np.uint64).max, np.uint64)
            for _, data, offsets in _shingles.steps(pa.array([text])):
                _, _, h, first = _shingles.words(data, offsets, _shingles.ALNUM)
                least = np.minimum(least, (_shingles.shingles(h, first, SHINGLE)[0][:, None] * _ODD).min(0))
            rows.append(least)
        out = []
        for values in np.array(rows).T:
            order = np.argsort(values, kind="stable")
            out.append((values[order], np.array(members)[order]))
        return out

    def least_likeness(self) -> float:
        """Of a window and a template of which it holds the share `contained`, over all classes."""
        own = lambda t, length: self.contained * len(self.sets[t]) / (2 * length + (1 - self.contained) * len(self.sets[t]))
        return min(own(t, length) for length, members in self.classes.items() for t in members)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, set[tuple[int, int, int]]]:
        """Per text: (template, first word, last word) of the windows retrieved."""
        _, _, h, first = _shingles.words(data, offsets, _shingles.ALNUM)
        grams, at = _shingles.shingles(h, first, SHINGLE)
        found: dict[int, set[tuple[int, int, int]]] = {}
        if not len(grams):
            return found
        grids = {}
        for length in self.classes:
            blocks = -(-np.diff(at) // length)
            edge = np.concatenate([[0], np.cumsum(blocks)])
            owner = np.repeat(np.arange(len(blocks)), blocks)
            nth = np.arange(edge[-1]) - edge[owner]
            grids[length] = (at[owner] + nth * length, owner, nth, np.append(owner[1:] == owner[:-1], False))
        for k in range(BANDS):
            value = grams * _ODD[k]
            for length, bands in self.bands.items():
                begins, owner, nth, follows = grids[length]
                low = np.minimum.reduceat(value, begins)
                pair = np.where(follows, np.minimum(low, np.append(low[1:], low[-1:])), low)
                values, templates = bands[k]
                for seen in (pair, low):
                    lo, hi = np.searchsorted(values, seen, "left"), np.searchsorted(values, seen, "right")
                    for w in np.flatnonzero(hi > lo).tolist():
                        for t in templates[lo[w] : hi[w]].tolist():
                            found.setdefault(int(owner[w]), set()).add((t, int(nth[w]) * length, (int(nth[w]) + 2) * length + SHINGLE - 1))
        return found

    def verified(self, text: str, candidates: set[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        words = tokens(text)
        grams = [tuple(w for w, _, _ in words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE + 1, 1))]
        found = []
        for t, lo, hi in sorted(candidates):
            held = [i for i in range(lo, max(min(hi, len(words)) - SHINGLE + 1, lo + 1)) if grams[i] in self.sets[t]]
            share = len({grams[i] for i in held}) / len(self.sets[t])
            if share >= self.contained:
                first, last = _shortest(held, grams)
                end = min(last + SHINGLE, len(words))
                own = f" {' '.join(w for w, _, _ in words[first:end])} "
                if all(f" {p} " in own for p in self.telling[t]):
                    found.append((share, len(self.sets[t]), first, end, t))
        taken: list[tuple[int, int, int]] = []
        out = []
        for share, _, first, end, t in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3], x[4])):
            if not any(self._barred(t, first, end, *other) for other in taken):
                taken.append((t, first, end))
                out.append((self.names[t], words[first][1], words[end - 1][2], share))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _barred(self, t: int, first: int, end: int, other: int, begin: int, stop: int) -> bool:
        """Whether a better match has these words: of one template any of them, of another licence more than half of the shorter span."""
        common = min(end, stop) - max(first, begin)
        if t == other:
            return common > 0
        return licence_of(self.names[t]) != licence_of(self.names[other]) and 2 * common > min(end - first, stop - begin)


def _shortest(held: list[int], grams: list[tuple[str, ...]]) -> tuple[int, int]:
    """The first and last place of the shortest stretch of `held` that has all the different shingles at these places."""
    different = len({grams[i] for i in held})
    counts: dict[tuple[str, ...], int] = {}
    best, lo = (held[0], held[-1]), 0
    for i in held:
        counts[grams[i]] = counts.get(grams[i], 0) + 1
        while counts[grams[held[lo]]] > 1:
            counts[grams[held[lo]]] -= 1
            lo += 1
        if len(counts) == different and i - held[lo] < best[1] - best[0]:
            best = (held[lo], i)
    return best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row a match: `doc_id`, `template`, `start`, `end`, `contained`."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text"))

    def scan(batches):
        matcher = Matcher(templates, contained)
        for b in _shingles.trimmed(batches):
            ids, texts = b.column(0), b.column(1)
            rows = []
            for at, data, offsets in _shingles.steps(texts):
                for i, found in matcher.candidates(data, offsets).items():
                    rows += [(at + i, *m) for m in matcher.verified(texts[at + i].as_py(), found)]
            if rows:
                n, name, s, e, share = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), pa.array(name), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(share)], names=["doc_id", "template", "start", "end", "contained"])

    return own.mapInArrow(scan, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, template string, start long, end long, contained double")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
