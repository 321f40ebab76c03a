"""License scans: MinHash bands over overlapping windows of words retrieve templates.

Templates are dealt into classes by length: a class of width W has those of at most W words that are too long
for the class before (widths grow by a quarter).  Windows of W + s - 1 words begin at every s-th word (s = W // 8, at
least 1), so any occurrence lies within one.  A window that holds 0.8 of a template's shingles has a
similarity of at least 0.49 with it, and shares one of BANDS bands of ROWS minwise values with probability
1 - (1 - 0.49**ROWS)**BANDS = 1 - 1.5e-6.  An index from band key to templates gives the candidates, which are
confirmed by exact containment of shingles.

Equal minwise values mean a shared shingle, so windows without any template's shingle can't
collide and need no hashing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as X

BANDS, ROWS, SHINGLE, CONTAINED = 48, 2, 3, 0.8

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."

#: Public licenses and notices, by SPDX identifier and form.
TEMPLATES = {
    "MIT (line)": "Released under the MIT License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 (line)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT (grant)": _MIT_GRANT,
    "MIT (text)": f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_WARRANTY}",
    "MIT-0 (text)": f"{_MIT_GRANT}, and to permit persons to whom the Software is furnished to do so. {_MIT_WARRANTY}",
    "BSD (grant)": _BSD_GRANT,
    "BSD-2-Clause (text)": f"{_BSD_GRANT}: 1. {_BSD_TWO.replace('. Redist', '. 2. Redist')} {_BSD_WARRANTY}",
    "BSD-3-Clause (text)": f"{_BSD_GRANT}: 1. {_BSD_TWO.replace('. Redist', '. 2. Redist')} 3. {_BSD_NAMES} {_BSD_WARRANTY}",
    "ISC (text)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib (text)": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense (text)": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0 (grant)": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0 (header)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. " + _GNU_HOPE.format("General Public License"),
    "GPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_HOPE.format("General Public License"),
    "AGPL-3.0 (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + _GNU_HOPE.format("Affero General Public License"),
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def shingles(w: list[bytes]) -> set:
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def class_of(size: int) -> tuple[int, int]:
    """(words of a window, words between the beginnings of two) for templates of ``size`` words."""
    width = SHINGLE
    while width < size:
        width = max(width + 1, width * 5 // 4)
    step = max(1, width // 8)
    return width + step - 1, step


class Class:
    """The templates of one class: their shingles, and the index from band key to template."""

    def __init__(self, members: list[int], hashes: list[np.ndarray], wide: int, step: int):
        self.wide, self.step = wide, step
        self.all = np.unique(np.concatenate(hashes))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True
        bands = np.concatenate([band_keys(h[None, :]) for h in hashes])
        order = np.argsort(bands, axis=0, kind="stable")
        self.keys = np.take_along_axis(bands, order, 0)
        self.members = np.array(members)[order]

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of shingles that some template has."""
        may = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return may[self.all[np.minimum(np.searchsorted(self.all, h[may]), len(self.all) - 1)] == h[may]] if len(may) else may

    def retrieved(self, keys: np.ndarray) -> np.ndarray:
        """(window, template) of all that share a band, sorted."""
        found = [np.zeros((0, 2), np.int64)]
        for b in range(BANDS):
            low, high = (np.searchsorted(self.keys[:, b], keys[:, b], side) for side in ("left", "right"))
            many = high - low
            row = np.repeat(np.arange(len(keys)), many)
            at = np.repeat(low, many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.stack([row, self.members[at, b]], 1))
        return np.unique(np.concatenate(found), axis=0)


_ODD = X.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SALT = X.mix(_ODD)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """(windows, BANDS) keys of windows given by their shingles' hashes (windows, shingles)."""
    out = np.zeros((len(rows), BANDS), np.uint64)
    for b in range(BANDS):
        for r in range(ROWS):
            out[:, b] = X.mix(out[:, b] * X._C1 ^ ((rows ^ _SALT[b * ROWS + r]) * _ODD[b * ROWS + r]).min(1))
    return out


class Templates:
    """Templates by class."""

    def __init__(self, texts: dict[str, str]):
        self.names = list(texts)
        self.sets = [shingles(words(t)) for t in texts.values()]
        self.sizes = [len(words(t)) for t in texts.values()]
        if any(n < SHINGLE for n in self.sizes):
            raise ValueError(f"templates need at least {SHINGLE} words")
        hashes = [self._hashes(t) for t in texts.values()]
        by: dict[tuple[int, int], list[int]] = {}
        for t, n in enumerate(self.sizes):
            by.setdefault(class_of(n), []).append(t)
        self.classes = [Class(ts, [hashes[t] for t in ts], *c) for c, ts in sorted(by.items())]

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        data, offs = X.flat(pa.array([text]))
        data = X.LOWER[data]
        s, e, _ = X.find_words(data, offs, X.ALNUM)
        return np.unique(X.shingle_hashes(X.word_hashes(data, s, e), SHINGLE))

    def scan(self, texts) -> list[tuple[int, int, float, int, int]]:
        """(row, template, containment, first word, words) of each template in each text: its best window, the first of equals."""
        data, offs = X.flat(texts)
        data = X.LOWER[data]
        starts, ends, first = X.find_words(data, offs, X.ALNUM)
        h = X.shingle_hashes(X.word_hashes(data, starts, ends), SHINGLE)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for c in self.classes:
            hit = c.hits(h)
            hit = hit[row[hit] == row[hit + SHINGLE - 1]] if len(hit) else hit
            if not len(hit):
                continue
            d, inner = row[hit], hit - first[row[hit]]
            begin = (inner // c.step)[:, None] - np.arange(-(-c.wide // c.step) + 1)[None, :]
            ok = (begin >= 0) & (begin * c.step + c.wide >= inner[:, None] + SHINGLE)
            grid = np.unique(np.stack([np.broadcast_to(d[:, None], begin.shape)[ok], begin[ok] * c.step], 1), axis=0)
            at = first[grid[:, 0]] + grid[:, 1]
            end = np.minimum(at + c.wide, first[grid[:, 0] + 1])
            n = end - at - SHINGLE + 1
            for lo in range(0, len(grid), 20_000):
                part = slice(lo, lo + 20_000)
                cols = np.minimum(np.arange(c.wide - SHINGLE + 1)[None, :], n[part][:, None] - 1)
                last, found = -1, set()
                for i, t in c.retrieved(band_keys(h[at[part][:, None] + cols])).tolist():
                    i += lo
                    if i != last:
                        found = shingles([data[a:b].tobytes() for a, b in zip(starts[at[i] : end[i]], ends[at[i] : end[i]], strict=True)])
                        last = i
                    share = len(found & self.sets[t]) / len(self.sets[t])
                    key = (int(grid[i, 0]), t)
                    if share >= CONTAINED and share > best.get(key, (0,))[0]:
                        best[key] = (share, int(grid[i, 1]), int(end[i] - at[i]))
        return [(d, t, *v) for (d, t), v in sorted(best.items())]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs and template found in it: id, license, containment, first_word (from 0), n_words (of the window).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  A template is found
    where a window holds at least CONTAINED of its distinct three-word shingles; the best window is
    given, the first of equals.  Null ids stay null, null texts hold nothing, extra columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in X.slices(batches, "_text"):
            got = m.scan(part.column(1))
            if got:
                d, t, share, at, n = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([m.names[i] for i in t]), pa.array(share), pa.array(at, pa.int64()), pa.array(n, pa.int64())], [id_col, "license", "containment", "first_word", "n_words"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("license", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))
