"""License scans: MinHash bands over overlapping windows, exact containment.

Texts and templates are words (runs of letters and digits, lower-cased). Each template
size has windows of one and a half times as many words as the template, half a
template apart, so that a notice lies wholly in some window. A window's MinHash
signature is looked up band by band; with BANDS bands of one row each, a window that
holds three quarters of a template's shingles, and so has a Jaccard similarity of
about a third or more with it, is retrieved with a probability above 0.9999. Exact
containment of the template's shingles in the window verifies it. Windows without
any of the templates' shingles can't hold one and get no signature.

Templates are sentences of notices and whole licence texts. A licence has one row for each
document, of its template and window of the greatest containment.

Cases: a null or empty text, or one shorter than a shingle, holds nothing; a notice
that stands repeatedly in a text has one row, of its best and then first window;
repeated rows are scanned each; a very long text is scanned whole; further columns aren't read;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, BANDS = 5, 32
_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)

# Wordings of common public licences and notices.
LICENSES: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: Sequence[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def _shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles, in order."""
    n = len(h) - WIDTH + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        s = s * _ODD + h[k : k + n]
        s ^= s >> np.uint64(29)
    return _mixed(s)


class Templates:
    """Templates with their signatures, by size."""

    def __init__(self, texts: Sequence[tuple[str, str]], percent: int):
        self.percent, self.names, self.sets, self.vocabulary = percent, [], [], set()
        self.seeds = _mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
        self.bands: dict[int, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, text in texts:
            words = _WORD.findall(text.lower())
            shingles = np.unique(_shingles(_hashes(words)))
            if len(shingles):
                self.vocabulary.update(words)
                for band, value in enumerate(self.signature(shingles).tolist()):
                    self.bands[len(words)][band, value].append(len(self.names))
                self.names.append(name)
                self.sets.append(shingles)
        self.shingles = np.unique(np.concatenate(self.sets)) if self.sets else np.empty(0, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return (shingles[:, None] * self.seeds).min(axis=0)

    def scan(self, text: str) -> dict[str, tuple[float, int, int]]:
        """By licence: containment, and the code points from and to which the shared shingles reach."""
        low = text.lower()
        words = _WORD.findall(low)
        known = list(map(self.vocabulary.__contains__, words))
        if len(words) < WIDTH or sum(known) < WIDTH:
            return {}
        # Five known words in a row, or nothing can be shared.
        runs = np.convolve(np.array(known, dtype=np.int32), np.ones(WIDTH, dtype=np.int32), "valid")
        if runs.max() < WIDTH:
            return {}
        found: dict[str, tuple[float, int, int]] = {}
        near = np.flatnonzero(runs == WIDTH)
        parts = np.unique((near[:, None] + np.arange(WIDTH)).ravel())
        own = np.zeros(len(words), dtype=np.uint64)
        own[parts] = _hashes([words[i] for i in parts.tolist()])
        hits = near[np.isin(_shingles(own)[near], self.shingles, assume_unique=False)]
        places = None
        for size, bands in self.bands.items() if len(hits) else ():
            step, width = max(1, size // 2), size + max(1, size // 2)
            starts = np.unique(np.maximum(0, (hits[:, None] // step - np.arange(width // step + 1)) * step).ravel())
            for start in starts.tolist():
                piece = words[start : start + width]
                shingles = _shingles(_hashes(piece))
                if not len(shingles):
                    continue
                distinct = np.unique(shingles)
                for k in sorted({k for band, value in enumerate(self.signature(distinct).tolist()) for k in bands.get((band, value), ())}):
                    shared = np.intersect1d(distinct, self.sets[k], assume_unique=True)
                    if 100 * len(shared) >= self.percent * len(self.sets[k]):
                        at = np.flatnonzero(np.isin(shingles, shared)) + start
                        places = places or [m.span() for m in _WORD.finditer(low)]
                        got = (len(shared) / len(self.sets[k]), places[at[0]][0], places[at[-1] + WIDTH - 1][1])
                        if self.names[k] not in found or (-got[0], got[1]) < (-found[self.names[k]][0], found[self.names[k]][1]):
                            found[self.names[k]] = got
        return found


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = LICENSES, percent: int = 75) -> DataFrame:
    """(doc_id, license_id, containment, start, end) for each document and licence found; docs: (doc_id, text).

    templates are (licence, wording), a list that the caller holds; it goes to each task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Templates(templates, percent)
        for batch in batches:
            rows = [(k, name, *got) for k, t in enumerate(batch.column("text").to_pylist()) for name, got in sorted(index.scan(t or "").items())]
            c = [list(x) for x in zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.string()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32())], ["doc_id", "license_id", "containment", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license_id string, containment double, start int, end int")
