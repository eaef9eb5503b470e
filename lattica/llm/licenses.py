"""License scans: stretches of text held against licence templates by the Dice coefficient of word bigrams.

Text is normalised to lower-case words of ASCII letters and digits; every other character is a gap. A stretch is any run of words, whatever the lines and
paragraphs, so notices are found inside long lines and whole licences inside long files. For a coefficient of
at least t, the numbers of bigrams must lie within a factor of (2 - t) / t of each other, and so many common bigrams must fall
within the greatest size: templates that lack them are never compared. Of overlapping matches the best stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MIT_HEAD = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:"""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details."""


def _gnu(what: str, kind: str, version: str) -> list[str]:
    """The standard notice of a GNU licence, its first sentence alone, and one-line forms."""
    grant = f"""{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by
the Free Software Foundation; either version {version} of the License, or (at your option) any later version."""
    return [
        f"This work is licensed under the GNU {kind} Public License, version {version}.", f"Released under the GNU {kind} Public License, version {version}.",
        grant, grant + " " + _GNU_END.format(kind=kind),
        f"""{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {version} as
published by the Free Software Foundation. """ + _GNU_END.format(kind=kind),
    ]


#: Public licences and the notices by which texts name them.
TEMPLATES = {
    "AGPL-3.0": _gnu("This program", "Affero General", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
the License for the specific language governing permissions and limitations under the License.""",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD": [_BSD_HEAD, "Released under the BSD License.", "This project is licensed under the BSD License."],
    "BSD-2-Clause": [" ".join([_BSD_HEAD, _BSD_TWO, _BSD_END])],
    "BSD-3-Clause": [" ".join([_BSD_HEAD, _BSD_TWO, _BSD_THIRD, _BSD_END])],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0."],
    "EPL-2.0": [
        "Released under the Eclipse Public License, version 2.0.",
        """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    ],
    "GPL-2.0": _gnu("This program", "General", "2"),
    "GPL-3.0": _gnu("This program", "General", "3"),
    "ISC": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "LGPL-2.1": _gnu("This library", "Lesser General", "2.1"),
    "LGPL-3.0": _gnu("This library", "Lesser General", "3"),
    "MIT": [
        "Released under the MIT License.", "This project is licensed under the MIT License.", _MIT_HEAD,
        _MIT_HEAD + """ The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ],
    "Proprietary": ["All rights reserved."],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In
jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to
the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "This is free and unencumbered software released into the public domain.",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications,
and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would
be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution.""",
    ],
}

_WORD = re.compile(rb"[a-z0-9]+")
_PLACE = re.compile(r"[A-Za-z0-9]+")


def words(text: str) -> list[bytes]:
    """Lower-case words of ASCII letters and digits."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def bigrams(ws: list[bytes]) -> Counter:
    return Counter(zip(ws, ws[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all, repeats counted."""
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Matcher:
    """Templates by their bigrams; a template needs two words at least."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, k, bigrams(words(text))) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)]
        self.templates = [t for t in self.templates if t[2]]
        self.vocab: dict[bytes, int] = {}
        pairs = sorted({p for *_, grams in self.templates for p in grams})
        for a, b in pairs:
            self.vocab.setdefault(a, len(self.vocab)), self.vocab.setdefault(b, len(self.vocab))
        # the word that is in no template has the last number; numbers of pairs start at 1
        size = len(self.vocab) + 1
        self.pair_of = np.zeros((size, size), np.int32)
        number = {p: i + 1 for i, p in enumerate(pairs)}
        for (a, b), i in number.items():
            self.pair_of[self.vocab[a], self.vocab[b]] = i
        self.has = np.zeros((len(self.templates), len(pairs) + 1), bool)
        self.counts = []
        for t, (_, _, grams) in enumerate(self.templates):
            self.counts.append({number[p]: n for p, n in grams.items()})
            self.has[t, list(self.counts[-1])] = True
        size = np.array([sum(c.values()) for c in self.counts])
        factor = (2 - threshold) / threshold
        self.size = size
        self.least = np.ceil(size / factor - 1e-9).astype(np.int64)  # bigrams of a stretch, and common ones
        self.most = np.floor(size * factor + 1e-9).astype(np.int64)

    def pairs(self, ws: list[bytes]) -> np.ndarray:
        """Each bigram's number, 0 if it is in no template."""
        ids = np.fromiter(map(self.vocab.get, ws, repeat(len(self.vocab))), np.int64, len(ws))
        return self.pair_of[ids[:-1], ids[1:]]

    def stretches(self, t: int, at: np.ndarray, pair: np.ndarray):
        """(coefficient, common bigrams, first, last bigram): the best stretch from each bigram of the template, if it reaches the threshold.

        ``at`` and ``pair`` are places and numbers of the template's bigrams in the text. A best stretch starts and ends with such.
        """
        least, most, size = int(self.least[t]), int(self.most[t]), int(self.size[t])
        begins = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < most).tolist()
        if not begins:
            return
        at, pair, limit = at.tolist(), pair.tolist(), self.counts[t]
        done = -1  # nothing that begins inside a stretch that equals the template can be better
        for i in begins:
            if at[i] <= done:
                continue
            used, common, best = {}, 0, (0.0,)
            for j in range(i, len(at)):
                length = at[j] - at[i] + 1
                if length > most:
                    break
                n = used.get(pair[j], 0)
                if n < limit[pair[j]]:
                    used[pair[j]] = n + 1
                    common += 1
                    value = 2 * common / (length + size)
                    if value > best[0]:
                        best = value, common, at[i], at[j]
            if best[0] >= self.threshold - 1e-12:
                done = best[3] if best[0] == 1 else done
                yield best

    def matches(self, ws: list[bytes]) -> list[tuple[str, int, int, int, float]]:
        """(name, template, first word, end word, coefficient) of the matches, best first; of overlapping ones the best, then the longest."""
        pair = self.pairs(ws) if len(ws) > 1 else np.zeros(0, np.int32)
        at = np.flatnonzero(pair)
        if not len(at):
            return []
        pair = pair[at]
        found = []
        seen = np.bincount(pair, minlength=self.has.shape[1])
        for t in np.flatnonzero(self.has @ seen >= self.least).tolist():
            own = self.has[t, pair]
            name, k, _ = self.templates[t]
            found += [(-value, -common, name, k, a, b + 2) for value, common, a, b in self.stretches(t, at[own], pair[own])]
        taken, out = [], []
        for value, _, name, k, a, b in sorted(found):
            i = bisect_left(taken, (a, b))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                insort(taken, (a, b))
                out.append((name, k, a, b, -value))
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(name, template, start, end, coefficient) of the matches in code points, in the order of the text."""
        found = self.matches(words(text))
        if not found:
            return []
        place = [m.span() for m in _PLACE.finditer(text)]
        return sorted(((name, k, place[a][0], place[b - 1][1], value) for name, k, a, b, value in found), key=lambda f: f[2])


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, passages, license, dice): one row per input row.

    ``passages`` lists (license, template, start, end, dice) of every match, in code points and in order; matches do not overlap; ``licenses`` the
    distinct names, sorted; ``license`` and ``dice`` the best match (ties by name), null without one. Null and empty texts match nothing; texts may be of any length and layout. Repeated and null ids keep their rows. Works
    row by row, without a shuffle; the templates are a parameter and go to the tasks with the code.
    """
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)
    item = "struct<license:string,template:int,start:int,end:int,dice:double>"
    kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))
    keys = ("license", "template", "start", "end", "dice")

    def run(batches):
        for batch in batches:
            found = [[dict(zip(keys, f)) for f in matcher.scan(t.as_py() or "")] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, passages array<{item}>")
    ranked = F.array_sort(F.transform("passages", lambda p: F.struct((-p["dice"]).alias("least"), p["license"].alias("license"))))
    best = F.get(ranked, 0)
    return rows.select("id", F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["license"]))).alias("licenses"), "passages", best["license"].alias("license"), (-best["least"]).alias("dice"))
