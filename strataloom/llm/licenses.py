"""License scans: lines, blocks, whole texts and spans of words against license templates by the Dice coefficient of word bigrams.

Words are runs of letters and digits, lower-cased. A unit of n bigrams can reach a coefficient d only with templates
of n * d / (2 - d) to n * (2 - d) / d bigrams; units that no template's size allows are never looked at, and for the others
an index from bigram to templates counts what is shared, so only templates with a common bigram are weighed.
Spans run over line ends and within lines, from one shared bigram to another; where too few lie close together, none is weighed.
Long templates (whole licenses, in the folder spdx) aren't in the index: a text is looked at for one only if it is long enough
and shares as many different bigrams as the coefficient needs at least.
"""

from __future__ import annotations

import math
import pathlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

LEAST = 0.8
#: Bigrams from which a template counts as long.
LONG = 400
_WORD = re.compile(r"[^\W_]+")
#: Public notices and license texts by SPDX id; several templates may share one.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)


def all_templates() -> tuple[tuple[str, str], ...]:
    """The notices above and the whole licenses of the folder spdx, read on the driver."""
    folder = pathlib.Path(__file__).resolve().parent / "spdx"
    return TEMPLATES + tuple((p.name[:-4], p.read_text("utf-8")) for p in sorted(folder.glob("*.txt")))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


class Scanner:
    """Templates by size, the index from bigram to (template, count) for short ones, and bounds for long ones."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST):
        self.least = least
        self.grams = [bigrams(words_of(t)) for _, t in templates]
        self.size = [sum(g.values()) for g in self.grams]
        self.name = [n for n, _ in templates]
        self.sizes = sorted(self.size)
        self.need = [max(1, math.ceil(n * least / (2 - least) - 1e-9)) for n in self.size]
        self.long = [i for i, n in enumerate(self.size) if n >= LONG]
        # Shared bigrams are at most the different ones shared and the template's repeats.
        self.different = {i: self.need[i] - (self.size[i] - len(self.grams[i])) for i in self.long}
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for i, g in enumerate(self.grams):
            for b, n in g.items() if i not in self.different else ():
                self.index.setdefault(b, []).append((i, n))

    def possible(self, n: int) -> bool:
        """Whether some template's size allows the coefficient for n bigrams."""
        d = self.least
        return bisect_right(self.sizes, n * (2 - d) / d + 1e-9) > bisect_left(self.sizes, n * d / (2 - d) - 1e-9)

    def weigh(self, words: list[str]) -> list[tuple[int, float]]:
        """(template, coefficient) of all templates at or over the threshold."""
        n = len(words) - 1
        if n < 1 or not self.possible(n):
            return []
        index = self.index
        large = [i for i in self.long if 2 * min(n, self.size[i]) >= self.least * (n + self.size[i])]
        if not large and not any(b in index for b in zip(words, words[1:], strict=False)):
            return []
        own, both = bigrams(words), Counter()
        for b, k in own.items():
            for i, m in index.get(b, ()):
                both[i] += min(k, m)
        for i in large:
            gram = self.grams[i]
            both[i] = sum(min(k, gram[b]) for b, k in own.items() if b in gram)
        return [(i, 2 * c / (n + self.size[i])) for i, c in sorted(both.items()) if 2 * c >= self.least * (n + self.size[i])]

    def _hits(self, words: list[str]) -> dict[int, list[int]]:
        """Places of the bigrams that a template shares, for templates that the text may hold."""
        pairs = list(zip(words, words[1:], strict=False))
        hits: dict[int, list[int]] = {}
        for at, b in enumerate(pairs):
            for i, _ in self.index.get(b, ()):
                hits.setdefault(i, []).append(at)
        large = [i for i in self.long if self.need[i] <= len(pairs)]
        if large:
            seen = set(pairs)
            for i in large:
                gram = self.grams[i]
                if len(seen & gram.keys()) >= self.different[i]:
                    hits[i] = [at for at, b in enumerate(pairs) if b in gram]
        return hits

    def spans(self, words: list[str]) -> list[tuple[int, int, int, int, float]]:
        """(template, first word, last word, shared bigrams, coefficient): for each first shared bigram the span that fits best, where one reaches the threshold."""
        d, out = self.least, []
        for i, h in self._hits(words).items():
            n, gram, need = self.size[i], self.grams[i], self.need[i]
            most = n * (2 - d) / d + 1e-9
            starts = [j for j in range(len(h) - need + 1) if h[j + need - 1] - h[j] + 1 <= most]
            if not starts:
                continue
            # A bigram counts in a span unless as many of its kind as the template has stand before it there.
            place, before, kinds = np.array(h), np.full(len(h), -1), {}
            for t, at in enumerate(h):
                own = kinds.setdefault((words[at], words[at + 1]), [])
                own.append(t)
                times = gram[words[at], words[at + 1]]
                if len(own) > times:
                    before[t] = own[-1 - times]
            for j in starts:
                end = int(np.searchsorted(place, h[j] + most - 1 + 1e-6, "right"))
                size = place[j:end] - h[j] + 1
                counts = before[j:end] < j
                c = np.cumsum(counts)
                dice = np.where(counts & (2 * c >= d * (size + n)), 2 * c / (size + n), 0)
                k = int(dice.argmax())
                if dice[k]:
                    out.append((i, h[j], h[j + k] + 1, int(c[k]), float(dice[k])))
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(license, first line, last line, coefficient) of the lines, the blocks between blank lines and the whole text that match, the best template each.

        Then of the spans of words, those with the most shared bigrams first, that overlap no better match and none of the same license but for a whole license around it."""
        lines = text.split("\n")
        parts = [words_of(x) for x in lines]
        units = [(i, i) for i in range(len(parts))]
        a = 0
        blocks = []
        for i in range(len(parts) + 1):
            if i == len(parts) or not parts[i]:
                if i - a > 1:
                    blocks.append((a, i - 1))
                a = i + 1
        if len(parts) > 1 and (0, len(parts) - 1) not in blocks:
            blocks.append((0, len(parts) - 1))
        total = [0]
        for p in parts:
            total.append(total[-1] + len(p))
        out = []
        for a, b in units + blocks:
            if self.possible(total[b + 1] - total[a] - 1):
                got = self.weigh(parts[a] if a == b else [w for p in parts[a : b + 1] for w in p])
                if got:
                    best = max(got, key=lambda x: (x[1], -x[0]))
                    out.append((self.name[best[0]], a, b, best[1]))
        words = [w for p in parts for w in p]
        taken = [(total[a], total[b + 1] - 1, name, dice) for name, a, b, dice in out]
        for i, a, b, _, dice in sorted(self.spans(words), key=lambda x: (-x[3], -x[4], x[0], x[1])):
            name = self.name[i]
            whole = i in self.different  # a whole license may hold its own notice
            if all(b < u or v < a or (name != other and dice > least) or (whole and a <= u and v <= b and least <= 1) for u, v, other, least in taken):
                taken.append((a, b, name, 2.0))  # no other span over this one
                out.append((name, bisect_right(total, a) - 1, bisect_right(total, b) - 1, dice))
        return sorted(out, key=lambda x: (x[1], x[2]))


MATCHES = "doc_id long, matches array<struct<license:string,first_line:int,last_line:int,dice:double>>"
_MATCH = pa.list_(pa.struct([("license", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("dice", pa.float64())]))


def scan_licenses(docs: DataFrame, templates=None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the matches of every row, in text order; null and empty texts match nothing. Equal coefficients go to the first template.

    ``templates`` are (license, text) pairs, ``all_templates()`` if not given. Repeated rows give a row each, an empty table
    an empty one, a text of any length is read whole; other columns aren't read.
    """
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(all_templates() if templates is None else tuple(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(given.value, least)
        for b in batches:
            got = [[dict(zip(("license", "first_line", "last_line", "dice"), m, strict=True)) for m in s.scan(t or "")] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, _MATCH)], names=["doc_id", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MATCHES)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_matches, licenses (distinct names, sorted, joined by commas) and best_dice of every document."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.array_max(F.transform("matches", lambda m: m["dice"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.coalesce(best, F.lit(0.0)).alias("best_dice"))
