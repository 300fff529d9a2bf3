"""Licence scans: texts compared with licence templates by the Dice coefficient of their sets of word bigrams.

A text's units are its lines, its paragraphs of two lines or more (between blank lines), and the whole text. A unit
with a bigrams reaches a coefficient t with a template of b bigrams only if b lies between a t / (2 - t) and
a (2 - t) / t, so only templates in these bounds are compared; an index from bigrams to templates counts what is shared.

Licences that are no unit (a notice in a longer line, a licence of some paragraphs in a longer text) are found as spans:
of all runs of words that reach the threshold with a template, regardless of lines and paragraphs, the best (highest
coefficient, then shortest, then first), then the best of those without a bigram in common with it, and so on. A span isn't
reported inside a unit that matches the same template, nor inside a match of a larger template that has the span's hits, too
(the header of the Apache License begins with the words of its notice).

Words are runs of letters and digits, lower-cased. A one-word unit or template has its word as its only bigram; a
template of one word is sought in units only. ``TEMPLATES`` holds notices, short licences and the headers of long ones; whole
licences and others are given as a table, see ``read_templates``.

Defined cases: null and empty texts, and units without words, match nothing; templates without words are ignored;
of templates that reach the threshold in a unit all are reported; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.9
_WORDS = re.compile(r"[^\W_]+")

#: Public licence notices and short licences.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General "
        "Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS "
        "AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
        "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
        "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the "
        "names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
        "copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
}
#: Characters of templates that are read from a table, at most: the index of their bigrams is held by every worker.
MAX_TEMPLATE_CHARS = 20_000_000


def read_templates(table: DataFrame) -> dict[str, str]:
    """Templates of a table (license, text), for ``find_licenses``; null texts and names are ignored."""
    known = table.where("license IS NOT NULL AND text IS NOT NULL").select("license", "text")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MAX_TEMPLATE_CHARS:
        raise ValueError(f"templates of {size} characters; at most {MAX_TEMPLATE_CHARS} are held")
    return {r["license"]: r["text"] for r in known.collect()}


def bigrams(text: str) -> set:
    words = _WORDS.findall(text.lower())
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w,) for w in words}


class Index:
    def __init__(self, templates: dict[str, str], threshold: float):
        sets = sorted(((len(s), name, s) for name, text in templates.items() if (s := bigrams(text))), key=lambda x: x[:2])
        self.threshold = threshold
        self.sizes = [size for size, _, _ in sets]
        self.names = [name for _, name, _ in sets]
        self.sets = [s for _, _, s in sets]
        self.of: dict = {}
        for i, (_, _, s) in enumerate(sets):
            for b in s:
                self.of.setdefault(b, []).append(i)

    def matches(self, unit: set) -> list[tuple[str, float]]:
        """(template, coefficient) of every template that reaches the threshold."""
        a, t = len(unit), self.threshold
        low = bisect_left(self.sizes, a * t / (2 - t) - 1e-9)
        high = bisect_right(self.sizes, a * (2 - t) / t + 1e-9)
        if not a or low >= high:
            return []
        shared = [0] * (high - low)
        for b in unit & self.of.keys() if a > len(self.of) else filter(self.of.__contains__, unit):
            for i in self.of[b]:
                if low <= i < high:
                    shared[i - low] += 1
        dice = ((self.names[low + i], 2 * n / (a + self.sizes[low + i])) for i, n in enumerate(shared) if n)
        return [(name, d) for name, d in dice if d >= t]

    def present(self, whole: set) -> list[int]:
        """Templates of which a text with these bigrams has enough for a span to reach the threshold, the largest first."""
        shared: dict[int, int] = {}
        for b in whole & self.of.keys():
            for i in self.of[b]:
                shared[i] = shared.get(i, 0) + 1
        return sorted((i for i, n in shared.items() if n >= self.sizes[i] * self.threshold / (2 - self.threshold) - 1e-9 and len(next(iter(self.sets[i]))) > 1), reverse=True)

    def spans(self, run: list[tuple], i: int) -> list[tuple[int, int, float]]:
        """(first, last, coefficient) of the best disjoint spans of template i in a text's bigrams in order.

        The best begin and end with a bigram of the template that they hold once, as without it they would be as good and
        shorter. So a search ends where its first bigram comes again: at most one pass over the text for each bigram.
        """
        wanted, size, t = self.sets[i], self.sizes[i], self.threshold
        most = size * (2 - t) / t + 1e-9
        found = []
        for first in [k for k, b in enumerate(run) if b in wanted]:
            seen, shared = {run[first]}, 1
            last = first
            while True:
                if last == first or fresh and hit:
                    dice = 2 * shared / (len(seen) + size)
                    if dice >= t:
                        found.append((-dice, last - first, first))
                last += 1
                if last == len(run) or run[last] == run[first]:
                    break
                fresh, hit = run[last] not in seen, run[last] in wanted
                if fresh:
                    seen.add(run[last])
                    shared += hit
                    if len(seen) > most:
                        break
        taken: list[tuple[int, int, float]] = []
        for minus, length, first in sorted(found):
            k = bisect_left(taken, (first,))
            if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > first + length):
                taken.insert(k, (first, first + length, -minus))
        return taken


def units(text: str):
    """(first line, last line, text) of the lines, the paragraphs and the whole."""
    lines = text.split("\n")
    begin = None
    for i, line in enumerate([*lines, ""]):
        blank = not line.strip()
        if not blank:
            yield i, i, line
            begin = i if begin is None else begin
        elif begin is not None:
            if i - begin > 1 and i - begin < len(lines):
                yield begin, i - 1, "\n".join(lines[begin:i])
            begin = None
    if len(lines) > 1:
        yield 0, len(lines) - 1, text


def matches_of(index: Index, text: str) -> list[tuple[str, float, int, int]]:
    """(template, coefficient, first line, last line) of the units that match, then of the spans beyond them."""
    found, own = [], set()
    for first, last, unit in units(text):
        own = bigrams(unit)
        found += [(name, d, first, last) for name, d in index.matches(own)]
    # The last unit is the whole text.
    present = index.present(own)
    if not present:
        return found
    lowered = text.lower()
    places = [(m.start(), m.group()) for m in _WORDS.finditer(lowered)]
    run = [(a, b) for (_, a), (_, b) in zip(places, places[1:], strict=False)]
    breaks = [k for k, c in enumerate(lowered) if c == "\n"]
    sets = dict(zip(index.names, index.sets, strict=True))
    inside = [(sets[name], first, last) for name, _, first, last in found]
    # Of a template that matches the whole text (or lies in one that does), no span tells more: none is searched for.
    covered = [s for s, low, high in inside if low == 0 and high == len(breaks)]
    wider: list[tuple[set, int, int]] = []
    for i in present:
        if any(index.sets[i] <= s for s in covered):
            continue
        taken = []
        for a, b, d in index.spans(run, i):
            first, last = bisect_left(breaks, places[a][0]), bisect_left(breaks, places[b + 1][0])
            hits = index.sets[i].intersection(run[a : b + 1])
            held = any(low <= first and last <= high and hits <= s and len(s) >= index.sizes[i] for s, low, high in inside)
            held |= any(low <= a and b <= high and hits <= s for s, low, high in wider)
            if not held:
                taken.append((index.sets[i], a, b))
                found.append((index.names[i], d, first, last))
        wider += taken
    return found


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``matches``: license, dice, first_line and last_line (from 0) of every unit and span that matches."""
    index = Index(TEMPLATES if templates is None else templates, threshold)

    @F.arrow_udf("array<struct<license: string, dice: double, first_line: int, last_line: int>>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            rows.append([{"license": name, "dice": d, "first_line": a, "last_line": b} for name, d, a, b in matches_of(index, t.as_py() or "")])
        return pa.array(rows, pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())])))

    return docs.select("doc_id", scan("text").alias("matches"))
