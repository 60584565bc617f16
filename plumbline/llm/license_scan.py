"""License scans by patience alignment.

A template's words are aligned with a window of the text: words that occur once in both are anchors, the longest
increasing run of anchors stays, and the gaps between them are aligned in the same way, after taking equal words at
either end of a gap. Coverage is the share of the template's words that the densest stretch of the alignment holds.

Windows lie around triggers: so many of a template's words, the longest first, that a stretch without any of them cannot
reach the least coverage. No text that would match is left out by them. Where a window holds a trigger more often than
the template, the stretches that put this trigger in its place in the template are aligned as well, so that copies of a
notice in a row are each found.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common
from plumbline.llm.tokens import in_slices
from plumbline.llm.words import words_of

#: Public wordings; a caller may pass others.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    # whole texts and standard notices, without the lines that name a holder
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
MIN_COVER = 0.9
#: A stretch may be this many times as long as its template.
MAX_STRETCH = 1.5

_MARKS = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def bare(word: str) -> str:
    """A word in lower case without marks at either end."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing run, by piles of patience."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (in text, in template), ascending in both."""
    out: list[tuple[int, int]] = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if in_text[w] == 1 and w in place]
        kept = [anchors[k] for k in increasing([t for _, t in anchors])]
        if kept:
            out += kept
            ends = [(a - 1, c - 1), *kept, (b, d)]
            open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def densest(matched: list[tuple[int, int]], size: int, stretch: float = MAX_STRETCH) -> tuple[int, int, int]:
    """(words matched, start, end) of the stretch of at most `stretch` times the template that holds most matches.

    Matches at its ends that lie apart are left out: those that number less than half of the text's words, beyond the
    template's own, between them and the rest. They are words of what stands beside the notice.
    """
    best, low = (0, 0, 0), 0
    for high, (i, _) in enumerate(matched):
        while i - matched[low][0] + 1 > stretch * size:
            low += 1
        if high - low + 1 > best[0]:
            best = (high - low + 1, low, high + 1)
    some = matched[best[1] : best[2]]
    top, worth, since, kept = 0.0, 0.0, 0, (0, 0)
    for k, (i, j) in enumerate(some):  # the run of most matches less half of the words between them
        worth -= 0.5 * max(0, (i - some[k - 1][0]) - (j - some[k - 1][1])) if k else 0.0
        if worth < 0:
            worth, since = 0.0, k
        worth += 1
        if worth > top:
            top, kept = worth, (since, k + 1)
    a, b = kept
    return (b - a, some[a][0], some[b - 1][0] + 1) if b > a else (0, 0, 0)


class Scanner:
    def __init__(self, templates: dict[str, str], min_cover: float = MIN_COVER):
        self.min_cover = min_cover
        self.templates = {name: words for name, t in sorted(templates.items()) if (words := [w for x in t.split() if (w := bare(x))])}
        self.triggers: dict[str, list[str]] = {}
        for name, words in self.templates.items():
            spare = len(words) - int(np.ceil(min_cover * len(words) - 1e-9))  # words that a match may lack
            for w in sorted(set(words), key=lambda w: (-len(w), w)):
                self.triggers.setdefault(w, []).append(name)
                spare -= words.count(w)
                if spare < 0:
                    break

    def scan(self, words: list[str]) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of matches in a text's bare words; of those that overlap, the one with most
        words in common stays, of these the best covered, then the first."""
        found: set[tuple] = set()
        for at, w in enumerate(words):
            for name in self.triggers.get(w, ()):
                template = self.templates[name]
                reach = int(MAX_STRETCH * len(template))
                a = max(0, at - reach)
                windows = [(a, at + reach + 1)]
                if words[a : at + reach + 1].count(w) > template.count(w):  # copies nearby: no word is unique among them
                    for place in (i for i, x in enumerate(template) if x == w):
                        windows += [(max(0, at - place), at - place + len(template)), (max(0, at - place), at + reach + 1), (a, at - place + len(template))]
                for low, high in windows:
                    n, start, end = densest(align(words[low:high], template), len(template))
                    if n >= self.min_cover * len(template) - 1e-9:
                        found.add((-n, -n / len(template), low + start, low + end, name))
        taken: list[tuple[int, int, str, float]] = []  # by start; none overlaps another, so its neighbours alone matter
        for _, cover, start, end, name in sorted(found):
            i = bisect_left(taken, (start,))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, name, -cover))
        return [(name, start, end, cover) for start, end, name, cover in taken]


def find(docs: DataFrame, templates: dict[str, str] | None = None, min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id and matches: array of (name, start, end, coverage) over the whole text's words, one row a document.

    Places count words (those between ASCII white space) from 0, marks alone among them. Null and empty texts have no matches; repeated
    rows and null ids are scanned each by itself; very long texts are scanned whole, and all copies of a notice are
    matches; columns other than doc_id and text are ignored; an empty table gives none.
    """
    scanner = Scanner(templates or TEMPLATES, min_cover)
    triggers = pa.array(sorted(scanner.triggers))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in in_slices(batch.column(1)):
                words = words_of(batch.column(1)[a:b])
                plain = pc.utf8_lower(pc.replace_substring_regex(words.distinct, _MARKS, ""))
                hit = pc.is_in(plain, triggers).to_numpy(zero_copy_only=False)
                some = np.unique(words.of_text[hit[words.codes]])
                out: list[list] = [[] for _ in range(b - a)]
                if len(some):
                    names = plain.to_pylist()
                    for t in some.tolist():
                        out[t] = scanner.scan([names[c] for c in words.codes[words.offsets[t] : words.offsets[t + 1]].tolist()])
                kind = pa.list_(pa.struct([("name", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
                found = pa.array([[dict(zip(("name", "start", "end", "coverage"), m, strict=True)) for m in x] for x in out], kind)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], found], ["doc_id", "matches"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.lean(rows), "doc_id long, matches array<struct<name:string,start:bigint,end:bigint,coverage:double>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["name"], m["start"], m["end"])), ",")
    found = find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), told.alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))
