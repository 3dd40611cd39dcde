"""License scans: passages compared to licence templates by Dice over word bigrams."""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of

#: Least Dice coefficient.
DICE = 0.8

# Names of public licences with their SPDX identifiers, and their usual notices.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License", "terms of the MIT License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "EPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
GRANTS = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "Distributed under the {}")
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole texts of short licences, without their copyright lines.
TEXTS = {
    "MIT": " ".join((
        *NOTICES["MIT"], _AS_IS, "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    )),
    "ISC": NOTICES["ISC"][0] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{NOTICES['BSD'][0]} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}",
    "BSD-3-Clause": f"{NOTICES['BSD'][0]} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_END}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
    "and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
    "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")
Bigram = tuple[str, str]


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Normalised words with their places: lower case, letters and digits, version numbers in one piece."""
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def _bigrams(words: list[str]) -> list[Bigram]:
    return list(zip(words, words[1:], strict=False))


@lru_cache(maxsize=1)
def templates() -> tuple[list[tuple[str, Counter[Bigram], int]], dict[Bigram, list[int]]]:
    """(SPDX id, bigrams, their number) of every template, and the templates that have a bigram."""
    texts = [(spdx, grant.format(name)) for spdx, names in NAMES.items() for name in names for grant in GRANTS]
    texts += [(spdx, text) for spdx, notices in NOTICES.items() for text in notices] + list(TEXTS.items())
    made = [(spdx, Counter(_bigrams([w for w, _, _ in words_of(text)]))) for spdx, text in texts]
    index: dict[Bigram, list[int]] = {}
    for i, (_, grams) in enumerate(made):
        for g in grams:
            index.setdefault(g, []).append(i)
    return [(spdx, grams, sum(grams.values())) for spdx, grams in made], index


def _shared_least(m: int, least: float) -> int:
    """Bigrams that a window shares with a template of m at least, if their Dice reaches the least."""
    return math.ceil(m * least / (2 - least) - 1e-9)


@lru_cache(maxsize=4)
def anchors(least: float = DICE) -> tuple[str, ...]:
    """Words of which every text with a match has one.

    A match shares so many of a template's bigrams that, if some words touch more than all others
    of them, it shares one of theirs. The words are picked by the bigrams that they touch in most
    templates; words of up to three letters only where the longer ones of a template are too few.
    A template that no words of its own cover raises ValueError.
    """
    chosen: list[str] = []
    open_ = [(grams, m - _shared_least(m, least)) for _, grams, m in templates()[0]]  # bigrams that may be missing
    shortest = 4
    while open_:
        touched: Counter[str] = Counter()
        for grams, spare in open_:
            mine: Counter[str] = Counter()
            for g, n in grams.items():
                if not set(g) & set(chosen):
                    mine.update(dict.fromkeys((w for w in set(g) if len(w) >= shortest and w.isascii()), n))
            for w, n in mine.items():
                touched[w] += min(n, spare + 1)
        if touched:
            chosen.append(max(touched, key=lambda w: (touched[w], len(w), w)))
            open_ = [(g, s) for g, s in open_ if sum(n for x, n in g.items() if set(x) & set(chosen)) <= s]
        elif shortest > 1:
            shortest = 1
        else:
            raise ValueError("a template has no words that every match must share")
    return tuple(chosen)


def anchor_pattern(least: float = DICE) -> str:
    """A pattern that lower-cased texts with a match have: any anchor that stands as a word of its own."""
    return "(?<![a-z0-9])(" + "|".join(map(re.escape, anchors(least))) + ")(?![a-z0-9])"


def dice(a: Counter[Bigram], b: Counter[Bigram]) -> float:
    return 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1)


def _windows(grams: list[Bigram], hits: list[int], want: Counter[Bigram], m: int, least: float) -> Iterator[tuple[float, int, int]]:
    """(Dice, start, end) of the windows from a hit to a hit whose Dice with a template reaches the least.

    hits: the places of the template's m bigrams, in order. A window of n bigrams shares at most
    n of them, so n is within m t / (2 - t) and m (2 - t) / t, and as many are shared as the first
    of the two says. Words that are no part of the template only count in n.
    """
    shared_least, longest = _shared_least(m, least), math.floor(m * (2 - least) / least + 1e-9)
    have: dict[Bigram, int] = {}  # of the longest window from each start, and how many of them the template has
    most = upto = 0
    for i in range(len(hits) - shared_least + 1):
        start = hits[i]
        if i:
            g = grams[hits[i - 1]]
            have[g] -= 1
            most -= have[g] < want[g]
        while upto < len(hits) and hits[upto] - start < longest:
            g = grams[hits[upto]]
            most += have.get(g, 0) < want[g]
            have[g] = have.get(g, 0) + 1
            upto += 1
        if most < shared_least:
            continue
        left, shared = dict(want), 0
        for j in range(i, len(hits)):
            n = hits[j] + 1 - start
            if n > longest:
                break
            g = grams[hits[j]]
            if left[g]:
                left[g] -= 1
                shared += 1
                if (d := 2 * shared / (n + m)) >= least:
                    yield d, start, hits[j] + 1


def find_licenses(text: str, least: float = DICE) -> list[tuple[int, int, str, float]]:
    """(start, end, SPDX id, Dice) of the passages of a text that match a template, in order.

    Every window of the text whose Dice with a template reaches the least counts, however long the
    words are that stand between the template's own. Only windows from a bigram of the template
    to one are compared: of others a shorter one has a higher Dice. Overlapping matches: the highest
    Dice stays, then the longest, then the first.
    """
    known, index = templates()
    words = words_of(text)
    grams = _bigrams([w for w, _, _ in words])
    places: dict[int, list[int]] = {}
    for i, g in enumerate(grams):
        for t in index.get(g, ()):
            places.setdefault(t, []).append(i)
    found = []
    for t, hits in places.items():
        spdx, want, m = known[t]
        found += [(-d, a - b, a, b, spdx) for d, a, b in _windows(grams, hits, want, m, least)]
    chosen: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    for d, _, a, b, spdx in sorted(found):
        start, end = words[a][1], words[b][2]
        at = bisect(starts, start)
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or end <= starts[at]):
            starts.insert(at, start)
            chosen.insert(at, (start, end, spdx, round(-d, 6)))
    return chosen


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = DICE) -> DataFrame:
    """(doc_id, licenses) for each row: array of (start, end, license, dice), code points, end exclusive.

    Whole texts are scanned where they are read, without a shuffle; the templates are a fixed table
    in the code. Texts without any of the anchors have no match, and don't go to Python. Null is the
    empty text, which has no licences. Repeated rows are scanned each; other columns are not read; an
    empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "license", "dice")
        for b in batches:
            rows = [[dict(zip(names, x, strict=True)) for x in find_licenses(t, least)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "licenses"])

    some = F.lower(text_of(text_col)).rlike(anchor_pattern(least))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(some, text_of(text_col)).otherwise("").alias("text"))
    out = "doc_id long, licenses array<struct<start: long, end: long, license: string, dice: double>>"
    return map_batches(rows, each, out).withColumnRenamed("doc_id", id_col)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_max(F.transform("licenses", lambda x: F.struct(x["dice"], -x["start"], x["license"])))
    return scan_licenses(read(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        best["license"].alias("license"),
        best["dice"].alias("dice"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"])), ",").alias("spans"),
    )
