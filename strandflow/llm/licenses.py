"""License scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

Everything but ASCII letters and digits becomes one space, line breaks included, and letters become small, so wrapped texts and
notices in the middle of a line are found. A template is a notice or a whole licence text. It is compared with windows of as many words as
it has, over distinct word bigrams: Dice = 2 common / (window's + template's), a hit from THRESHOLD on.

Windows are anchored: as a hit shares at least t / (2 - t) of a template's bigrams, it shares one of any size - ceil(t / (2 - t) size)
+ 1 of them. Wherever one of these telling bigrams stands in the text, the window is laid so that it stands where the template first has it.
Texts without the more telling word of any telling bigram are dropped before any bigram is made, and windows whose number of bigrams
rules out Dice >= t (less than t / (2 - t) or more than (2 - t) / t times the template's) before they are compared.
Of hits that share words only the best is kept (highest Dice, then the first name, then the first place): a licence's text is not also a hit of
a similar licence. Templates are a constant of this module (or a bounded list of the caller) and part of the plan: no join and no
shuffle.

Defined cases: null and empty texts match nothing (n_hits 0, license and dice null, licenses empty); a notice that occurs repeatedly
counts each time; texts of any length are scanned whole; rows with a null or repeated
doc_id stay rows of their own, as nothing is joined back; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import table
from strandflow.llm.secrets_scan import blocks, let

THRESHOLD = 0.8

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, later: str = "program") -> str:
    return f"""This {later} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {later} is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for
more details."""


TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
        the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a 2-clause BSD license.", f"{_BSD_START} {_BSD_CLAUSES} {_BSD_END}"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        f"{_BSD_START} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_END}",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("", "2")],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", _gnu("", "3")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero", "3")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _gnu("Lesser", "2.1", "library")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser", "3", "library")],
    "ISC": [
        "Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "MIT": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. {_AS_IS}""",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
        an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
    ],
}


#: Words that many texts have; bigrams without them are looked for first.
COMMON = {"a", "all", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "has", "have", "if", "in", "is", "it", "may", "must", "no", "not", "of", "on", "one", "or", "shall", "so", "that", "the", "this", "to", "under", "use", "was", "way", "which", "with", "work", "you"}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def bigrams_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def known(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(name, words) of the templates that have a bigram."""
    return [(name, w) for name in sorted(templates) for t in templates[name] if len(w := words_of(t)) > 1]


def needed(words: list[str], threshold: float) -> dict[str, int]:
    """So many of a template's bigrams that a hit has one of them, the most telling ones, with the place of the first of each."""
    b = bigrams_of(words)
    n = len(b) - math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) + 1
    some = sorted(b, key=lambda x: (sum(w in COMMON for w in x.split(" ")), -len(x), x))[:n]
    pairs = [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
    return {x: pairs.index(x) for x in some}


def telling(bigrams_: list[str]) -> str:
    """A pattern for the more telling word of each bigram, in either case: what has no such word has none of the bigrams."""
    words = sorted({max(b.split(" "), key=lambda w: (w not in COMMON, len(w), w)) for b in bigrams_})
    # by first letter, so that most words of a text are ruled out by that alone
    by = {c: "|".join(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(f'{c}(?:{rest})' for c, rest in by.items())})(?![A-Za-z0-9])"


def bigrams(words: Column) -> Column:
    """The bigrams of a list of words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


HITS = "array<struct<cost:double,license:string,lo:int,hi:int>>"


def _strings(values: list) -> Column:
    """A constant array of strings without a bar, as one literal."""
    return F.split(F.lit("|".join(map(str, values))), r"\|")


def hits_of(words: Column, templates: list[tuple[str, list[str]]], threshold: float) -> Column:
    """HITS of a list of words: the windows that match, words lo to hi (hi exclusive), cost = -Dice; several may lie over each other."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    marks: dict[str, list[str]] = {}
    for k, (_, w) in enumerate(templates):
        for b, i in needed(w, threshold).items():
            marks.setdefault(b, []).append(f"{k}:{i}")
    # telling bigram: the templates that it tells of, with its place in each
    places = F.map_from_arrays(_strings(list(marks)), _strings([",".join(x) for x in marks.values()]))
    names, lengths = _strings([n for n, _ in templates]), _strings([len(w) for _, w in templates]).cast("array<int>")
    sizes = _strings([len(bigrams_of(w)) for _, w in templates]).cast("array<int>")
    own = F.split(F.lit("\n".join("|".join(bigrams_of(w)) for _, w in templates)), "\n")

    def windows(v: Column) -> Column:
        """v: the words, w, and the anchors, a (place i, bigram b)."""

        def laid(x: Column) -> Column:
            def one(of: Column) -> Column:
                k, o = F.split_part(of, F.lit(":"), F.lit(1)).cast("int"), F.split_part(of, F.lit(":"), F.lit(2)).cast("int")
                lo = x["i"] - o
                return F.struct(k.alias("k"), F.greatest(lo, F.lit(0)).alias("lo"), F.least(lo + lengths[k], F.size(v["w"])).alias("hi"))

            return F.transform(F.split(F.element_at(places, x["b"]), ","), one)

        def judged(x: Column) -> Column:
            def scored(b: Column) -> Column:
                n, m = F.size(b), sizes[x["k"]]
                fits = (n >= low * m - 1e-9) & (n <= high * m + 1e-9)
                dice = F.lit(2.0) * F.size(F.array_intersect(b, F.split(own[x["k"]], r"\|"))) / (n + m)
                return F.struct((-F.when(fits, dice).otherwise(0.0)).alias("cost"), names[x["k"]].alias("license"), x["lo"].alias("lo"), x["hi"].alias("hi"))

            return let(F.array_distinct(bigrams(F.slice(v["w"], x["lo"] + 1, x["hi"] - x["lo"]))), scored)

        places_ = F.array_distinct(F.flatten(F.transform(v["a"], laid)))
        return F.array_distinct(F.filter(F.transform(places_, judged), lambda h: h["cost"] <= -threshold).cast(HITS))

    pairs = F.transform(bigrams(words), lambda b, i: F.struct(i.alias("i"), b.alias("b")))
    anchors = F.filter(pairs, lambda x: x["b"].isin(*marks))
    return let(F.struct(words.alias("w"), anchors.alias("a")), windows)


def best_of(hits: Column, longest: int) -> Column:
    """The hits that no better one shares a word with. Each block of them is compared with what lies along it."""

    def better(g: Column, h: Column) -> Column:
        key = lambda x: F.struct(x["cost"], x["license"], x["lo"])
        return (g["lo"] < h["hi"]) & (h["lo"] < g["hi"]) & (key(g) < key(h))

    def kept(every: Column) -> Column:
        def of(block: Column) -> Column:
            near = F.filter(every, lambda g: (g["lo"] < F.element_at(block, -1)["lo"] + longest) & (g["hi"] > block[0]["lo"]))
            return let(near, lambda n: F.filter(block, lambda h: ~F.exists(n, lambda g: better(g, h))))

        return F.flatten(F.transform(blocks(every), of))

    return let(F.array_sort(hits, lambda a, b: F.when(a["lo"] < b["lo"], -1).when(a["lo"] > b["lo"], 1).otherwise(0)), kept)


def license_hits(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (of the best hit), dice (to 6 places), n_hits, licenses (their names, sorted, joined)."""
    all_ = known(templates)
    pattern = telling(sorted({b for _, w in all_ for b in needed(w, threshold)}))
    plain = F.lower(F.trim(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")))
    found = let(F.split(plain, " "), lambda w: best_of(hits_of(w, all_, threshold), max(len(w) for _, w in all_)))
    d = docs.select("doc_id", F.when(F.coalesce(F.col("text").rlike(pattern), F.lit(False)), found).otherwise(F.array().cast(HITS)).alias("h"))
    top = F.array_min("h")
    return d.select(
        "doc_id",
        top["license"].alias("license"),
        F.round(-top["cost"], 6).alias("dice"),
        F.size("h").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("h", lambda h: h["license"]))), ",").alias("licenses"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_hits(table(spark, sf_dir, "documents"))


def _values() -> str:
    def strings(x: list[str]) -> str:
        return f"[{', '.join(chr(39) + v + chr(39) for v in x)}]"

    rows = []
    for k, (name, w) in enumerate(known(TEMPLATES)):
        at = needed(w, THRESHOLD)
        rows.append(f"({k}, '{name}', {len(w)}, {strings(bigrams_of(w))}, {strings(list(at))}, [{', '.join(map(str, at.values()))}])")
    return ", ".join(rows)


SQL = f"""
WITH t(k, license, m, tb, nb, no) AS (VALUES {_values()}),
n AS (SELECT k, m, unnest(nb) AS b, unnest(no) AS o FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')), ' '), ' ') AS w FROM documents),
p AS (SELECT r, len(w) AS n, i - 1 AS i, w[i] || ' ' || w[i + 1] AS b FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
a AS (SELECT DISTINCT r, k, greatest(i - o, 0) AS lo, least(i - o + m, p.n) AS hi FROM p JOIN n USING (b)),
s AS (SELECT r, k, lo, hi, list_distinct(list_transform(range(lo + 1, hi), lambda j: w[j] || ' ' || w[j + 1])) AS b FROM a JOIN d USING (r)),
c AS (SELECT DISTINCT r, license, lo, hi, -(2.0::DOUBLE * len(list_intersect(b, tb)) / (len(b) + len(tb))) AS cost FROM s JOIN t USING (k)),
h AS (SELECT * FROM c WHERE cost <= -{THRESHOLD}::DOUBLE),
f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.r = h.r AND g.lo < h.hi AND h.lo < g.hi AND (g.cost < h.cost OR (g.cost = h.cost AND (g.license < h.license OR (g.license = h.license AND g.lo < h.lo)))))),
q AS (SELECT r, arg_min(license, (cost, license)) AS license, round(-min(cost), 6) AS dice, count(*) AS n_hits, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM f GROUP BY r)
SELECT doc_id, license, dice, coalesce(n_hits, 0) AS n_hits, coalesce(licenses, '') AS licenses FROM d LEFT JOIN q USING (r)"""
