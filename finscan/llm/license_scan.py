"""License scan: Dice coefficient of word bigrams against license templates.

A text is scanned as a whole, line by line, and in windows of as many words as the template has, one
at every tenth of them and one at the end. So a text that is a license is found as well as a notice on
a line of its own, a license wrapped over many lines above a program, and a notice within a long line:
some window is off by at most a twentieth of the template. Text and templates are normalised alike:
lower case, everything but letters and digits to one space. With A and B the sets of word bigrams,

    dice = 2 |A and B| / (|A| + |B|)

and since |A and B| <= min(|A|, |B|), a dice of t needs |A| between |B| t / (2 - t) and
|B| (2 - t) / t. These bounds prune the candidate templates before any bigram is compared.
For the same reason a window can reach t only if its text holds |B| t / (2 - t) of the template's
bigrams; only for such templates are the windows of a text made.

Everything is DataFrame operations on the rows where they are, no shuffle but the final grouping of
matches by document and license. The templates are literals of the plan; their number is a fixed
property of this module (or of the caller's list).

Defined results: null and empty texts match nothing, units of fewer than two words have no bigram
and match nothing; a text has windows for a template only if it has more words; repeated rows of
one id are scanned each and reported together.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finscan.llm.shared import table

THRESHOLD = 0.8
# The licenses' own words.
TEMPLATES = [
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom"
        " the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF"
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
        " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with"
        " this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with"
        " this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General"
        " Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
        " \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO"
        " EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,"
        " PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
        " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must"
        " retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of"
        " conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND"
        " CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
        " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT"
        " LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
        " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,"
        " and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the"
        " above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software,"
        " unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT"
        " WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT"
        " SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission"
        " is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The"
        " origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product"
        " documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3."
        " This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code"
        " form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


# Words too common to tell a license by.
COMMON = frozenset("a an and any as at be by for from in is it no not of on or that the this to was with you".split())


def normal(text: str) -> str:
    return re.sub(r"[^0-9a-z]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[str]:
    words = normal(text).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the threshold with a template of this size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def cue_words(template: list[str], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with the template has one; long words first, common ones last."""
    spare = len(template) - bounds(len(template), threshold)[0] + 1
    picked: list[str] = []
    touched: set[str] = set()
    for word in sorted({w for b in template for w in b.split()}, key=lambda w: (w in COMMON, -len(w), w)):
        if len(touched) >= spare:
            break
        more = {b for b in template if word in b.split()} - touched
        if more:
            picked.append(word)
            touched |= more
    return picked


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    first = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.zip_with(first, rest, lambda a, b: F.concat_ws(" ", a, b)))


def window_step(words: int) -> int:
    """Words from the start of a window to that of the next, for a template of so many words."""
    return max(1, words // 10)


def matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, kind, unit, license, dice) of each unit and template whose dice reaches the threshold.

    kind is text, line or window; unit counts lines from 1, and is the first word (from 1) of a window.
    """
    made = [(name, bigrams(text), len(normal(text).split())) for name, text in (templates or TEMPLATES)]
    fields = lambda name, b, words: (F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b"), F.lit(len(b)).alias("n"), F.lit(bounds(len(b), threshold)[0]).alias("lo"), F.lit(bounds(len(b), threshold)[1]).alias("hi"), F.lit(words).alias("words"), F.lit(window_step(words)).alias("step"))
    known = F.array(*(F.struct(*fields(*t)) for t in made))
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    cues = sorted({w for _, b, _ in made for w in cue_words(b, threshold)})
    near_any = F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, cues)))
    # One-element explodes keep Spark from evaluating what they hold once for each use.
    units = docs.where(near_any).select(F.col(id_col), F.posexplode(F.concat(F.array(text), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<string>")))).alias("unit", "u"))
    units = units.select(id_col, "unit", F.explode(F.array(F.split(_normalised(F.col("u")), " "))).alias("w"))
    fewest = min(max(1, bounds(len(b), threshold)[0]) for _, b, _ in made)
    units = units.where(F.size("w") > fewest).select(id_col, "unit", "w", F.explode(F.array(_bigrams(F.col("w")))).alias("a"))
    ranges = sorted({bounds(len(b), threshold) for _, b, _ in made})
    merged: list[list[int]] = []
    for lo, hi in ranges:
        if merged and lo <= merged[-1][1] + 1:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    m, is_text = F.size("a"), F.col("unit") == 0
    near = is_text
    for lo, hi in merged:
        near = near | m.between(max(1, lo), hi)
    fits = F.filter(known, lambda t: (t["lo"] <= m) & (m <= t["hi"]) | is_text & (F.size("w") > t["words"]) & (F.size(F.array_intersect("a", t["b"])) >= t["lo"]))
    pairs = units.where(near).select(id_col, "unit", F.when(is_text, F.col("w")).alias("whole"), "a", F.inline(fits))
    dice = lambda a: 2.0 * F.size(F.array_intersect(a, "b")) / (F.size(a) + F.col("n"))
    row = lambda kind, unit, score: F.struct(F.lit(kind).alias("kind"), unit.alias("unit"), score.alias("dice"))
    whole = F.when(m.between(F.col("lo"), F.col("hi")), F.array(F.when(is_text, row("text", F.col("unit"), dice("a"))).otherwise(row("line", F.col("unit"), dice("a")))))
    # Windows are judged inside the text's row, which a row for each would carry along; those without a bigram of the template are left out.
    last = F.size("whole") - F.col("words") + 1
    hits = F.filter(F.sequence(F.lit(1), F.size("whole") - 1), lambda i: F.array_contains(F.col("b"), F.concat_ws(" ", F.get("whole", i - 1), F.get("whole", i))))
    from_ = lambda h: (F.ceil(F.greatest(F.lit(0), h + 1 - F.col("words")) / F.col("step")) * F.col("step") + 1).cast("int")
    around = lambda h: F.when(from_(h) <= F.least(h, last), F.sequence(from_(h), F.least(h, last), F.col("step"))).otherwise(F.array().cast("array<int>"))
    starts = F.array_distinct(F.concat(F.flatten(F.transform(hits, around)), F.array(last)))
    window = lambda at: F.get(F.transform(F.array(_bigrams(F.slice("whole", at, F.col("words")))), lambda a: row("window", at, dice(a))), F.lit(0))
    windows = F.when(is_text & (F.size("whole") > F.col("words")), F.transform(starts, window))
    none = F.array().cast("array<struct<kind:string,unit:int,dice:double>>")
    found = F.filter(F.concat(F.coalesce(whole, none), F.coalesce(windows, none)), lambda x: x["dice"] >= threshold - 1e-12)
    return pairs.select(id_col, "license", F.inline(found)).select(id_col, "kind", "unit", "license", "dice")


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, dice, units, windows): the licenses of each document, their best dice, the matching units (text and lines) and windows."""
    hits = matches(docs, templates, id_col=id_col, text_col=text_col, threshold=threshold)
    window = F.col("kind") == "window"
    return hits.groupBy(id_col, "license").agg(F.round(F.max("dice"), 6).alias("dice"), F.count(F.when(~window, 1)).alias("units"), F.count(F.when(window, 1)).alias("windows"))


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses found in every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql(threshold: float) -> str:
    rows = ", ".join(f"({i}, '{name}', '{normal(text)}', {bounds(len(bigrams(text)), threshold)[0]}, {window_step(len(normal(text).split()))})" for i, (name, text) in enumerate(TEMPLATES))
    pairs = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    words = "string_split(trim(regexp_replace(lower({u}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    return f"""
WITH raw(t, license, words, need, step) AS (VALUES {rows}),
templates AS (SELECT t, license, {pairs.format(w="w")} AS b, len(w) AS n_words, need, step FROM (SELECT *, string_split(words, ' ') AS w FROM raw)),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND text <> ''),
units AS (
  SELECT doc_id, 0 AS unit, text AS u FROM lines
  UNION ALL
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS u FROM lines WHERE len(l) > 1),
words AS (SELECT doc_id, unit, {words.format(u="u")} AS w FROM units),
grams AS (SELECT doc_id, unit, w, {pairs.format(w="w")} AS a FROM words),
scored AS (
  SELECT doc_id, 0 AS is_window, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM grams JOIN templates ON len(a) > 0 AND len(a) * (2 - {threshold}) + 1e-6 >= len(b) * {threshold} AND len(a) * {threshold} <= len(b) * (2 - {threshold}) + 1e-6),
held AS (
  SELECT doc_id, w, license, b, n_words, list_distinct(list_append(range(1, len(w) - n_words + 2, step), len(w) - n_words + 1)) AS starts
  FROM grams JOIN templates ON unit = 0 AND len(w) > n_words AND len(list_intersect(a, b)) >= need),
windows AS (SELECT doc_id, license, b, w[s : s + n_words - 1] AS x FROM (SELECT *, unnest(starts) AS s FROM held)),
window_grams AS (SELECT doc_id, license, b, {pairs.format(w="x")} AS a FROM windows),
everything AS (
  SELECT * FROM scored
  UNION ALL
  SELECT doc_id, 1, license, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) FROM window_grams)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) FILTER (is_window = 0) AS units, count(*) FILTER (is_window = 1) AS windows
FROM everything WHERE dice >= {threshold} - 1e-12
GROUP BY 1, 2
"""


OP7_SQL = _sql(THRESHOLD)
