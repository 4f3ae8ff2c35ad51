"""License scans: normalised text compared to templates by Dice over word bigrams.

A template of b distinct bigrams and a text of a distinct bigrams have a Dice coefficient
2 * shared / (a + b), which can't reach the threshold t unless a lies between
b * t / (2 - t) and b * (2 - t) / t, nor unless they share b * t / (2 - t).

Compared are lines, texts as a whole, and, for each template, windows of as many words as
it has, an eighth of that apart: so a notice or licence is found wherever it stands, be it
wrapped, commented or within a longer line. Bounds come first: units whose size suits no
template are dropped, then those with too few of all templates' bigrams; windows are made
only for templates of whose bigrams the text has enough. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

# Licence notices and texts in common use, and the id of the licence each is for.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
]

#: Dice of at least this, in hundredths.
THRESHOLD = 80
#: Windows begin this share of a template's words apart.
STEP = 8
# Fixed value: what stands between words.
GAP = r"[^\p{L}\p{N}]+"


def pairs(words):
    """The pairs of neighbouring words, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(words):
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(pairs(words))


def split_words(column):
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(column), GAP), lambda w: w != "")


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """(template, license, bg, b, n): a few rows, one for each template; n is its number of words."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    got = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", split_words(F.col("text")).alias("w"))
    return got.select("template", "license", bigrams(F.col("w")).alias("bg"), F.size("w").alias("n")).withColumn("b", F.size("bg")).where("b > 0")


def scan_licenses(df: DataFrame, threshold: int = THRESHOLD, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_matches (matching units), best_dice (in 1/10000, rounded down), licenses (sorted, joined by commas), n_passages, passages.

    Units are a text's lines, and the text as a whole if it has several lines. A unit
    matches a template if 100 * 2 * shared >= threshold * (a + b), for a and b distinct
    bigrams. A null or empty text, or one without a match, has 0 matches, best_dice 0 and
    an empty string. A unit that matches several templates counts once; equal Dice values
    name all their licences.

    Passages are windows of a template's number of words n, beginning at each multiple of
    max(1, n // STEP) and at n words before the text's end. For each template that has a
    matching one, ``passages`` names the best, of equal ones the first, as
    license:start:end:dice in words, end exclusive, by start, end, license.

    Repeated rows are kept apart; null ids stay; further columns are ignored; an empty table
    gives an empty result.
    """
    ts = template_table(df.sparkSession, templates).orderBy("template").collect()
    if not ts:
        raise ValueError("no template has two words")
    # the templates are literals of fixed size
    array = lambda values: F.array(*[F.lit(x) for x in values])
    known = sorted({x for t in ts for x in t["bg"]})
    forms = F.array(*[F.struct(F.lit(t["license"]).alias("license"), array(t["bg"]).alias("bg"), F.lit(t["b"]).alias("b"), F.lit(t["n"]).alias("n"), F.lit(max(1, t["n"] // STEP)).alias("step")) for t in ts])
    low, high = threshold, 200 - threshold
    smallest, largest = min(t["b"] for t in ts), max(t["b"] for t in ts)
    least, most = -(-smallest * low // high), largest * high // low

    def dice(a, shared, b):
        """Dice in 1/10000, 0 below the threshold."""
        ok = (a * high >= b * low) & (a * low <= b * high) & (200 * shared >= low * (a + b))
        return F.when(ok, F.floor(20000 * shared / (a + b)).cast("int")).otherwise(0)

    src = id_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # the words once; of all pairs those that any template has, by a look-up in a set made once
    src = src.select("doc_id", "text", split_words(F.col("text")).alias("whole")).withColumn("pairs", pairs(F.col("whole")))
    src = src.withColumn("seen", F.array_distinct(F.filter("pairs", lambda x: x.isin(known))))
    # what a unit or window shares is among what the text has: no other template can match, and most texts are done here
    none = F.filter(forms, lambda t: F.lit(False))
    asked = F.filter(forms, lambda t: F.size(F.array_intersect(t["bg"], F.col("seen"))) * high >= t["b"] * low)
    src = src.withColumn("asked", F.when(F.size("seen") >= least, asked).otherwise(none))
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), split_words)
    src = src.withColumn("lines", F.when(F.size("asked") > 0, lines).otherwise(F.array().cast("array<array<string>>")))
    # a whole text is a unit of its own only if there are lines to tell it from
    units = F.when(F.size("lines") > 1, F.concat("lines", F.array("whole"))).otherwise(F.col("lines"))
    # size bounds: a unit has fewer distinct bigrams than words
    sized = F.filter(F.transform(F.filter(units, lambda u: F.size(u) > least), bigrams), lambda g: F.size(g).between(least, most))
    met = F.filter(F.transform(sized, lambda g: F.struct(F.size(g).alias("a"), F.filter(g, lambda x: x.isin(known)).alias("g"))), lambda u: F.size(u["g"]) >= least)
    src = src.select("doc_id", "whole", "pairs", "asked", met.alias("met"))

    def unit(u):
        each = F.transform(F.col("asked"), lambda t: F.struct(dice(u["a"], F.size(F.array_intersect(u["g"], t["bg"])), t["b"]).alias("d"), t["license"].alias("license")))
        return F.filter(each, lambda x: x["d"] > 0)

    def window(t):
        last = F.greatest(F.size("whole") - t["n"], F.lit(0))
        starts = F.array_union(F.sequence(F.lit(0), last, t["step"]), F.array(last))

        def score(k):
            g = F.array_distinct(F.slice("pairs", k + 1, t["n"] - 1))
            # the larger Dice first, then the smaller start
            return F.struct(dice(F.size(g), F.size(F.array_intersect(g, t["bg"])), t["b"]).alias("d"), F.negative(k).alias("back"))

        best = F.array_max(F.transform(starts, score))
        return F.struct(F.negative(best["back"]).alias("start"), F.least(t["n"] - best["back"], F.size("whole")).alias("end"), t["license"].alias("license"), best["d"].alias("d"))

    found = src.select("doc_id", F.filter(F.transform("met", unit), lambda m: F.size(m) > 0).alias("m"), F.array_sort(F.filter(F.transform("asked", window), lambda x: x["d"] > 0)).alias("p"))
    every = F.flatten("m")
    named = F.transform("p", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"], x["d"]))
    return found.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform(every, lambda s: s["d"])), F.lit(0)).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda s: s["license"]))), ",").alias("licenses"),
        F.size("p").cast("long").alias("n_passages"), F.array_join(named, ",").alias("passages"),
    )
