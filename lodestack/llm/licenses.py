"""Licence scans: normalised text against licence templates.

Texts and templates are normalised to lower-case words.  A licence is stated where a
stretch of a text as long as the template reaches a Dice coefficient of ``threshold``
with it, over the bags of word bigrams.  Stretches are tried wherever a bigram of the
template occurs, laid so that it falls on its place in the template; lines and
paragraphs play no part, so notices inside long lines and wrapped notices are found.

Two bounds prune before any stretch is looked at.  Dice can reach t only if the smaller
bag has t / (2 - t) of the larger one's size in common with it, so a document must hold
that many of a template's different bigrams (less those that the template repeats); the
templates that a document may hold are settled in its row.  What is left, a few bigrams
with their places, is joined by the length of a stretch, so that work grows with the
length of a text and not with its square.

The templates are a fixed, small table of literals, and no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import cut, small

# The customary notices and whole texts of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("GPL-3.0", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
]


def template_bigrams(text: str) -> list[str]:
    """Word bigrams of a template in order, normalised as the documents are."""
    words = re.findall(r"[^\W_]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, licenses, n_matches, best_license, best_dice for every row of ``docs`` (doc_id, text).

    ``licenses`` are the sorted names of the templates that some stretch matches,
    ``n_matches`` how many templates these are, ``best_dice`` the highest coefficient
    and ``best_license`` its name, the least in a tie; without a match they are empty, 0
    and null.  A stretch ends where the text does.  Null and blank texts, and texts of
    one word, match nothing; repeated rows each have a row; texts of any length are
    looked at whole.  Templates of one word are left out.  Other columns are ignored.
    """
    spark = docs.sparkSession
    known = [(name, b) for name, text in (TEMPLATES if templates is None else templates) if (b := template_bigrams(text))]
    share = threshold / (2 - threshold)
    all_bigrams = sorted({x for _, b in known for x in b})
    openers = sorted({x.split(" ")[0] for x in all_bigrams})

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), _words(F.col("text")).alias("w"))
    bigram = lambda x, i: F.when(x.isin(openers), F.concat(x, F.lit(" "), F.get("w", i + 1)))
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("place"), bigram(x, i).alias("bigram"))), lambda h: h["bigram"].isin(all_bigrams))
    rows = rows.select("doc_id", "row_key", (F.size("w") - 1).alias("n"), (hits if known else F.lit(None).cast("array<struct<place:int,bigram:string>>")).alias("hits"))
    keyed = rows.select("doc_id", "row_key")
    if not known:
        return keyed.select("doc_id", *[c.alias(n) for n, c in _nothing().items()])

    # the templates of which a document holds enough different bigrams
    enough = lambda b: max(1, math.ceil(share * len(b) - 1e-9) - (len(b) - len(set(b))))
    held = F.array_distinct(F.transform("hits", lambda h: h["bigram"]))
    likely = F.array(*[F.when(F.size(F.array_intersect("held", _literals(sorted(set(b))))) >= enough(b), F.lit(t)) for t, (_, b) in enumerate(known)])
    rows = rows.select("row_key", "n", "hits", held.alias("held")).select("row_key", "n", "hits", F.array_compact(likely).alias("likely"))
    # outer, as a filter on an array's size would sink below what computes the array, and compute it again
    rows = rows.select("row_key", "n", F.explode_outer("likely").alias("t"), "hits").where("t is not null")
    rows = rows.select("row_key", "n", "t", F.explode_outer("hits").alias("h")).where("h is not null")
    rows = cut(rows.select("row_key", "n", "t", "h.place", "h.bigram").distinct())

    places = [(t, k, x, Counter(b)[x], len(b)) for t, (_, b) in enumerate(known) for k, x in enumerate(b)]
    table = F.broadcast(_table(spark, places))
    laid = rows.join(table, ["t", "bigram"])
    cell = lambda c: F.floor(c / F.col("length")).cast("long")
    found = laid.select("row_key", "t", "place", "bigram", "times", "length", cell(F.col("place")).alias("cell")).distinct()
    stretches = laid.select("row_key", "t", "n", "length", (F.col("place") - F.col("at")).alias("first")).distinct()
    stretches = stretches.withColumn("cell", F.explode(F.array(cell(F.col("first")), cell(F.col("first")) + 1)))
    inside = stretches.join(found.drop("length"), ["row_key", "t", "cell"]).where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("length")))
    counted = inside.groupBy("row_key", "t", "n", "length", "first", "bigram", "times").agg(F.count("*").alias("here"))
    sums = counted.groupBy("row_key", "t", "n", "length", "first").agg(F.sum(F.least("here", "times")).alias("shared"))
    size = F.least("n", F.col("first") + F.col("length")) - F.greatest(F.col("first"), F.lit(0))
    dice = 2.0 * F.col("shared") / (size + F.col("length"))
    names = _literals([name for name, _ in known])
    matched = sums.withColumn("dice", dice).where(F.col("dice") >= threshold - 1e-9).groupBy("row_key", F.get(names, F.col("t")).alias("name"), "t").agg(F.max("dice").alias("dice"))
    best = F.min(F.struct((-F.col("dice")).alias("rank"), "name"))
    result = matched.groupBy("row_key").agg(F.sort_array(F.collect_set("name")).alias("licenses"), F.count("*").alias("n_matches"), best.alias("best"))
    joined = keyed.join(small(result), "row_key", "left")
    some = {"licenses": F.col("licenses"), "n_matches": F.col("n_matches"), "best_license": F.col("best.name"), "best_dice": F.round(-F.col("best.rank"), 6)}
    return joined.select("doc_id", *[F.coalesce(some[n], c).alias(n) for n, c in _nothing().items()])


def _nothing() -> dict[str, Column]:
    """What a document without a match has."""
    return {"licenses": _literals([]), "n_matches": F.lit(0).cast("long"), "best_license": F.lit(None).cast("string"), "best_dice": F.lit(None).cast("double")}


def _table(spark, places: list[tuple]) -> DataFrame:
    """(t, at, bigram, times, length): the places of the templates' bigrams, as literals."""
    columns = list(zip(*places, strict=True))
    arrays = F.arrays_zip(*[F.array(*map(F.lit, c)).alias(n) for n, c in zip(("t", "at", "bigram", "times", "length"), columns, strict=True)])
    return spark.range(1).select(F.explode(arrays).alias("x")).select("x.*")
