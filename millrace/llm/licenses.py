r"""License scans: Dice coefficient of word bigrams against templates. DataFrame functions only.

Text is normalised (A-Z lower-cased, everything but a-z and 0-9 is a space) and cut into words; its
passages are runs of bigrams at any position of the whole text, so lines, comment marks and what
stands before or behind a notice don't matter. For a template of m bigrams (b distinct ones), the
passages start at each bigram that the template has, reach over m or 3m/2 bigrams, and end with the
last bigram of these that the template has. A passage of a distinct bigrams, c of them the
template's, has the coefficient 2c / (a + b).

Size bounds: 2c / (a + b) >= t and c <= a give c >= b t / (2 - t). A template with fewer of its
bigrams in the whole text is not compared; nor is a passage with fewer bigrams. Both bounds and the
threshold are compared as whole numbers (t is a ratio of two), so that exact matches of the bound
are kept.

The templates are literals of the plan: no join and no shuffle, one output row for each input row.
`start` and `words` tell where the best passage is. Equal coefficients go to the template first in
the list, then the earliest and the shorter passage. Null or empty text, and text under two words,
match nothing (license null, dice 0). An empty table gives no rows; further columns are ignored.
Full texts of long licences are not templates: their notices and titles are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

# Public notices of common licences, as their texts ask for them to be used.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("bsd-2-clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)
THRESHOLD = (4, 5)  # 0.8 as a ratio


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def bigrams_of(text: str) -> list[str]:
    """All bigrams, in order."""
    words = words_of(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def least_common(b: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Bigrams of a template of b distinct ones that a passage needs to reach the threshold."""
    up, down = threshold
    return -(-b * up // (2 * down - up))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, license (null if none), dice, start and words (of the best passage), n_templates that are reached."""
    grams = [bigrams_of(t) for _, t in templates]
    up, down = threshold
    hit = "struct<dice:double,k:int,s:int,w:int>"
    longs = lambda x: F.lit(x).cast("int")

    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")
    known = sorted({g for gram in grams for g in gram})
    docs = docs.select("doc_id", words.alias("w"))
    pair = lambda w: F.zip_with(F.slice(w, longs(1), F.greatest(F.size(w) - 1, longs(0))), F.slice(w, longs(2), F.greatest(F.size(w) - 1, longs(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    docs = docs.select("doc_id", F.when(F.size("w") > 1, pair(F.col("w"))).alias("g"))
    docs = docs.select("doc_id", "g", F.array_distinct(F.filter("g", lambda x: x.isin(known))).alias("met"))

    def best(k: int) -> Column:
        """The best passage for a template, or null."""
        m, own = len(grams[k]), sorted(set(grams[k]))
        b, mine = len(own), F.array(*[F.lit(x) for x in own])
        at = F.filter(F.transform("g", lambda x, i: F.when(x.isin(own), i)), lambda i: i.isNotNull())

        def passage(start: Column, reach: int) -> Column:
            run = F.slice("g", start + 1, longs(reach))
            past = F.array_position(F.transform(F.reverse(run), lambda x: x.isin(own)), F.lit(True)).cast("int")
            size = F.size(run) - past + 1
            # A passage of fewer bigrams than the bound is not compared.
            return F.when(size >= least_common(b, threshold), F.struct(F.slice(run, longs(1), size).alias("run"), start.alias("s"), size.alias("n")))

        def measured(p: Column) -> Column:
            a, c = F.size(F.array_distinct(p["run"])), F.size(F.array_intersect(p["run"], mine))
            return F.when(2 * c * down >= up * (a + b), F.struct((2.0 * c / (a + b)).alias("dice"), longs(-k).alias("k"), (-p["s"]).alias("s"), (-p["n"]).alias("w")))

        passages = F.flatten(F.transform(at, lambda s: F.array(passage(s, m), passage(s, 3 * m // 2))))
        reached = F.filter(F.transform(F.filter(passages, lambda p: p.isNotNull()), measured), lambda x: x.isNotNull())
        enough = F.size(F.array_intersect("met", mine)) >= least_common(b, threshold)
        return F.when(enough, F.array_max(reached).cast(hit))

    every = F.filter(F.array(*[best(k) for k in range(len(templates))]), lambda x: x.isNotNull())
    # A text without enough known bigrams for any template is done with.
    fewest = min(least_common(len(set(g)), threshold) for g in grams)
    found = docs.select("doc_id", F.when(F.size("met") >= fewest, every).alias("hits"))
    found = found.select("doc_id", F.array_max("hits").alias("best"), F.size(F.coalesce("hits", F.array().cast(f"array<{hit}>"))).cast("long").alias("n_templates"))
    names = F.array(*[F.lit(n) for n, _ in templates])
    any_ = lambda c: F.when(F.col("n_templates") > 0, c)
    return found.select("doc_id", any_(F.element_at(names, 1 - F.col("best.k"))).alias("license"), F.coalesce(any_(F.col("best.dice")), F.lit(0.0)).alias("dice"), any_(-F.col("best.s")).alias("start"), any_(1 - F.col("best.w")).alias("words"), "n_templates")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        g = bigrams_of(text)
        rows.append(f"({k}, '{name}', [{', '.join(repr(x) for x in sorted(set(g)))}], {len(set(g))}, {len(g)})")
    return ",\n".join(rows)


# Every passage is compared with its template here, without bounds on sizes.
OP2_SQL = rf"""
WITH t(k, name, grams, b, m) AS (VALUES {_values()}),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w),
p AS MATERIALIZED (SELECT row, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM g),
u AS MATERIALIZED (SELECT k, unnest(grams) AS x FROM t),
h AS MATERIALIZED (SELECT p.row, u.k, p.i, p.x FROM p JOIN u ON p.x = u.x),
r AS (SELECT row, k, i, unnest([m, 3 * m // 2]) AS reach FROM h JOIN t USING (k)),
e AS (SELECT r.row, r.k, r.i, max(h.i) AS j FROM r JOIN h ON r.row = h.row AND r.k = h.k AND h.i >= r.i AND h.i < r.i + r.reach GROUP BY r.row, r.k, r.i, r.reach),
d AS (SELECT DISTINCT * FROM e),
c AS (SELECT d.row, d.k, d.i, d.j, count(DISTINCT h.x) AS c FROM d JOIN h ON h.row = d.row AND h.k = d.k AND h.i BETWEEN d.i AND d.j GROUP BY ALL),
s AS (SELECT c.*, len(list_distinct(list_slice(g.g, c.i, c.j))) AS a FROM c JOIN g USING (row)),
z AS (SELECT s.row, s.k, name, i, j, 2.0::DOUBLE * c / (a + b) AS dice FROM s JOIN t USING (k) WHERE 2 * c * {THRESHOLD[1]} >= {THRESHOLD[0]} * (a + b)),
o AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY dice DESC, k, i, j) AS n, count(DISTINCT k) OVER (PARTITION BY row) AS n_templates FROM z)
SELECT g.doc_id, o.name AS license, coalesce(o.dice, 0.0::DOUBLE) AS dice, (o.i - 1)::INT AS start, (o.j - o.i + 2)::INT AS words, coalesce(o.n_templates, 0) AS n_templates FROM g LEFT JOIN o ON g.row = o.row AND o.n = 1
"""
