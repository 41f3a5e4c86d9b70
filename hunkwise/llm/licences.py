"""Licence scans: Dice coefficient over word bigrams, candidates pruned by size.

A text is cut into units: the whole text, its paragraphs of several lines, and its lines.  A paragraph
ends where a line has no letter or digit, so a notice wrapped over lines is one, whatever comment marks
stand before them.  A unit is normalised (lower case, every run of other characters than letters and
digits one space) and its bag of word bigrams is compared to each template's.  Dice is 2 * common / (unit's + template's), so a template of t bigrams
can reach the threshold d only with units of t*d/(2-d) to t*(2-d)/d bigrams: a unit outside every
template's bounds is dropped before its bigrams are made, and a (unit, template) pair outside the
template's bounds is dropped in the join.  Within its bounds a unit of n bigrams needs n*d/(2-d) of
them in common, so its first n - n*d/(2-d) + 1 must hold one that some template has; a unit without
one is dropped too.  The join itself is on bigrams, an inverted index of the templates.

Only DataFrame functions are used.  The templates are a fixed list; their table's size does not
depend on the input.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Short notices by which works declare a public licence, with its SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is licensed under CC0 1.0 Universal."),
    ("MIT", "Licensed under the MIT License."),
    # Paragraphs of notices that stand at the head of files.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # Whole texts of short licences, without the copyright line.
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
]
# The Creative Commons licences in short and long wording.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _code, _name in _CC.items():
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        TEMPLATES += [(f"CC-{_code}-{_version}", t) for t in (
            f"Licensed under CC {_code} {_version}.", f"This work is licensed under CC {_code} {_version}.", f"This work is licensed under a Creative Commons {_name} {_version} {_port} License.", f"Licensed under the Creative Commons {_name} {_version} {_port} License.",
        ) if (f"CC-{_code}-{_version}", t) not in TEMPLATES]
DICE = 0.8


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(w: Column) -> Column:
    """The bigrams of a unit's words in order, as "a b"; under two words, none."""
    return F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, licence, n_template, bigram, n_bigram), a row for each different bigram of each template."""
    rows = [(k, name, text) for k, (name, text) in enumerate(templates)]
    t = spark.createDataFrame(rows, "template int, licence string, body string")
    t = t.withColumn("bag", bigrams(F.split(normalised(F.col("body")), " ")))
    t = t.select("template", "licence", F.size("bag").alias("n_template"), F.explode("bag").alias("bigram"))
    return t.groupBy("template", "licence", "n_template", "bigram").agg(F.count("*").alias("n_bigram"))


def bounds(n: Column, dice: float) -> tuple[Column, Column]:
    """The sizes between which a unit can reach the threshold with a template of n bigrams."""
    return n * dice / (2 - dice), n * (2 - dice) / dice


def _any_bounds(spark: SparkSession, templates, dice: float) -> list[tuple[float, float]]:
    """The templates' bounds, merged where they overlap; one entry a template at most."""
    sizes = template_table(spark, templates).select("n_template", *(x.alias(k) for k, x in zip("ab", bounds(F.col("n_template"), dice)))).distinct()
    out: list[tuple[float, float]] = []
    for _, lo, hi in sizes.orderBy("a").collect():
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _units(text: str, most: int) -> Column:
    """All units of a text, their words split; of the whole text only ``most`` words and what follows as one."""
    # Lines are normalised once; a line without a letter or digit is then empty or a space.
    norm = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    bare = F.btrim(norm, F.lit(" \n"))
    unit = lambda kind, i, w: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("unit"), w.alias("w"))
    whole = F.array(unit("text", F.lit(0), F.split(bare, "[ \n]+", most + 2)))
    lines = F.split(norm, "\n")
    each = F.transform(lines, lambda x, i: unit("line", i, F.split(F.trim(x), " ")))
    blocks = F.split(bare, r"\n ?(?:\n ?)+")
    wrapped = F.filter(F.transform(blocks, lambda x, i: unit("paragraph", i, F.when(F.contains(x, F.lit("\n")), F.split(F.btrim(x, F.lit(" \n")), "[ \n]+")))), lambda u: u["w"].isNotNull())
    several = lambda of, units: F.when(F.size(of) > 1, units).otherwise(F.slice(whole, 1, 0))
    return F.concat(whole, several(blocks, wrapped), several(lines, each))


def licence_matches(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """(row, doc_id, kind, unit, template, licence, common, n_unit, n_template, dice): pairs at the threshold.

    ``row`` numbers the input rows, so equal ids and repeated rows stay apart; ``kind`` is text,
    paragraph or line, and ``unit`` the paragraph's or line's number from 0 (0 for the text).  A text of
    one line is only a text; a text of one paragraph has no paragraphs, and a paragraph of one line is
    only a line.  Null and empty texts have no match, an empty table or an empty list of templates gives
    no row.  A unit may match several templates.  Bigrams are bags: common ones count as often as they
    stand in both.  Texts may be of any length; other columns than doc_id and text are ignored, whatever
    their names.
    """
    t = template_table(docs.sparkSession, templates)
    known = [r[0] for r in t.select("bigram").distinct().collect()]  # of the templates' size
    spans = _any_bounds(docs.sparkSession, templates, dice)
    most = int(max((hi for _, hi in spans), default=0))
    near = lambda n: functools.reduce(Column.__or__, [n.between(lo, hi) for lo, hi in spans], F.lit(False))

    def candidate(w: Column) -> Column:
        # A match has at least n*d/(2-d) of the unit's n bigrams, so any n - that + 1 of them include one.
        n = F.size(w) - 1
        need = F.ceil(n * dice / (2 - dice) - 1e-9)
        has = lambda x: x.isin(known)
        return near(n) & F.exists(bigrams(F.slice(w, 1, (n - need + 2).cast("int"))), has) & (F.size(F.filter(bigrams(w), has)) >= need)

    found = F.filter(_units("text", most), lambda u: candidate(u["w"]))
    units = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(found).alias("u"))
    units = units.select("row", "doc_id", "u.*").withColumn("n_unit", F.size("w") - 1)
    hits = units.select("row", "doc_id", "kind", "unit", "n_unit", F.explode(bigrams(F.col("w"))).alias("bigram")).join(F.broadcast(t), "bigram")
    hits = hits.filter(F.col("n_unit").between(*bounds(F.col("n_template"), dice)))
    keys = ["row", "doc_id", "kind", "unit", "n_unit", "template", "licence", "n_template"]
    each = hits.groupBy(*keys, "bigram", "n_bigram").agg(F.count("*").alias("n")).groupBy(*keys)
    pairs = each.agg(F.sum(F.least("n", "n_bigram")).alias("common"))
    return pairs.withColumn("dice", 2 * F.col("common") / (F.col("n_unit") + F.col("n_template"))).filter(F.col("dice") >= dice)


def licence_scan(docs: DataFrame, templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """(doc_id, kind, unit, licence, dice, common): the best licence of each unit that has one.

    Ties go to the name that comes first.  Documents without a match have no row; the rest as in
    ``licence_matches``.
    """
    m = licence_matches(docs, templates, dice)
    best = F.min(F.struct((-F.col("dice")).alias("less"), F.col("licence"), F.col("common"))).alias("b")
    out = m.groupBy("row", "doc_id", "kind", "unit").agg(best)
    return out.select("doc_id", "kind", "unit", "b.licence", (-F.col("b.less")).alias("dice"), F.col("b.common").cast("long").alias("common"))
