"""Operator 5: licence scans by the Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import plain_words, row_key
from marlstone.session import materialise

# Short forms, standard notices and whole texts of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
    # Whole licence texts, without their copyright lines.
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
)


def _bigrams(words: Column) -> Column:
    """A hash of each word pair; the last word alone makes none."""
    return F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def _best_passage(bigrams: Column, template: Column, size: Column, most: Column) -> Column:
    """``dice, n, start`` of the passage nearest to a template, in one walk over a document's bigrams.

    ``seen`` holds the last ``most`` distinct bigrams, latest first, each with its last place. Of a
    passage that starts at such a place and ends here, it tells the number of distinct bigrams (the
    index) and of those in common (counted along). No other passages are needed: any passage has
    the bigrams of one that starts at the last place of its first bigram. A passage over ``most``
    bigrams can't reach the threshold, so the length in words is free. The walk costs ``most`` steps
    a word at most, whatever repeats.
    """
    empty = F.array().cast("array<struct<b:bigint,at:int,both:boolean>>")
    nothing = F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("n"), F.lit(0).alias("start"))
    places = F.transform(bigrams, lambda b, i: F.struct(b.alias("b"), i.alias("at"), F.array_contains(template, b).alias("both")))

    def measured(seen: Column, at: Column) -> Column:
        def add(a: Column, e: Column) -> Column:
            i, common = a["i"] + 1, a["common"] + e["both"].cast("int")
            here = F.struct((2.0 * common / (i + size)).alias("dice"), (e["at"] - at).alias("n"), (-e["at"]).alias("start"))
            return F.struct(i.alias("i"), common.alias("common"), F.when(e["both"], F.greatest(a["best"], here)).otherwise(a["best"]).alias("best"))

        return F.aggregate(seen, F.struct(F.lit(0).alias("i"), F.lit(0).alias("common"), F.struct(F.lit(0.0).alias("dice"), F.lit(0).alias("n"), F.lit(0).alias("start")).alias("best")), add, lambda a: a["best"])

    def step(state: Column, x: Column) -> Column:
        grown = F.slice(F.concat(F.array(x), F.filter(state["seen"], lambda e: e["b"] != x["b"])), F.lit(1), most)
        alive = F.when(x["both"], grown).when(F.exists(state["seen"], lambda e: e["both"]), grown).otherwise(empty)
        return F.struct(alive.alias("seen"), F.when(x["both"], F.greatest(state["best"], measured(grown, x["at"]))).otherwise(state["best"]).alias("best"))

    return F.aggregate(places, F.struct(empty.alias("seen"), nothing.alias("best")), step, lambda s: s["best"])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, min_dice: float = 0.8) -> DataFrame:
    """``doc_id, license, template, dice, first_word, n_words``: the best passage per document and template.

    Text is normalised to words. A passage and a template match if the Dice coefficient of their
    bigram sets reaches ``min_dice`` (d). That bounds sizes: the passage has d/(2-d) to (2-d)/d
    times the template's bigrams and at least d/(2-d) of them in common. So a document goes on
    only with the templates of which it holds that many bigrams, found by one join with all
    template bigrams (a fixed, small table); then its passages within the bound are measured. Ties
    go to the shortest, then the earliest passage; a document may match several templates, and each
    has a row.

    Null and empty texts, and those without a match, have no row. Null ids are kept; repeated
    rows give repeated results; an empty table gives none. A very long text is one array of words in
    its task; its time grows with its length times the templates it may hold.
    """
    spark = df.sparkSession
    ratio = min_dice / (2 - min_dice)
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, tt string")
    table = table.select("t", "license", F.array_distinct(_bigrams(plain_words(F.col("tt")))).alias("tb")).withColumn("size", F.size("tb")).filter("size > 0")
    keyed = df.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("__text"))
    grams = keyed.select("__k1", "__k2", plain_words(F.col("__text")).alias("ws")).filter(F.size("ws") > 1).select("__k1", "__k2", F.explode(F.array_distinct(_bigrams(F.col("ws")))).alias("b"))
    rare = table.select("t", "size", F.explode("tb").alias("b"))
    found = grams.join(F.broadcast(rare), "b").groupBy("__k1", "__k2", "t", "size").agg(F.count("*").alias("common"))
    enough = found.filter(F.col("common") >= F.lit(ratio) * F.col("size") - 1e-9)
    likely = materialise(enough.groupBy("__k1", "__k2").agg(F.array_sort(F.collect_set("t")).alias("ts")))
    # Generators keep what they make from being computed again wherever it is used.
    held = keyed.join(likely, ["__k1", "__k2"]).select("doc_id", "ts", F.explode(F.array(plain_words(F.col("__text")))).alias("ws"))
    held = held.select("doc_id", "ts", F.explode(F.array(_bigrams(F.col("ws")))).alias("bs")).select("doc_id", "bs", F.explode("ts").alias("t"))
    held = held.join(F.broadcast(table), "t")
    best = _best_passage(F.col("bs"), F.col("tb"), F.col("size"), F.floor(F.col("size") / ratio + 1e-9).cast("int"))
    best = held.select("doc_id", "license", "t", F.inline(F.array(best))).filter(F.col("dice") >= min_dice)
    return best.select("doc_id", "license", F.col("t").alias("template"), "dice", (-F.col("start")).cast("long").alias("first_word"), (2 - F.col("n")).cast("long").alias("n_words"))
