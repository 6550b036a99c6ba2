"""License scans in DataFrame operations only: MinHash bands retrieve templates, exact containment decides.

Texts and templates are lower-cased and cut into runs of a-z and 0-9; a shingle is ``WORDS`` words. A
template of S shingles is looked for in windows of S shingles that start at every max(1, S // 5)-th place, so
a passage that holds 0.8 of the template lies in some window by 0.6 of S at least, a Jaccard similarity
of 0.43 or more. ``BANDS`` bands of two MinHash rows make such a window and the template collide in some
band with a probability above 0.9995. Each retrieved pair is then decided by the exact share of the
template's shingles, as words, that stand in the window with one step to either side.

A window that shares no shingle with any template has no MinHash in common with one either, so leaving out documents and
windows without a shared shingle loses nothing that bands could retrieve: shared shingles say where windows are
worth building, and the bands tell which are retrieved (a test measures the recall of the bands alone). The
templates are a stated list of notices and whole texts; up to ``MOST_SHINGLES`` shingles of them go to all tasks,
and each document is tried in place; beyond that the documents' shingles are joined with them. The documents that
remain are written once.

Nulls: null or empty text and texts of fewer than WORDS words match nothing; templates of fewer words are
refused. A null doc_id is kept. Repeated rows are reported each. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORDS, BANDS, ROWS = 5, 40, 2
MOST_SHINGLES = 20_000
#: Common notices by their SPDX names.
TEMPLATES = {
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (header)": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL (header)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT (notice)": "Released under the MIT License.",
    "MIT (grant)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD (grant)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC (grant)": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0 (header)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
#: Whole texts of short licences.
TEMPLATES |= {
    "MIT (text)": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause (text)": _BSD + _AS_IS,
    "BSD-3-Clause (text)": _BSD
    + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
    + _AS_IS,
    "ISC (text)": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "Zlib (text)": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}


def templates(spark: SparkSession) -> DataFrame:
    """template, text"""
    return spark.createDataFrame(sorted(TEMPLATES.items()), "template string, text string")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _shingles(words: Column, of) -> Column:
    """An array of of(words, i) for each place i of a shingle."""
    none = F.array_repeat(of(words, F.lit(0)), 0)
    return F.when(F.size(words) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), lambda i: of(words, i))).otherwise(none)


def _hash(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(WORDS)))


def _spelt(words: Column, i: Column) -> Column:
    return F.array_join(F.slice(words, i + 1, F.lit(WORDS)), " ")


def _bands(hashes: Column) -> Column:
    """One number a band: the hash of its rows' minima."""
    # A row's hash function multiplies by an odd number of its own and mixes.
    least = lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(k))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def find_licenses(docs: DataFrame, templates: DataFrame, containment: float = 0.8) -> DataFrame:
    """doc_id, template, containment double, start long, words long: the places that hold a template's words, by word
    number of the window; of overlapping windows the best, and the first of equals."""
    known = templates.select("template", _words(F.col("text")).alias("w")).where(F.size("w") >= WORDS)
    known = known.select("template", F.array_distinct(_shingles(F.col("w"), _spelt)).alias("spelt"), _shingles(F.col("w"), _hash).alias("h"))
    known = known.withColumn("s", F.size("h")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("s") / 5)).cast("int"))
    known = written(known, "templates")
    count = known.agg(F.sum("s")).first()[0] or 0
    near = F.broadcast if count <= MOST_SHINGLES else (lambda df: df)

    # Documents with a shared shingle.
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    shingle_arrays = _bound(_words(F.col("text")), lambda w: _shingles(w, _hash))
    shared = known.select(F.explode("h").alias("shingle"), "s", "step").distinct()
    if count <= MOST_SHINGLES:
        every = known.agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("every"))
        held = rows.crossJoin(F.broadcast(every)).where(F.arrays_overlap(shingle_arrays, "every")).drop("every")
    else:
        numbered = rows.withColumn("place", F.xxhash64("doc_id", "text"))
        found = numbered.select("place", F.explode(shingle_arrays).alias("shingle")).join(shared, "shingle").select("place").distinct()
        held = numbered.join(found, "place", "left_semi").drop("place")
    held = written(held.select("doc_id", _words(F.col("text")).alias("w")).withColumn("row", F.monotonically_increasing_id()), "licensed")

    # Their windows: places of shared shingles, each with the templates' window sizes that could hold it.
    hashed = held.select("row", F.posexplode(_shingles(F.col("w"), _hash)).alias("at", "shingle"))
    hits = hashed.join(near(shared), "shingle").select("row", "at", "s", "step")
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("s") + 1) / F.col("step")).cast("int"))
    starts = F.transform(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int")), lambda k: k * F.col("step"))
    windows = hits.select("row", "s", "step", F.explode(starts).alias("start")).distinct()
    texts = held.join(windows.groupBy("row").agg(F.collect_list(F.struct("s", "step", "start")).alias("windows")), "row")
    built = texts.select("row", "doc_id", F.explode("windows").alias("x"), "w").select("row", "doc_id", "x.s", "x.step", "x.start", "w")
    inside = F.slice("w", F.col("start") + 1, F.col("s") + WORDS - 1)
    around = F.slice("w", F.greatest(F.lit(1), F.col("start") + 1 - F.col("step")), F.col("s") + WORDS - 1 + 2 * F.col("step"))
    built = built.select("row", "doc_id", "s", "start", _bound(_bound(inside, lambda w: _shingles(w, _hash)), _bands).alias("bands"), _bound(around, lambda w: _shingles(w, _spelt)).alias("around"))

    if count <= MOST_SHINGLES:
        # A band's number is in its value, so equal values are of the same band, and a window meets a template once.
        signed = known.select("template", "spelt", "s", _bound(F.col("h"), _bands).alias("signed"))
        met = built.join(F.broadcast(signed), "s").where(F.arrays_overlap("bands", "signed"))
    else:
        # A row for each band in common, but texts go along once a window and template.
        signed = known.select("template", "s", F.posexplode(_bound(F.col("h"), _bands)).alias("band", "value"))
        met = built.select("row", "s", "start", F.posexplode("bands").alias("band", "value"))
        met = met.join(signed, ["s", "band", "value"]).select("row", "s", "start", "template").distinct()
        met = built.join(met, ["row", "s", "start"]).join(known.select("template", "spelt"), "template")
    met = met.select("row", "doc_id", "template", "s", "start", "around", "spelt")
    share = F.size(F.array_intersect("around", "spelt")) / F.size("spelt")
    found = met.select("row", "doc_id", "template", "s", "start", share.alias("containment")).where(F.col("containment") >= containment)
    # Windows of a template that overlap are one place.
    line = Window.partitionBy("row", "template").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(line) > F.col("s"), F.lit(True))
    found = found.withColumn("_apart", apart.cast("int")).withColumn("_place", F.sum("_apart").over(line))
    best = found.groupBy("row", "doc_id", "template", "_place").agg(F.max_by(F.struct("containment", "start", "s"), F.struct("containment", -F.col("start"))).alias("b"))
    return best.select("doc_id", "template", "b.containment", F.col("b.start").cast("long").alias("start"), (F.col("b.s") + WORDS - 1).cast("long").alias("words"))
