"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Only DataFrame functions; no Python runs on the executors.

Words are runs of characters other than white space and ASCII punctuation, in lower case; shingles are five words
(``k``).  A text that holds no shingle of any template cannot contain three quarters of one and is let go first.  For
each size class of templates (powers of two of shingles) windows of that many shingles, overlapping by three
quarters, move over the text.  Each window has ``BANDS`` MinHash values, each a band of one row: a window in which a
template lies whole has a Jaccard similarity of at least a half, so that at least one band agrees with a probability
of 1 - 2**-24; at the least similarity that a match can have (three quarters of a template, displaced by an eighth
of the window) it is above 0.9999.  For each template met, the window and half a window on either side are
compared with the template's whole shingle set; containment of at least ``least`` is a match.

Cases: null and empty texts and texts of fewer than ``k`` words match nothing; texts of any length are read whole;
rows of one id are one document, so repeated rows give one match; rows without an id are left out; of equal windows
the first is reported; an empty table gives an empty result; columns other than id and text are ignored.  Ids are
integers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

BANDS = 24

# Short notices, opening clauses and whole texts of public licenses, as their publishers word them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of all ``k``-word shingles in their order; none for fewer words."""
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    return let(words, lambda w: F.when(F.size(w) >= k, hashes(w)).otherwise(F.array().cast("array<long>")))


def bands_of(shingles: Column, bands: int = BANDS) -> Column:
    """MinHash values of a set of shingle hashes: the least of each permutation, with its number."""
    permuted = lambda b: F.transform(shingles, lambda s: F.xxhash64(s, F.lit(b * 7919 + 1)))
    return F.array(*(F.xxhash64(F.lit(b), F.array_min(permuted(b))) for b in range(bands)))


def size_class(count: int) -> int:
    return 1 << max(0, (count - 1).bit_length())


def license_templates(spark, templates: dict[str, str], k: int) -> tuple[DataFrame, list[int]]:
    """(template, size class, shingle set, bands) and the classes there are.  The templates are a parameter of the
    caller, at most 10 MB in all; longer lists are refused, as they are sent to every executor."""
    if sum(len(t) for t in templates.values()) > 10_000_000:
        raise ValueError("license templates of more than 10 MB in all")
    rows = spark.createDataFrame(list(templates.items()), "template string, text string")
    rows = rows.withColumn("shingles", F.array_distinct(shingles_of(words_of(F.col("text")), k))).where(F.size("shingles") > 0)
    count = {n: len(set(zip(*(w[i:] for i in range(k)), strict=False))) for n, w in ((n, _plain_words(t)) for n, t in templates.items())}
    classes = {n: size_class(c) for n, c in count.items() if c}
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)), F.col("template")) if classes else F.lit(0)
    return rows.select("template", kind.alias("size"), F.col("shingles").alias("template_shingles"), bands_of(F.col("shingles")).alias("template_bands")), sorted(set(classes.values()))


def _plain_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text.lower()) if w]


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found: doc_id, template, containment, position (first word), n_windows."""
    spark = docs.sparkSession
    known, classes = license_templates(spark, TEMPLATES if templates is None else templates, k)
    vocabulary = sorted({s for r in known.select("template_shingles").collect() for s in r[0]})
    terms = F.array(*map(F.lit, vocabulary)).cast("array<long>")
    has_term = lambda shingles: F.arrays_overlap(shingles, terms)
    shingles = shingles_of(words_of(F.col("text")), k)
    # generators, unlike filters, are not pushed below what they read, which would compute it twice
    some = id_and_text(docs, id_col, text_col).where("doc_id is not null").select("doc_id", F.explode(F.filter(F.array(shingles), has_term)).alias("shingles"))
    sized = some.select("doc_id", "shingles", F.explode(F.array(*map(F.lit, classes or [1]))).alias("size"))
    step = F.greatest(F.col("size") / 4, F.lit(1)).cast("int")
    begins = F.sequence(F.lit(1), F.size("shingles"), step)
    all_windows = F.transform(begins, lambda b: F.struct(b.alias("begin"), F.slice("shingles", b, F.col("size")).alias("window")))
    side = (F.col("size") / 2).cast("int")
    windows = sized.select("doc_id", "shingles", "size", F.explode(F.filter(all_windows, lambda x: has_term(x["window"]))).alias("x"))
    around = F.slice("shingles", F.greatest(F.col("x.begin") - side, F.lit(1)), F.col("size") + 2 * side)
    windows = windows.select("doc_id", "size", F.col("x.begin").alias("begin"), around.alias("around"), F.explode(bands_of(F.col("x.window"))).alias("band"))
    bands = F.broadcast(known.select("template", "size", "template_shingles", F.explode("template_bands").alias("band")).distinct())
    met = windows.join(bands, ["size", "band"]).dropDuplicates(["doc_id", "template", "begin"])
    share = F.size(F.array_intersect("template_shingles", "around")) / F.size("template_shingles")
    found = met.select("doc_id", "template", "begin", share.alias("containment")).where(F.col("containment") >= least)
    return found.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("begin").cast("long").alias("position"), F.count("*").alias("n_windows"))
