"""License scanning by MinHash bands over overlapping text windows.

Words are maximal runs of letters and digits, lower-cased; shingles are five words, and all
the words of a template that has fewer, which then is found where they stand in a row. The
templates fall into classes by length; a class of templates of at most L words has windows
of 2 L words that start every L words, so each place of a template lies whole in a window.
A window's signature has one row per band, and the number of bands is set so that a window
that holds four fifths of any template of its class collides with it with probability
``1 - MISS`` at least. Band collisions, an equality join, retrieve templates; the shingles
themselves, compared as text, verify containment of 0.8 or more.

A window without a single shingle of a template of its class cannot share a band minimum
with it, so signatures are computed only for windows that have one: this loses nothing.
That filter, and everything else, is DataFrame functions; the filter runs without a shuffle,
and only the few windows that pass reach the joins. The template table is fixed by the
caller and does not grow with the corpus: up to ``LITERALS`` shingles enter the plan as
literals, and more are a table that the hashes of the texts are joined with.

Defined cases: null and empty texts have no license; a text of fewer words than a shingle
has none of its templates; very long texts are scanned whole, window by window; a template
without a word is an error; of texts that state several licenses each is found, and ties do
not arise; repeated licenses in one text count once; repeated rows, and rows with equal ids,
keep their own findings; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.llm.text import let
from bindery.storage import materialize

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-6
#: The band table has a row per template and band; up to so many rows it is broadcast.
BROADCAST_ROWS = 100_000
#: Distinct shingles of templates of one length that a plan holds as literals.
LITERALS = 20_000
NO_ID = -(2**63)

#: Public license notices by SPDX identifier, and public texts of whole licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "GPL-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "Apache-notice",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "MIT-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
        CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE.""",
    ),
    (
        "BSD-3-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.

        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.

        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "ISC-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.

        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
        ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software.

        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:

        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required.

        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software.

        3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense-text",
        """This is free and unencumbered software released into the public domain.

        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code
        form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
        copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
)

#: Notices of fewer words than a shingle.
NOTICES: tuple[tuple[str, str], ...] = (
    ("All-rights-reserved", "All rights reserved"),
    ("Some-rights-reserved", "Some rights reserved"),
    ("No-rights-reserved", "No rights reserved"),
)


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _shingles(array: Column, make, shingle: int) -> Column:
    """``make`` of the words of each shingle, in order."""
    return let(
        array,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))),
            lambda i: make(*(F.get(w, i + k) for k in range(shingle))),
        ),
    )


def _text_shingles(array: Column, shingle: int = SHINGLE) -> Column:
    return F.array_distinct(_shingles(array, lambda *w: F.concat_ws(" ", *w), shingle))


def _hash_shingles(array: Column, shingle: int = SHINGLE) -> Column:
    return _shingles(array, lambda *w: F.xxhash64(*w), shingle)


def _by_shingle(make) -> Column:
    """``make(words, shingle)`` of a template, whose shingle has ``shingle`` words."""
    made = make(F.col("words"), SHINGLE)
    for shingle in range(1, SHINGLE):
        made = F.when(F.col("shingle") == shingle, make(F.col("words"), shingle)).otherwise(made)
    return made


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(license, n, shingle, span, shingles, hashes); span is the class: the words are at most
    so many, a power of two; shingle is the words of a shingle."""
    told = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates))
    rows = spark.range(1).select(F.inline(told))
    counted = rows.select("license", license_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    span = F.pow(F.lit(2), F.ceil(F.log2(F.greatest("n", F.lit(8))))).cast("int")
    return counted.withColumn("shingle", F.least("n", F.lit(SHINGLE))).select(
        "license",
        "n",
        "shingle",
        span.alias("span"),
        _by_shingle(_text_shingles).alias("shingles"),
        F.array_distinct(_by_shingle(_hash_shingles)).alias("hashes"),
    )


def bands_for(span: int, distinct: int, shingle: int = SHINGLE) -> int:
    """Bands of one row so that a window with four fifths of a template of ``distinct``
    shingles collides with probability ``1 - MISS``."""
    window = 2 * span - shingle + 1
    shared = math.ceil(CONTAINMENT * distinct)
    similarity = shared / (window + distinct - shared)
    return math.ceil(math.log(MISS) / math.log1p(-min(similarity, 1 - 1e-9)))


def _signature(hashes: Column, bands: int) -> Column:
    return let(
        hashes,
        lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(bands - 1)),
            lambda k: F.struct(
                k.alias("band"), F.array_min(F.transform(own, lambda h: F.xxhash64(k, h))).alias("value")
            ),
        ),
    )


def _distinct_hashes(known: list) -> list[int]:
    return sorted({h for t in known for h in t["hashes"]})


def _overlapping(rows: DataFrame, column: str, table: DataFrame, own: list, span: int | None, shingle: int) -> DataFrame:
    """Rows that have a hash of the templates ``own``, those of a class in ``table``."""
    wanted = _distinct_hashes(own)
    if len(wanted) <= LITERALS:
        return rows.filter(F.arrays_overlap(column, F.array(*map(F.lit, wanted))))
    chosen = table.filter(F.col("shingle") == shingle)
    chosen = chosen if span is None else chosen.filter(F.col("span") == span)
    hashes = chosen.select(F.explode("hashes").alias("h")).distinct()
    keys = [c for c in ("doc_id", "row", "first") if c in rows.columns]
    found = rows.select(*keys, F.explode(F.array_distinct(column)).alias("h")).join(hashes, "h", "left_semi")
    return rows.join(found.select(*keys).distinct(), keys, "left_semi")


def _with_any(hashed: DataFrame, table: DataFrame, known: list, sizes: list[int]) -> DataFrame:
    """Texts that have a shingle of any template."""
    groups = {k: [t for t in known if t["shingle"] == k] for k in sizes}
    few = {k: own for k, own in groups.items() if len(_distinct_hashes(own)) <= LITERALS}
    hold = [
        (F.size("words") >= k) & F.arrays_overlap(f"hashes{k}", F.array(*map(F.lit, _distinct_hashes(own)))) for k, own in few.items()
    ]
    found = hashed.filter(reduce(or_, hold)) if hold else None
    for k in groups.keys() - few.keys():
        more = _overlapping(hashed.filter(F.size("words") >= k), f"hashes{k}", table, groups[k], None, k)
        found = more if found is None else found.unionByName(more)
    return found if len(few) == len(groups) else found.dropDuplicates(["doc_id", "row"])


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """(doc_id, row, license, shared, total, first_word): each license of each row, with the
    most template shingles that one window shares, of how many, and the word where the first
    window that matches starts. ``row`` is a hash of the text."""
    spark = docs.sparkSession
    table = template_table(spark, templates)
    known = table.collect()  # as many rows as the caller gave templates
    if wordless := [t["license"] for t in known if not t["n"]]:
        raise ValueError(f"templates without a word: {wordless}")
    sizes = sorted({t["shingle"] for t in known})
    tokens = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("row"),
        license_words(F.col(text)).alias("words"),
    )
    hashed = tokens.select(
        "doc_id", "row", "words", *(_hash_shingles(F.col("words"), k).alias(f"hashes{k}") for k in sizes)
    )

    hits = materialize(_with_any(hashed, table, known, sizes), "license-hits")
    found = None
    for span, k in sorted({(t["span"], t["shingle"]) for t in known}):
        own = [t for t in known if (t["span"], t["shingle"]) == (span, k)]
        bands = max(bands_for(span, len(t["hashes"]), k) for t in own)
        windows = (
            hits.filter(F.size("words") >= k)
            .select(
                "doc_id", "row", "words", F.col(f"hashes{k}").alias("hashes"),
                F.explode(F.sequence(F.lit(0), F.greatest(F.size(f"hashes{k}") - 1, F.lit(0)), F.lit(span))).alias("first"),
            )
            .select(
                "doc_id", "row", "first",
                F.slice("words", F.col("first") + 1, F.lit(2 * span)).alias("words"),
                F.slice("hashes", F.col("first") + 1, F.lit(2 * span - k + 1)).alias("hashes"),
            )
            .transform(lambda rows: _overlapping(rows, "hashes", table, own, span, k))  # noqa: B023
            .select(
                "doc_id", "row", "first",
                _text_shingles(F.col("words"), k).alias("shingles"),
                F.explode(_signature(F.col("hashes"), bands)).alias("b"),
            )
        )
        wanted = table.filter((F.col("span") == span) & (F.col("shingle") == k)).select(
            "license", F.col("shingles").alias("template"), F.explode(_signature(F.col("hashes"), bands)).alias("t")
        )
        if len(own) * bands <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        retrieved = windows.join(wanted, (F.col("b.band") == F.col("t.band")) & (F.col("b.value") == F.col("t.value")))
        verified = retrieved.select(
            "doc_id", "row", "license", "first",
            F.size(F.array_intersect("template", "shingles")).cast("long").alias("shared"),
            F.size("template").cast("long").alias("total"),
        ).filter(F.col("shared") >= containment * F.col("total"))
        found = verified if found is None else found.unionByName(verified)
    return found.groupBy("doc_id", "row", "license").agg(
        F.max("shared").alias("shared"), F.max("total").alias("total"), F.min("first").cast("long").alias("first_word")
    )


def op10_license_scans(spark, sf_dir) -> DataFrame:
    """Licenses and short rights notices found in each document: their identifiers, sorted, and
    how many."""
    return licenses_of(spark, sf_dir, TEMPLATES + NOTICES)


def licenses_of(spark, sf_dir, templates) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = (
        scan_licenses(docs, templates=templates)
        .groupBy("doc_id", "row")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.count("*").alias("n_licenses"),
        )
    )
    keyed = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("row")
    )
    return keyed.join(found.withColumnRenamed("doc_id", "key"), ["key", "row"], "left").select(
        "doc_id",
        F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("n_licenses", F.lit(0).cast("long")).alias("n_licenses"),
    )


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    split = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    shingles = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))"
    return f"""
WITH t AS (SELECT name, {split.format("body")} AS w FROM (VALUES {values}) v(name, body)),
tt AS (SELECT name, greatest(8, power(2, ceil(log2(len(w)))))::BIGINT AS span, list_distinct({shingles}) AS template FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, {split.format("coalesce(text, '')")} AS w FROM documents),
u AS (SELECT rid, span, w, unnest(range(0, greatest(len(w) - 4, 1), span)) AS first FROM d CROSS JOIN (SELECT DISTINCT span FROM tt) WHERE len(w) >= 5),
v AS (SELECT rid, span, w[first + 1 : first + 2 * span] AS w FROM u),
s AS (SELECT rid, span, {shingles} AS shingles FROM v),
m AS (SELECT DISTINCT rid, name FROM s JOIN tt USING (span)
  WHERE list_has_any(shingles, template) AND len(list_intersect(template, shingles)) >= 0.8 * len(template))
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses, count(name)::BIGINT AS n_licenses
FROM d LEFT JOIN m USING (rid) GROUP BY rid, doc_id
"""


def _notices_oracle() -> str:
    """The SQL of the templates, with notices that are found where their words stand in a row."""
    names = ", ".join(f"('{name}', '{' '.join(text.lower().split())}')" for name, text in NOTICES)
    head, tail = _oracle().rsplit("SELECT doc_id, coalesce(", 1)
    tail = tail.replace("LEFT JOIN m USING", "LEFT JOIN both_kinds USING")
    return f"""{head.rstrip()}, short AS (
  SELECT rid, name FROM (SELECT rid, ' ' || array_to_string(w, ' ') || ' ' AS said FROM d), (VALUES {names}) v(name, body)
  WHERE contains(said, ' ' || body || ' ')
), both_kinds AS (SELECT * FROM m UNION ALL SELECT * FROM short)
SELECT doc_id, coalesce({tail}"""


ORACLE = _notices_oracle()
