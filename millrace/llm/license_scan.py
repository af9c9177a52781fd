"""License scans: MinHash bands over overlapping text windows, verified by shingle containment. DataFrame
functions only.

A template of m words is looked for in windows of m + ceil(m / 2) words that start every ceil(m / 2) words,
so that each occurrence lies whole in some window. A window that holds ``containment`` of a template's
shingles has at least a known Jaccard similarity to it; the number of bands is set so that such a pair
shares a band but for one case in ``1 / MISS``. Windows and templates that share a band are verified by
exact containment. Before any window is made, texts without any of the words that together hit every
template shingle are left out, and windows without any template shingle after that: neither can hold one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import any_of, materialize

WORDS_EACH, CONTAINMENT, MISS = 5, 0.8, 1e-9
WORD = r"[\p{L}\p{N}]+"

#: Fixed texts. Notices by license: the short statements in use, the whole texts of the short licenses, and
#: the statements by which the long ones (Apache, GPL, LGPL, AGPL, MPL, Creative Commons) are applied.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation",
    ),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at",
    ),
    (
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
    ),
    (
        "AGPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: Words that are everywhere, so poor ones to look for.
EVERYWHERE = frozenset("a an and any are as at by for from in is it may not of on or that the this to was with you".split())


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[str]:
        n = max(1, len(self.words) - WORDS_EACH + 1)
        return list(dict.fromkeys(" ".join(self.words[i : i + WORDS_EACH]) for i in range(n)))

    @property
    def stride(self) -> int:
        return -(-len(self.words) // 2)

    @property
    def window(self) -> int:
        return len(self.words) + self.stride


def templates(texts: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Template]:
    """Templates without any word are left out; others need a shingle's words at least."""
    cut = [(name, tuple(re.findall(r"[^\W_]+", text.lower()))) for name, text in texts]
    if any(0 < len(words) < WORDS_EACH for _, words in cut):
        raise ValueError(f"templates need {WORDS_EACH} words")
    return [Template(k, name, words) for k, (name, words) in enumerate(cut) if words]


def hitting_words(some: list[Template]) -> list[str]:
    """Words such that each shingle of the templates has one: greedily, the most hits first."""
    left, out = {s for t in some for s in t.shingles}, []
    while left:
        hits: dict[str, int] = {}
        for s in left:
            for w in set(s.split(" ")):
                hits[w] = hits.get(w, 0) + 1
        best = max(hits, key=lambda w: (w not in EVERYWHERE and len(w) > 2, hits[w], len(w), w))
        out.append(best)
        left = {s for s in left if best not in s.split(" ")}
    return out


def bands(words: int, window: int, containment: float = CONTAINMENT, miss: float = MISS) -> tuple[int, int]:
    """(number of bands, rows of each) for which a window that holds ``containment`` of a template's
    shingles shares no band with it in ``miss`` of cases at most."""
    t, w = max(1, words - WORDS_EACH + 1), max(1, window - WORDS_EACH + 1)
    shared = math.ceil(containment * t - 1e-9)
    jaccard = min(1.0, shared / (t + w - shared))
    rows = 2 if jaccard >= 0.4 else 1
    return (1 if jaccard == 1 else math.ceil(math.log(miss) / math.log(1 - jaccard**rows))), rows


def _signature(shingles: Column, n_bands: Column, rows: Column) -> Column:
    """One hash for each band: of the least values of its one or two hash functions."""

    def least(k: Column) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(k, x)))

    def band(b: Column) -> Column:
        return F.xxhash64(b, least(2 * b), F.when(rows == 2, least(2 * b + 1)).otherwise(0))

    return F.transform(F.sequence(F.lit(0), n_bands - 1), band)


def _shingle_hashes(words: Column) -> Column:
    n = F.greatest(F.size(words) - WORDS_EACH + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS_EACH), " ")))


def _template_frame(spark: SparkSession, some: list[Template]) -> DataFrame:
    rows = [(t.number, t.license, len(t.words), t.shingles) for t in some]
    frame = spark.createDataFrame(rows, "template int, license string, m int, shingles array<string>")
    return frame.withColumn("template_hashes", F.transform("shingles", lambda s: F.xxhash64(s))).drop("shingles")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: tuple[tuple[str, str], ...] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per row of ``docs`` and template found in it: (id, template, license, containment,
    first_word, n_windows).

    ``containment`` is the greatest share of the template's shingles (five words) in one window, first_word the first word (from 0) of the first window with at least the
    threshold's share, n_windows the number of such windows. Null, empty and wordless texts have none;
    repeated rows are scanned each; without templates or rows the result is empty. Other columns are
    ignored.
    """
    spark, some = docs.sparkSession, templates(texts)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, template int, license string, containment double, first_word int, n_windows long"
    if not some:
        return spark.createDataFrame([], schema)
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    hits = rf"(?<![\p{{L}}\p{{N}}])(?:{any_of(hitting_words(some))})(?![\p{{L}}\p{{N}}])"
    rows = docs.where(F.rlike(text, F.lit(hits))).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("t"))
    rows = rows.select("id", "row", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") > 0)
    # by way of explode, which keeps the words from being cut anew for every shingle
    rows = rows.select("id", "row", F.explode(F.array(F.struct("w"))).alias("x")).select("id", "row", "x.w")
    rows = rows.select("id", "row", F.explode(F.array(F.struct(_shingle_hashes(F.col("w")).alias("s"), F.size("w").alias("n")))).alias("x"))
    frame = _template_frame(spark, some)
    known = frame.select("template_hashes").collect()  # the templates' own, a fixed number
    known = sorted({h for r in known for h in r[0]})
    places = F.filter(F.transform("x.s", lambda h, i: F.when(h.isin(known), i)), lambda i: i.isNotNull())
    rows = rows.select("id", "row", F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.explode(F.array(places)).alias("places"))
    rows = materialize(rows.where(F.size("places") > 0))  # few documents come so far
    sizes = sorted({len(t.words) for t in some})
    looks = [(m, -(-m // 2), m + -(-m // 2), *bands(m, m + -(-m // 2), containment)) for m in sizes]
    names = ("m", "stride", "span", "n_bands", "each")
    look = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, x))) for x in looks))
    rows = rows.withColumn("look", F.explode(look)).select("id", "row", "s", "n", "places", "look.*")
    # the windows that hold a template shingle: those that start at a multiple of the stride within reach
    stride, reach = F.col("stride"), F.greatest(F.col("span") - WORDS_EACH, F.lit(0))
    last = F.floor(F.greatest(F.col("n") - F.col("m") + stride - 1, F.lit(0)) / stride).cast("int")

    def windows(place: Column) -> Column:
        low = F.greatest(F.ceil((place - reach) / stride).cast("int"), F.lit(0))
        high = F.least(F.floor(place / stride).cast("int"), last)
        return F.when(low <= high, F.sequence(low, F.greatest(high, low))).otherwise(F.array().cast("array<int>"))

    starts = F.transform(F.array_distinct(F.flatten(F.transform("places", windows))), lambda k: k * stride)
    span = rows.select("id", "row", F.explode(starts).alias("start"), "s", "span", *(F.col(k).alias(f"w_{k}") for k in ("m", "n_bands", "each")))
    shingles = F.slice("s", F.col("start") + 1, F.greatest(F.col("span") - WORDS_EACH + 1, F.lit(1)))
    span = span.select("id", "row", "start", F.array_distinct(shingles).alias("ws"), "w_m", "w_n_bands", "w_each")
    span = span.where(F.exists("ws", lambda h: h.isin(known)))
    span = span.withColumn("band", F.explode(_signature(F.col("ws"), F.col("w_n_bands"), F.col("w_each"))))
    settings = F.element_at(F.create_map(*(F.lit(v) for m, *_, n, e in looks for v in (m, n * 4 + e))), F.col("m"))
    own = frame.withColumns({"n_bands": F.floor(settings / 4).cast("int"), "each": settings % 4})
    own = own.withColumn("tb", F.explode(_signature(F.col("template_hashes"), F.col("n_bands"), F.col("each")))).drop("n_bands", "each")
    # templates times bands, a fixed number
    met = span.join(F.broadcast(own), (F.col("band") == F.col("tb")) & (F.col("w_m") == F.col("m")))
    share = F.size(F.array_intersect("template_hashes", "ws")) / F.size("template_hashes")
    met = met.select("id", "row", "start", "template", "license", share.alias("share"))
    found = met.distinct().where(F.col("share") >= containment - 1e-9)
    found = found.groupBy("id", "row", "template", "license").agg(
        F.max("share").alias("containment"), F.min("start").alias("first_word"), F.count("*").alias("n_windows")
    )
    return found.select(F.col("id").alias(id_col), "template", "license", "containment", "first_word", "n_windows")


def scan_sql(texts: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> str:
    """The same result in DuckDB SQL, every window against every template."""

    def quoted(items: list[str]) -> str:
        return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"

    values = ",\n  ".join(f"({t.number}, '{t.license}', {len(t.words)}, {t.stride}, {t.window}, {quoted(t.shingles)})" for t in templates(texts))
    return rf"""
with template(template, license, m, stride, span, shingles) as (values
  {values}
), word as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w from documents
), start as (
  select doc_id, template, license, m, span, shingles, w, unnest(range(0, greatest(len(w) - m + stride - 1, 0) + 1, stride)) as s
  from word, template where len(w) > 0
), spans as (
  select doc_id, template, license, shingles, s, ' ' || array_to_string(w[s + 1 : s + span], ' ') || ' ' as line from start
), share as (
  select doc_id, template, license, s, len(list_filter(shingles, lambda x: contains(line, ' ' || x || ' '))) / len(shingles) as share from spans
)
select doc_id, template, license, max(share) as containment, min(s)::int as first_word, count(*) as n_windows
from share where share >= {containment} - 1e-9 group by all
"""
