"""License scans: MinHash bands over overlapping windows, then exact containment.

Words are runs of letters a-z and digits of the lower-cased text, shingles are
five words.  A template is cut into chunks of up to ``LONGEST`` shingles; a
chunk of k shingles belongs to the class K, the least power of two that isn't
smaller.  A text's windows of class K have 2 K shingles and begin at every K-th
word, so each run of K shingles lies in a window whole.

Retrieval: a window and a chunk that share the least of one of ``BANDS`` hashes
(bands of one row) meet.  A chunk with 80 % of its shingles in a window has a
Jaccard similarity of at least 0.8 k / (2 K + 0.2 k) > 0.18 to it (k > K / 2),
so it is missed with probability under (1 - 0.18) ** 48 < 0.0001.

Verification: the share of the whole template's shingles that the passage
around the window has must be ``MIN_CONTAINMENT`` or more.  A template that
reaches this has a chunk that does, so chunks retrieve whole templates.

Only windows with an anchor word are looked at, which loses nothing: anchors are
chosen so that in every chunk more than a fifth of the shingles hold one
(``anchors`` computes and asserts this), and so a passage without any can't
have 80 % of a chunk.

A template of fewer than five words is one shingle of its own length, which is
looked for word by word in the texts that hold an anchor of such templates.

Everything on the way is DataFrame functions; the templates' bands (a few
thousand rows, fixed by ``TEMPLATES``) are broadcast, and only hits are shuffled.

Edge cases: null and empty texts have no hits; texts under five words only have
those of shorter templates;
repeated rows with one doc_id give one row for each license, with the best
containment; null doc_ids count as one document; very long texts are scanned
whole; tables may be empty; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
LONGEST = 32
BANDS = 48
MIN_CONTAINMENT = 0.8

# Notices and texts of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("WTFPL", "SPDX-License-Identifier: WTFPL"),
    ("PostgreSQL", "SPDX-License-Identifier: PostgreSQL"),
)
_WORDS = re.compile("[a-z0-9]+")


def _chunks(words: list[str]) -> list[tuple[int, int]]:
    """(first word, shingles) of the chunks of a template; a short one has one shingle."""
    n = max(len(words) - SHINGLE + 1, 1)
    parts = -(-n // LONGEST)
    bounds = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def _class(k: int) -> int:
    return 1 << (k - 1).bit_length()


def anchors(templates: tuple = TEMPLATES) -> list[str]:
    """Words that more than a fifth of the shingles of every chunk hold, chosen
    greedily: the longest that serves most chunks first."""
    todo = []
    for _, text in templates:
        words = _WORDS.findall(text.lower())
        todo += [[set(words[i : i + SHINGLE]) for i in range(a, a + k)] for a, k in _chunks(words)]
    chosen: list[str] = []

    def short(chunk: list[set[str]]) -> bool:
        return 5 * sum(not s.isdisjoint(chosen) for s in chunk) <= len(chunk)

    while open_ := [c for c in todo if short(c)]:
        words = sorted({w for c in open_ for s in c for w in s if len(w) >= 7} or {w for c in open_ for s in c for w in s})
        words = [w for w in words if w not in chosen]
        gain = {w: (sum(any(w in s for s in c) for c in open_), sum(w in s for c in open_ for s in c), w) for w in words}
        chosen.append(max(words, key=gain.__getitem__))
    return chosen


def _shingles(words: Column) -> Column:
    """Distinct hashes of the five-word strings of an array."""
    last = F.size(words) - SHINGLE
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " "))))


def _least(shingles: Column) -> Column:
    bands = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(bands, lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def _template_bands(docs: DataFrame, templates: tuple) -> DataFrame:
    """(klass, band, least, license, offset, size, whole): a row per chunk and band."""
    rows = []
    for name, text in templates:
        words = _WORDS.findall(text.lower())
        for a, k in _chunks(words):
            rows.append((name, _class(k), a, len(words), words[a : a + k + SHINGLE - 1], words))
    table = docs.sparkSession.createDataFrame(rows, "license string, klass int, offset int, size int, part array<string>, all_words array<string>")
    bands = table.select("license", "klass", "offset", "size", _shingles(F.col("all_words")).alias("whole"), F.posexplode(_least(_shingles(F.col("part")))).alias("band", "least"))
    return bands


def _spaced(text: Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _scan_short(docs: DataFrame, templates: tuple) -> DataFrame:
    """The hits of templates shorter than a shingle, each a run of whole words."""
    own = [(name, " ".join(_WORDS.findall(text.lower()))) for name, text in templates]
    some = docs.select("doc_id", "text").filter(F.col("text").rlike("(?i)" + "|".join(anchors(templates))))
    base = some.select("doc_id", F.concat(F.lit(" "), _spaced(F.col("text")), F.lit(" ")).alias("spaced"))
    places = F.array(*(F.struct(F.lit(name).alias("license"), F.instr("spaced", f" {words} ").alias("at")) for name, words in own))
    met = base.select("doc_id", "spaced", F.explode(places).alias("hit")).filter("hit.at > 0")
    before = F.substring(F.col("spaced"), F.lit(1), F.col("hit.at"))
    first = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1
    return met.select("doc_id", "hit.license", F.lit(1.0).alias("containment"), first.cast("long").alias("first_word"))


def _scan_long(docs: DataFrame, templates: tuple) -> DataFrame:
    """The hits of templates of a shingle or more, a row per window that found them."""
    words = anchors(templates)
    longest: dict[int, int] = {}
    for _, text in templates:
        own = _WORDS.findall(text.lower())
        for _, k in _chunks(own):
            longest[_class(k)] = max(longest.get(_class(k), 0), len(own))
    some = docs.select("doc_id", "text").filter(F.col("text").rlike("(?i)" + "|".join(words)))
    split = F.split(_spaced(F.col("text")), " ")
    listed = F.array(*(F.lit(w) for w in words))
    base = some.select("doc_id", split.alias("words"))
    spots = F.filter(F.transform(F.col("words"), lambda w, i: F.when(F.array_contains(listed, w), i)), lambda i: i.isNotNull())
    base = base.withColumn("spots", spots).filter(F.size("spots") > 0)
    kinds = F.array(*(F.struct(F.lit(k).alias("klass"), F.lit(n).alias("reach")) for k, n in sorted(longest.items())))
    each = base.withColumn("kind", F.explode(kinds)).select("doc_id", "words", "spots", "kind.klass", "kind.reach")
    k = F.col("klass")

    def windows(a: Column) -> Column:
        """The windows of class K that hold the word a."""
        first = F.greatest(F.lit(0), F.floor((a - (2 * k + SHINGLE - 2) + k - 1) / k).cast("int"))
        return F.sequence(first, F.floor(a / k).cast("int"))

    each = each.withColumn("j", F.explode(F.array_distinct(F.flatten(F.transform("spots", windows)))))
    begin = (F.col("j") * k).cast("int")
    window = F.slice("words", begin + 1, (2 * k + SHINGLE - 1).cast("int"))
    # The passage that a template found here can lie in: its own length to either side.
    from_ = F.greatest(F.lit(0), begin - F.col("reach"))
    each = each.select(
        "doc_id",
        "klass",
        begin.alias("begin"),
        from_.alias("from"),
        F.slice("words", from_ + 1, begin - from_ + (2 * k + SHINGLE - 1).cast("int") + F.col("reach")).alias("around"),
        _shingles(window).alias("shingles"),
    ).filter(F.size("shingles") > 0)
    met = each.select("doc_id", "klass", "begin", "from", "around", F.posexplode(_least(F.col("shingles"))).alias("band", "least"))
    found = met.join(F.broadcast(_template_bands(docs, templates)), ["klass", "band", "least"])
    pad = F.ceil(F.col("size") / 4).cast("int")
    lo = F.greatest(F.lit(0), F.col("begin") - F.col("offset") - pad - F.col("from"))
    passage = F.slice("around", lo + 1, (F.col("size") + 2 * F.col("klass") + 2 * pad + SHINGLE).cast("int"))
    common = F.size(F.array_intersect(F.col("whole"), _shingles(passage)))
    scored = found.select("doc_id", "license", (common / F.size("whole")).alias("containment"), (lo + F.col("from")).cast("long").alias("first_word"))
    return scored.filter(F.col("containment") >= MIN_CONTAINMENT)


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, license, containment and first_word (of the passage) of each license found."""
    sizes = [len(_WORDS.findall(text.lower())) for _, text in templates]
    short = tuple(t for t, n in zip(templates, sizes, strict=True) if n < SHINGLE)
    long = tuple(t for t, n in zip(templates, sizes, strict=True) if n >= SHINGLE)
    found = [f(docs, t) for f, t in ((_scan_long, long), (_scan_short, short)) if t]
    good = reduce(DataFrame.unionByName, found)
    return good.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
