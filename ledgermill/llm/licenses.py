"""License scans: MinHash bands over overlapping windows, verified by shingle containment.

A text becomes lower-case words and 5-word shingles. Windows of w shingles (8, or fewer for
templates too short to hold one wherever it begins) start at every w/2-th shingle of a
text and at every shingle of a template, so that a window that lies within a passage meets the template's window of the
same place. All windows of all texts are signed. A row of a band is the least or the greatest of the window's
shingles in the order of the band's hash; a band is both. The number of bands follows from
``certainty``: of the windows within a passage with at least ``min_containment`` of a template, the best one
has lost at most the average; with the worst such loss a band collides with some probability p, and b bands all miss with
(1 - p)^b. Templates that a band retrieves count if a span of the text contains at least ``min_containment`` of their
shingles: a span has twice as many shingles as the longest template of its class (a power of two), begins at a
multiple of that length and overlaps the window. A template of fewer words than a shingle is one shingle of its own length.

Templates are a parameter, so that their bands are a small table, and it is broadcast only if its
counted rows are few. Everything is built-in functions.

Defined cases: null, empty and blank texts, and texts of fewer words than the shortest template, have no
match; spans are cut at the end of a text; passages repeated within a text give one row per
license, with the best containment; rows that share an id are reported together; rows with a
null id are reported under null; empty tables give empty results; other columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small

SHINGLE = 5
WINDOW = 8
MIN_CONTAINMENT = 0.8
CERTAINTY = 0.999

# Public license notices, by SPDX identifier or a LicenseRef where there is none.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "LicenseRef-All-Rights-Reserved": ("All rights reserved.",),
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _hash_shingles(word_hashes: Column, positions: Column, size: int) -> Column:
    """Hashes of the shingles that begin at the given places (from 1)."""
    return F.transform(positions, lambda i: F.xxhash64(*[F.element_at(word_hashes, (i + k).cast("int")) for k in range(size)]))


def _shingles_by_size(first: Column, last: Column, sizes: Collection[int]) -> Column:
    """Hashes of the shingles of ``wh`` that begin from first to last, of as many words as the column ``size`` says."""
    return F.coalesce(*[F.when(F.col("size") == k, _hash_shingles(F.col("wh"), F.sequence(first, last), k)) for k in sorted(sizes)], F.array().cast("array<bigint>"))


def _class_of(shingles: int) -> int:
    """The longest template of a class: the next power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, shingles))))


def _step(window: int) -> int:
    return max(1, window // 2)


def window_of(shingles: int) -> int:
    """Shingles of a window for a template: the largest power of two of which one lies within a passage wherever it begins."""
    window = WINDOW
    while window + _step(window) - 1 > shingles:
        window //= 2
    return window


def bands_for(shingles: int, min_containment: float, certainty: float) -> int:
    """Bands of two rows, of which at least one collides with probability ``certainty`` for a passage that holds just enough."""
    window = window_of(shingles)
    step = _step(window)
    lost = shingles - math.ceil(min_containment * shingles - 1e-9)
    apart = max(1, (shingles - step + 1) // window)
    overlapping = (shingles - window - step + 1) // step + 1
    lost = min(lost // apart, lost * math.ceil(window / step) // overlapping)
    same, union = window - lost, window + lost
    if same < min(2, window):
        raise ValueError(f"windows of {window} shingles cannot find a passage with {min_containment} of {shingles}")
    p = same / union * ((same - 1) / (union - 1) if union > 1 else 1)
    return 1 if p == 1 else math.ceil(math.log(1 - certainty) / math.log(1 - p))


def _signed(rows: DataFrame, keep: list[str], bands: Mapping[int, int], classes: list[tuple[int, int]], starts: Column) -> DataFrame:
    """``keep``, at and value for each window and band of the array ``sh``.

    ``starts`` holds a window's class, by its place in ``classes`` of (size, window), above its place in ``sh`` in 40 bits.
    """
    # Outer explodes: for others Spark infers a filter, pushes it down and hashes a text anew for each of its words.
    placed = rows.select(*keep, "sh", F.explode_outer(starts).alias("start")).where("start is not null")
    number = F.shiftright("start", 40).cast("int")
    widths = F.array(*[F.lit(w) for _, w in classes])
    placed = placed.select(*keep, "sh", number.alias("number"), F.col("start").bitwiseAND((1 << 40) - 1).cast("int").alias("at"), F.get(widths, number).alias("width"))
    # A shorter window repeats its shingles: that changes neither the least nor the greatest.
    cells = [F.get("sh", F.col("at") + F.lit(i).bitwiseAND(F.col("width") - 1)).alias(f"h{i}") for i in range(WINDOW)]
    numbers = F.array(*[F.sequence(F.lit(0), F.lit(bands[i] - 1)) for i in range(len(classes))])
    dealt = placed.select(*keep, "sh", "number", "at", *cells, F.get(numbers, "number").alias("bands"))
    each = dealt.select(*keep, "sh", "number", "at", *[f"h{i}" for i in range(WINDOW)], F.explode_outer("bands").alias("band"))
    mixed = [F.xxhash64(F.col("band"), F.col(f"h{i}")) for i in range(WINDOW)]
    return each.select(*keep, "sh", "at", F.xxhash64("number", "band", F.least(*mixed), F.greatest(*mixed)).alias("value"))


def template_table(spark, templates: Mapping[str, tuple[str, ...]], size: int) -> DataFrame:
    """(license, part, size, m, shingles, class, window), hashed by the same functions as texts.

    size is the shingle's length in words: that of the template if it is shorter.
    """
    rows = []
    for name, texts in sorted(templates.items()):
        for part, text in enumerate(texts):
            words = template_words(text)
            if not words:
                raise ValueError(f"a template of {name} has no words")
            own = min(size, len(words))
            n = len(words) - own + 1
            rows.append((name, part, words, own, _class_of(n), window_of(n)))
    table = spark.createDataFrame(rows, "license string, part int, words array<string>, size int, class int, window int").withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))
    table = table.withColumn("ordered", _shingles_by_size(F.lit(1), F.size("wh") - (F.col("size") - 1), {r[3] for r in rows}))
    return table.select("license", "part", "size", "ordered", F.array_distinct("ordered").alias("shingles"), F.size(F.array_distinct("ordered")).alias("m"), "class", "window")


def scan(docs: DataFrame, *, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, size: int = SHINGLE, min_containment: float = MIN_CONTAINMENT, certainty: float = CERTAINTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, containment, first_word): one row per id and license found.

    first_word is the place (from 0) of the span with the best match, the first on ties.
    """
    spark = docs.sparkSession
    needed: dict[tuple[int, int], int] = {}
    for text in (t for texts in templates.values() for t in texts):
        words = len(template_words(text))
        own = min(size, words)
        key = (own, window_of(words - own + 1)) if words else (1, 1)
        needed[key] = max(needed.get(key, 1), bands_for(words - own + 1, min_containment, certainty) if words else 1)
    classes = sorted(needed)
    bands = {i: needed[c] for i, c in enumerate(classes)}
    sizes = sorted({k for k, _ in classes})

    def starts(number: int, first: Column, count: Column, window: int, step: int) -> Column:
        base = F.lit(number << 40) + first
        return F.when(count >= window, F.sequence(base, base + (count - window), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    # Texts: the shingles of each size, one size after the other.
    count = lambda k: F.greatest(F.size("wh") - (k - 1), F.lit(0))
    first = {k: sum((count(j) for j in sizes if j < k), F.lit(0)) for k in sizes}
    hashed = docs.select(F.col(id_col).alias("_id"), F.transform(_words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("wh"))
    all_sizes = [F.when(F.size("wh") >= k, _hash_shingles(F.col("wh"), F.sequence(F.lit(1), F.size("wh") - (k - 1)), k)).otherwise(F.array().cast("array<bigint>")) for k in sizes]
    every = F.concat(*[starts(i, first[k].cast("long"), count(k).cast("long"), w, _step(w)) for i, (k, w) in enumerate(classes)])
    texts = hashed.select("_id", F.size("wh").alias("words"), F.concat(*all_sizes).alias("sh"), every.alias("starts"))
    asked = _signed(texts, ["_id", "words"], bands, classes, F.col("starts"))

    # Templates: every window of the one size and length that suits it.
    fixed = template_table(spark, templates, size)
    own = F.coalesce(*[F.when((F.col("size") == k) & (F.col("window") == w), starts(i, F.lit(0).cast("long"), F.size("sh").cast("long"), w, 1)) for i, (k, w) in enumerate(classes)])
    filed = _signed(fixed.withColumnRenamed("ordered", "sh"), ["license", "part", "size", "class", "m", "shingles"], bands, classes, own)
    filed = broadcast_if_small(filed.drop("sh", "at").dropDuplicates(["license", "part", "value"]))

    met = asked.join(filed, "value")
    begin_of = F.coalesce(*[F.when(F.col("size") == k, sum((F.greatest(F.col("words") - (j - 1), F.lit(0)) for j in sizes if j < k), F.lit(0))) for k in sizes])
    met = met.withColumn("_first", begin_of).withColumn("_place", F.col("at") - F.col("_first"))
    index = F.floor(F.col("_place") / F.col("class")).cast("int")
    over = F.floor((F.col("_place") + WINDOW - 1) / F.col("class")).cast("int")
    spans = F.sequence(F.greatest(index - 1, F.lit(0)), over)
    met = met.withColumn("_span", F.explode_outer(spans)).withColumn("begin", F.col("_span") * F.col("class"))
    left = F.col("words") - (F.col("size") - 1) - F.col("begin")
    met = met.where(left > 0)
    span = F.slice("sh", F.col("_first") + F.col("begin") + 1, F.least(2 * F.col("class"), left))
    share = F.size(F.array_intersect("shingles", span)) / F.col("m")
    best = F.max_by(F.struct("containment", "begin"), F.struct("containment", -F.col("begin")))
    found = met.select("_id", "license", "begin", share.alias("containment")).where(F.col("containment") >= min_containment)
    return found.groupBy("_id", "license").agg(best.alias("b")).select(F.col("_id").alias(id_col), "license", F.col("b.containment").alias("containment"), F.col("b.begin").cast("long").alias("first_word"))


def brute_force(text: str | None, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, size: int = SHINGLE, min_containment: float = MIN_CONTAINMENT) -> set[str]:
    """The licenses whose shingles some window of the class length contains, for tests."""
    words = template_words(text or "")
    spans = lambda of, k: [tuple(of[i : i + k]) for i in range(len(of) - k + 1)]
    found = set()
    for name, texts in templates.items():
        for t in texts:
            own = template_words(t)
            k = min(size, len(own))
            shingles, wanted = spans(words, k), set(spans(own, k))
            m = _class_of(len(own) - k + 1)
            windows = (set(shingles[at : at + 2 * m]) for at in range(0, len(shingles), m))
            if any(len(wanted & w) / len(wanted) >= min_containment for w in windows):
                found.add(name)
    return found


__all__ = ["TEMPLATES", "brute_force", "scan", "template_table"]
