"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import lower

WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a shingle.
N = 5
#: Bands of one hash each. A level's shortest templates (g + 2 shingles in a window of 3 g) share the least with it: a Jaccard
#: similarity over 0.25 at containment 0.8, and over 1/3 for verbatim copies, so at least one of 20 bands agrees
#: with a probability over 0.995 (0.9995).
BANDS = 20

# Notices as their licences word them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT-header", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-header", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)


def shingle_hashes(w: Column) -> Column:
    """A hash for each run of N words; none for fewer words."""
    return F.when(F.size(w) >= N, F.transform(F.sequence(F.lit(1), F.size(w) - (N - 1)), lambda i: F.xxhash64(F.slice(w, i, N)))).otherwise(F.array().cast("array<bigint>"))


def level_of(shingles: int) -> int:
    """Stride of the windows for templates of so many shingles: 0 (windows are single shingles) for one; else the least power of two g with shingles <= 2 g + 1, as windows are three strides."""
    if shingles <= 1:
        return 0
    g = 1
    while shingles > 2 * g + 1:
        g *= 2
    return g


def _seeds() -> list[int]:
    """One mask a band; a band's hash of a shingle is its 64-bit hash under the mask, so its least shingle is as random as the hash."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(BANDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 63))
    return out


def _masked(hashes: str, mask: int) -> Column:
    return F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask)))


def _agrees(mins: list[str], keys: list[list[int]]):
    """Whether the window of three strides from i has the minimum of a template in any band."""

    def test(i: Column) -> Column:
        bands = (F.least(F.get(m, i), F.get(m, i + 1), F.get(m, i + 2)).isin(k) for m, k in zip(mins, keys, strict=True))
        return reduce(lambda a, b: a | b, bands)

    return test


def _windows(starts: Column, g: int) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(g).alias("g"), (i * g).alias("i")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",), percent: int = 80) -> DataFrame:
    """Licences that the whole texts hold: keep, license, n_windows, first_word, containment; a row for each text and licence found.

    A window holds a template when at least percent of the template's distinct
    five-word shingles are in it. Templates are dealt into levels by their
    length; a level's windows are three strides of g shingles, one begins at
    every g-th shingle, and any copy of the level's templates lies wholly in one.
    n_windows counts the windows that hold the template, first_word is the first
    one's first word (from 0), containment the largest share found.

    The MinHash of a window is made of the minima of its strides, which longer
    levels join from shorter ones, so each shingle is hashed once a band. Windows
    that share a band with a template are compared by their shingles' words.
    Templates are a bounded list that stands in the expression. Those of fewer
    than five words are refused.

    Null and short texts hold nothing; repeated rows each give their rows; texts
    of any length are scanned whole; other columns are not read.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "i int, license string, t string")
    table = table.withColumn("w", words(F.col("t"))).withColumn("hs", F.array_distinct(shingle_hashes(F.col("w"))))
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (N - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, N), " ")))
    seeds = _seeds()
    known = table.select("i", "license", "hs", shingles.alias("s"), F.size("w").alias("n"), *[F.array_min(_masked("hs", m)).alias(f"m{j}") for j, m in enumerate(seeds)]).orderBy("i").collect()
    if short := [r["license"] for r in known if r["n"] < N]:
        raise ValueError(f"templates of fewer than {N} words: {short}")
    levels: dict[int, list] = {}
    for r in known:
        levels.setdefault(level_of(r["n"] - (N - 1)), []).append(r)

    # A band agrees only where the shingle that is the template's minimum stands in the window, so texts without any of
    # these shingles are done. The row number keeps repeated rows apart; like the partition below, it keeps the optimizer
    # from copying what is computed here into the filter that follows.
    attained = sorted({r[f"m{j}"] ^ seed for r in known for j, seed in enumerate(seeds)} | {h for r in levels.get(0, []) for h in r["hs"]})
    df = docs.select(*keep, words(F.col(text)).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    df = df.withColumn("_hs", shingle_hashes(F.col("_w"))).where(F.arrays_overlap("_hs", F.array(*map(F.lit, attained))))
    found = []
    if 0 in levels:
        single = [h for r in levels[0] for h in r["hs"]]
        found.append(F.transform(F.filter(F.sequence(F.lit(0), F.size("_hs") - 1), lambda i: F.get("_hs", i).isin(single)), lambda i: F.struct(F.lit(0).alias("g"), i.alias("i"))))
    top = max(levels)
    mins = [_masked("_hs", m) for m in seeds]
    g = 1
    while g <= top:
        df = df.withColumns({f"_m{g}_{j}": m for j, m in enumerate(mins)})
        here = [f"_m{g}_{j}" for j in range(BANDS)]
        if g in levels:
            starts = F.sequence(F.lit(0), F.greatest(F.size(here[0]) - 3, F.lit(0)))
            keys = [[r[f"m{j}"] for r in levels[g]] for j in range(BANDS)]
            found.append(_windows(F.filter(starts, _agrees(here, keys)), g))
        halves = lambda c: F.transform(F.sequence(F.lit(0), F.ceil(F.size(c) / 2).cast("int") - 1), lambda i: F.least(F.get(c, i * 2), F.get(c, i * 2 + 1)))
        mins = [halves(c) for c in here]
        g *= 2
    hits = df.withColumns({"_at": F.flatten(F.array(*found)), "_part": F.spark_partition_id()})
    hits = hits.where(F.size("_at") > 0).select(*keep, "_row", "_part", "_w", F.explode("_at").alias("_at"))
    wide = F.when(F.col("_at.g") == 0, F.lit(1)).otherwise(F.col("_at.g") * 3)
    window = F.slice("_w", F.col("_at.i") + 1, wide + (N - 1))
    own = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_s") - (N - 1), F.lit(1))), lambda i: F.array_join(F.slice("_s", i, N), " ")))
    hits = hits.select(*keep, "_row", "_part", "_at", window.alias("_s")).withColumn("_s", own)
    each = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(r["license"]).alias("license"), F.lit(len(r["s"])).alias("n"), F.size(F.array_intersect(F.col("_s"), F.array(*[F.lit(x) for x in r["s"]]))).alias("k")) for g, rs in sorted(levels.items()) for r in rs])
    hits = hits.select(*keep, "_row", "_part", "_at", F.explode(F.filter(each, lambda t: (t["g"] == F.col("_at.g")) & (t["k"] * 100 >= t["n"] * percent))).alias("t"))
    ident = F.struct("_row", "_part", *keep)
    out = hits.groupBy(ident.alias("_k"), F.col("t.license").alias("license")).agg(F.count(F.lit(1)).alias("n_windows"), F.min("_at.i").cast("long").alias("first_word"), F.max(F.col("t.k") / F.col("t.n")).alias("containment"))
    return out.select(*[F.col(f"_k.{c}").alias(c) for c in keep], "license", "n_windows", "first_word", "containment")
