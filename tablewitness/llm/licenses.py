"""License scan in DataFrame operations only: MinHash bands over text windows, then exact containment.

Texts become arrays of hashed five-word shingles. Windows of one and a half times a template's length
overlap so far that every copy of the template lies inside one of them. A window and a template meet
when one of ``BANDS`` minimum hashes agrees; at the least wanted overlap of 0.8 of the template the
windows have a Jaccard similarity of at least 0.8 / 1.7, so that a pair is missed with a probability of
at most (1 - 0.8 / 1.7) ** BANDS, below 0.0001. Candidates are verified by exact containment.

A band can only agree when the window holds the very shingle that is the template's minimum, so texts
and windows without any such shingle are left out before the minima are computed. Such a shingle is five whole words: a few words are chosen so that each
minimum has one of them, and texts that contain none of these words, by plain byte search, are not even
split. Neither changes a result.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 16
_BETWEEN = r"[^\p{L}\p{N}]+"

#: Notices of public licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a lambda's own body would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words (letters and digits, in lower case), in order; shorter texts have none."""
    words = F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _once(hashed, _runs)


def _runs(hashed: Column) -> Column:
    spread = F.transform(F.sequence(F.lit(0), F.size(hashed) - WORDS), lambda i: F.xxhash64(*(F.get(hashed, i + k) for k in range(WORDS))))
    return F.when(F.size(hashed) >= WORDS, spread).otherwise(F.array().cast("array<bigint>"))


def signature(window: Column) -> Column:
    """The minimum of the window's shingles under each of ``BANDS`` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(window, lambda s: F.xxhash64(s, k))))


def _first_of(window: Column) -> Column:
    """The shingle behind each minimum."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda k: F.array_min(F.transform(window, lambda s: F.struct(F.xxhash64(s, k).alias("h"), s.alias("s"))))["s"],
    )


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(notice, license, shingles, n, signature, minima) of the notices that have five words or more."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(notices)], "notice int, license string, text string")
    rows = rows.select("notice", "license", F.array_distinct(shingles(F.col("text"))).alias("shingles")).where(F.size("shingles") > 0)
    return rows.select("*", F.size("shingles").alias("n"), signature(F.col("shingles")).alias("signature"), _first_of(F.col("shingles")).alias("minima"))


def telling_words(minima: Sequence[Sequence[str]], least: int = 6) -> list[tuple[str, ...]]:
    """Few sets of words, such that each of ``minima`` (lists of words) has all words of one of them.

    Single words of ``least`` letters or more are chosen greedily by how many minima they meet. Shorter ones
    stand in most texts, so a minimum of short words only is a set of its own.
    """
    left, out = [frozenset(m) for m in minima], []
    while left:
        counts: dict[str, int] = {}
        for m in left:
            for w in m:
                counts[w] = counts.get(w, 0) + (len(w) >= least)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        if not counts[best]:
            return out + sorted({tuple(sorted(m, key=lambda w: (-len(w), w))) for m in left})
        out.append((best,))
        left = [m for m in left if best not in m]
    return out


def minimum_words(spark: SparkSession, notices: Sequence[tuple[str, str]]) -> list[list[str]]:
    """The five words of each template's minima under every hash function."""
    rows = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(notices)], "notice int, text string")
    words = F.filter(F.split(F.lower("text"), _BETWEEN), lambda w: w != "")
    runs = rows.select("notice", words.alias("words")).where(F.size("words") >= WORDS)
    runs = runs.select("notice", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - WORDS + 1), lambda i: F.slice("words", i, WORDS))).alias("run"))
    runs = runs.select("notice", "run", _once(F.transform("run", lambda w: F.xxhash64(w)), _runs)[0].alias("s"))
    runs = runs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))).withColumn("h", F.xxhash64("s", "k"))
    return [r.run for r in runs.groupBy("notice", "k").agg(F.min(F.struct("h", "run")).alias("m")).select(F.col("m.run").alias("run")).distinct().collect()]


def _windows(sh: Column, n: int) -> Column:
    """Overlapping windows for notices of ``n`` shingles: every run of n lies inside one."""
    length, step = n + (n + 1) // 2, max(1, n // 2)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sh) - 1), F.lit(step))
    return F.transform(starts, lambda p: F.struct(F.lit(n).alias("n"), p.alias("p"), F.slice(sh, p + 1, length).alias("w")))


def find(documents: DataFrame, notices: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """Licenses in documents: (doc_id, license, containment, start_word, windows).

    ``containment`` is the largest share of a notice's shingles found in one window, ``start_word`` the
    first word of the first such window. Rows with one id are reported together; null, empty and short
    texts have no license. The notices are a list given by the caller and few; nothing else is broadcast.
    """
    spark = documents.sparkSession
    known = templates(spark, notices).collect()
    if not known:
        return spark.createDataFrame([], "doc_id bigint, license string, containment double, start_word bigint, windows bigint")
    longs = lambda values: F.array(*(F.lit(int(v)).cast("long") for v in values))
    choice = telling_words(minimum_words(spark, notices))
    every = lambda text, ws: functools.reduce(operator.and_, (F.contains(text, F.lit(w)) for w in ws))
    told = _once(F.lower("text"), lambda text: functools.reduce(operator.or_, (every(text, ws) for ws in choice)))
    marked = documents.where(told).select("doc_id", shingles(F.col("text")).alias("sh"))
    marked = marked.where(F.arrays_overlap("sh", longs(sorted({s for r in known for s in r["minima"]}))))
    minima = {n: longs(sorted({s for r in known if r["n"] == n for s in r["minima"]})) for n in sorted({r["n"] for r in known})}
    holding = lambda sh, n: F.filter(_windows(sh, n), lambda x: F.arrays_overlap(x["w"], minima[n]))
    per = _once(F.col("sh"), lambda sh: F.concat(*(holding(sh, n) for n in minima)))
    windows = marked.select("doc_id", F.explode(per).alias("x")).select("doc_id", "x.*")
    windows = windows.select("doc_id", "n", "p", "w", F.posexplode(_once(F.col("w"), signature)).alias("band", "value"))
    bands = [(r["n"], band, v, r["notice"], r["license"], r["shingles"]) for r in known for band, v in enumerate(r["signature"])]
    bands = spark.createDataFrame(bands, "n int, band int, value long, notice int, license string, shingles array<long>")
    met = windows.join(F.broadcast(bands), ["n", "band", "value"])
    share = F.size(F.array_intersect("shingles", "w")) / F.col("n")
    found = met.select("doc_id", "license", "notice", "p", share.alias("share")).where(F.col("share") >= least)
    best = F.max(F.struct("share", (-F.col("p")).alias("p")))
    return (
        found.groupBy("doc_id", "license").agg(best.alias("best"), F.count_distinct("notice", "p").alias("windows"))
        .select("doc_id", "license", F.round("best.share", 6).alias("containment"), (-F.col("best.p")).cast("long").alias("start_word"), "windows")
    )
