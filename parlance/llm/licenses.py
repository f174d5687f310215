"""License scans (operator 9), DataFrame functions only: MinHash bands retrieve templates, exact containment verifies.

Texts and templates are cut into words, and each run of five words is a shingle with a 64-bit hash. A window is SPAN
neighbouring shingles. Templates have a window at each shingle; texts have one at every second, so that each overlaps
the next by half, and one at their end. MinHash number j of a window is the least of its hashes after XOR with constant
j; a band is the hash of ROWS such numbers, and each window has BANDS of them. Windows of similarity s share a band with
the chance 1 - (1 - s^ROWS)^BANDS.

What that guarantees: a text that holds 0.8 of a template's n shingles, n at least SHORT, leaves four or more of them in
a row somewhere, as the d lost ones, at most n/5, part the rest into d + 1 runs, and 0.8 n / (0.2 n + 1) is above three.
A run of five has a window of the text that equals one of the template's: all bands agree. A run of four that lies
between the text's windows has two windows of similarity 3/5: both miss with the chance (1 - 0.36)^12, 0.5 %, and every
further run of three or four has one or two more. Templates of fewer than SHORT shingles are retrieved by any one of
their shingles, as bands of windows of one, and those of fewer than five words by their whole run of words. What is
retrieved is verified exactly: the share of the template's shingles that the whole text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# License notices as their authors publish them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
WORDS, SPAN, ROWS, BANDS, SHORT = 5, 4, 2, 6, 16
#: As many bands as this are looked up in the row, as a fixed set of the plan; more are a table that texts' bands are joined with.
LISTED = 20_000
#: Constants of the MinHash numbers: multiples of the golden ratio's 64-bit fraction.
MASKS = [((i * 0x9E3779B97F4A7C15) & (2**64 - 1)) - (2**64 if (i * 0x9E3779B97F4A7C15) & 2**63 else 0) for i in range(1, ROWS * BANDS + 1)]


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def upto(last: Column, step: int = 1) -> Column:
    """0 to last; nothing if that is below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def runs(w: Column, n: int = WORDS) -> Column:
    """Hash of the n words from each word on; none for shorter texts. Runs of other than five words never meet those of five."""
    mark = [] if n == WORDS else [F.lit(n)]
    return F.transform(upto(F.size(w) - n), lambda i: F.xxhash64(*mark, *(F.get(w, i + j) for j in range(n))))


def bands(h: Column, i: Column) -> Column:
    """The bands of the window of SPAN shingles from i on; least skips what lies beyond the end."""
    number = lambda j: F.least(*(F.get(h, i + k).bitwiseXOR(F.lit(MASKS[j]).cast("long")) for k in range(SPAN)))
    return F.array(*(F.xxhash64(F.lit(p), *(number(p * ROWS + r) for r in range(ROWS))) for p in range(BANDS)))


def templates(spark: SparkSession, given: dict[str, str]) -> DataFrame:
    """license, n (words a run), th (distinct runs), v (its bands): short ones have their runs as bands."""

    def parts(w: Column) -> Column:
        n = F.least(F.size(w), F.lit(WORDS))
        return let(F.coalesce(*(F.when(n == k, runs(w, k)) for k in range(1, WORDS + 1))), lambda h: F.struct(n.alias("n"), F.array_distinct(h).alias("th"), F.array_distinct(windows(h)).alias("v")))

    def windows(h: Column) -> Column:
        return F.when(F.size(h) < SHORT, h).otherwise(F.flatten(F.transform(upto(F.size(h) - SPAN), lambda i: bands(h, i))))

    # Words and runs are bound by let(): a column of an earlier select could be put into every place that names it.
    t = spark.createDataFrame(sorted(given.items()), "license string, text string").select("license", let(words(F.col("text")), parts).alias("x"))
    return t.select("license", "x.*").filter(F.size("th") > 0)


def scan(docs: DataFrame, given: dict[str, str] | None = None, *, least: float = 0.8, listed: int = LISTED) -> DataFrame:
    """doc_id, license, containment, first_word, last_word: the licenses of each row of docs.

    docs: doc_id, text. containment: the share of the template's distinct five-word shingles that the text holds, at least
    `least`, whatever stands between them; first_word and last_word: where the first of them begins and the last ends, in
    words from 0. A template of fewer than five words is one run of as many. A null text or one without the words has no
    row; rows that share a doc_id and text count once, rows of one doc_id with other texts each for themselves; other
    columns are ignored. Rows are handled where they are and only matches are shuffled, unless the templates' bands are
    more than `listed`: then texts' bands are dealt by value to the templates', and texts meet what was found by an exchange.
    """
    spark = docs.sparkSession
    t = templates(spark, given or TEMPLATES)
    known = t.select("license", F.explode("v").alias("v"))
    # The templates are a parameter: what comes of them is their own size.
    told = t.select("n", F.size("th").alias("m"), F.when(F.size("v") <= listed, F.col("v")).alias("v"), F.size("v").alias("many")).collect()
    short = sorted({r.n for r in told if r.n < WORDS})
    lone = any(r.n == WORDS and r.m < SHORT for r in told)
    few = sum(r.many for r in told) <= listed

    def cut(w: Column) -> Column:
        # One array for each number of words that a template's runs have; the last is of five.
        return F.struct(*(runs(w, n).alias(f"r{n}") for n in [*short, WORDS]))

    def found(x: Column) -> Column:
        h = x[f"r{WORDS}"]
        at = F.concat(upto(F.size(h) - SPAN, 2), F.when((F.size(h) < SPAN) & (F.size(h) > 0), F.array(F.lit(0))).when(F.size(h) > 0, F.array(F.size(h) - SPAN)).otherwise(F.array().cast("array<int>")))
        every = F.flatten(F.transform(at, lambda i: bands(h, i)))
        return F.concat(every, *([h] if lone else []), *(x[f"r{n}"] for n in short))

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), let(words(F.col("text")), cut).alias("x"))
    if few:
        values = sorted({v for r in told for v in r.v})
        mine = keyed.select("doc_id", "t", "x", F.explode(F.array_distinct(F.filter(let(F.col("x"), found), lambda v: v.isin(values)))).alias("v"))
        who = t.select("license", "n", "th", F.explode("v").alias("v"))
        # A text meets each license by at most as many bands as that has; of these one is enough.
        both = mine.join(F.broadcast(who), "v")
    else:
        pairs = keyed.select("doc_id", "t", F.explode(F.array_distinct(let(F.col("x"), found))).alias("v")).join(known.hint("merge"), "v")
        pairs = pairs.select(F.col("doc_id").alias("d2"), F.col("t").alias("t2"), "license").distinct()
        both = keyed.join(pairs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))).join(t.select("license", "n", "th"), "license")
    h = F.coalesce(*(F.when(F.col("n") == n, F.col(f"x.r{n}")) for n in [*short, WORDS]))
    both = both.select("doc_id", "t", "license", "n", "th", h.alias("h"), F.reverse(h).alias("back"))
    # What two arrays share comes in the order of the first of them.
    one = lambda x: F.array_position(F.col(x), F.get(F.array_intersect(x, "th"), F.lit(0)))
    both = both.select("doc_id", "t", "license", (F.size(F.array_intersect("h", "th")) / F.size("th")).alias("share"), (one("h") - 1).alias("a"), (F.size("h") - one("back") + F.col("n") - 1).alias("b"))
    best = both.filter(F.col("share") >= least).groupBy("doc_id", "t", "license").agg(F.max("share").alias("containment"), F.min("a").alias("first_word"), F.max("b").alias("last_word"))
    return best.select("doc_id", "license", "containment", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))
