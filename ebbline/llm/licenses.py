"""License scans: MinHash bands retrieve templates, exact shingle containment verifies them.

Shingles are pairs of neighbouring words. Windows of WINDOW words start at every STRIDE-th word
of a text, and at every word of a template (every third of a template of over THIN words, which
still meets one text window in twelve words). A window has BANDS keys of ROWS minimal hashes
each, so a window of Jaccard similarity s meets its counterpart with probability
``1 - (1 - s^ROWS)^BANDS``: 1 for an unchanged one, 0.52 with one word changed. A template of
over SHORT words has 13 such windows at least, so even where every single one has a word
changed it is missed with probability below 1 in 10,000.

Templates of up to SHORT words have too few windows for that. They are retrieved without any
chance: a text with ``part`` of 100 of a template's n shingles has one of any n - needed + 1 of
them, so the longest of its shingles, that many, are keys as they are.

Only texts with a retrieved template are taken apart, and only retrieved templates are verified.
Everything is DataFrame functions; template keys, which are bounded, enter as constants.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbline.llm.common import let

WINDOW, STRIDE, BANDS, ROWS = 8, 4, 2, 2
# Templates of up to SHORT words have exact keys; of over THIN words, every third window is kept.
SHORT, THIN, THINNED = 60, 300, 3
# A template may be spread over a stretch of so many times its words.
SPREAD = 2
# The most words that all templates may have together: their tables are broadcast.
MOST_WORDS = 100_000
# What turns a shingle's hash into those that a band takes the least of.
TURNS = [0x5BD1E9955BD1E995, 0x27D4EB2F165667C5, 0x165667B19E3779F9, 0x3C6EF372FE94F82B]

# Texts of licenses and notices by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    # Cores of the usual wordings, without the verbs before them.
    "mit-under": "under the MIT License",
    "mit-terms": "terms of the MIT License",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "apache-2.0-name": "the Apache License 2.0",
    "apache-2.0-version": "the Apache License, Version 2.0",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "bsd-under": "under the BSD License",
    "bsd-style": "a BSD-style license",
    "bsd-2-clause-name": "BSD 2-Clause License",
    "bsd-3-clause-name": "BSD 3-Clause License",
    "bsd-2-clause-spdx": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-3-clause-spdx": "SPDX-License-Identifier: BSD-3-Clause",
    "isc-under": "under the ISC License",
    "isc-spdx": "SPDX-License-Identifier: ISC",
    "gpl-name": "the GNU General Public License",
    "gpl-under": "under the GNU GPL",
    "gpl-2.0-spdx": "SPDX-License-Identifier: GPL-2.0",
    "gpl-3.0-spdx": "SPDX-License-Identifier: GPL-3.0",
    "lgpl-name": "the GNU Lesser General Public License",
    "lgpl-2.1-spdx": "SPDX-License-Identifier: LGPL-2.1",
    "lgpl-3.0-spdx": "SPDX-License-Identifier: LGPL-3.0",
    "agpl-name": "the GNU Affero General Public License",
    "mpl-name": "the Mozilla Public License",
    "mpl-2.0-spdx": "SPDX-License-Identifier: MPL-2.0",
    "cc-by-4.0-name": "CC BY 4.0",
    "cc-by-sa-4.0-name": "CC BY-SA 4.0",
    "cc-by-sa-4.0-title": "Attribution-ShareAlike 4.0 International",
    "cc-by-nc-4.0-title": "Attribution-NonCommercial 4.0 International",
    "cc0-1.0-title": "CC0 1.0 Universal",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def whole_texts() -> dict[str, str]:
    """Whole licenses by name, without lines of copyright holders and appendices."""
    return {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def _words(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _pairs(w: Column) -> Column:
    """A hash of each pair of neighbouring words."""
    return F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1))
        )
    )


def _bands(pairs: Column, stride: int) -> Column:
    """Per window, at every ``stride``-th word, one key for each band of ROWS minimal hashes."""
    width = WINDOW - 1

    def keys(p: Column) -> Column:
        def window(i: Column) -> Column:
            of = [F.get(p, i + d) for d in range(width)]
            low = [F.least(*[x.bitwiseXOR(F.lit(turn)) for x in of]) for turn in TURNS[: BANDS * ROWS]]
            return F.array(*[F.xxhash64(F.lit(b), *low[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])

        last = F.size(p) - width
        starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)))
        return F.flatten(F.transform(F.coalesce(starts, F.array().cast("array<int>")), window))

    return let(pairs, keys)


class _Known:
    """The templates' keys: pairs by template, and what retrieves a template."""

    def __init__(self, spark: SparkSession, texts: dict[str, str], part: int) -> None:
        if sum(len(t.split()) for t in texts.values()) > MOST_WORDS:
            raise ValueError("the templates are too large to broadcast")
        rows = spark.createDataFrame(list(texts.items()), "name string, text string")
        words = _words(F.col("text"))
        made = rows.select("name", words.alias("w"), let(words, _pairs).alias("p"), _bands(let(words, _pairs), 1).alias("b"))
        pairs, keys = [], []
        for r in made.collect():
            place: dict[int, int] = {}
            for i, p in enumerate(r.p):
                place.setdefault(p, i)
            pairs += [(r.name, len(place), len(r.p), p, i) for p, i in place.items()]
            if len(r.w) <= SHORT:
                needed = -(-part * len(place) // 100)
                letters = {p: len(r.w[i]) + len(r.w[i + 1]) for p, i in place.items()}
                longest = sorted(place, key=lambda p: (-letters[p], place[p]))
                keys += [(r.name, p, True) for p in longest[: len(place) - max(needed, 1) + 1]]
            else:
                step = BANDS * (THINNED if len(r.w) > THIN else 1)
                keys += [(r.name, k, False) for at in range(0, len(r.b), step) for k in set(r.b[at : at + BANDS])]
        self.pairs = spark.createDataFrame(pairs, "name string, n_pairs int, length int, key bigint, place int")
        self.keys = spark.createDataFrame(sorted(set(keys)), "name string, key bigint, short boolean")
        self.short = sorted({k for _, k, short in keys if short})
        self.banded = sorted({k for _, k, short in keys if not short})


def _within(column: str, keys: list[int]) -> Column:
    """The elements of an array that are among the keys, each once."""
    if not keys:
        return F.array().cast("array<bigint>")
    listed = ", ".join(f"{k}L" for k in keys)
    return F.expr(f"array_distinct(filter({column}, k -> k IN ({listed})))")


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: dict[str, str] | None = None,
    part: int = 80,
) -> DataFrame:
    """One row per text and template found: doc_id, template, n_found and n_shingles
    (distinct shingles of the template, in the text and in all), first_word and past_word.

    A template is found if one stretch of the text, up to SPREAD times as long as the
    template, holds at least ``part`` of 100 of its distinct shingles. Of several stretches the
    fullest, then the shortest and then the first counts. Templates within a fuller match of
    another one are found as well. Null, empty and short texts have none. Every row is a text of
    its own, whether its id is null or repeated; other columns are not carried.
    """
    known = _Known(docs.sparkSession, TEMPLATES | whole_texts() if texts is None else texts, part)
    made = (
        docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
        .select("doc_id", "row", let(_words(F.col("t")), _pairs).alias("p"))
        .select("doc_id", "row", "p", _bands(F.col("p"), STRIDE).alias("b"))
        .select("doc_id", "row", "p", _within("p", known.short).alias("s"), _within("b", known.banded).alias("b"))
        .filter((F.size("s") > 0) | (F.size("b") > 0))
    )
    # what retrieves a template, then the places of all shingles
    kinds = F.concat(
        F.transform("s", lambda k: F.struct(k.alias("key"), F.lit(True).alias("short"), F.lit(None).cast("int").alias("at"))),
        F.transform("b", lambda k: F.struct(k.alias("key"), F.lit(False).alias("short"), F.lit(None).cast("int").alias("at"))),
        F.transform("p", lambda k, i: F.struct(k.alias("key"), F.lit(None).cast("boolean").alias("short"), i.alias("at"))),
    )
    looked = known.pairs.select("name", "key", F.lit(None).cast("boolean").alias("short"), "place").unionByName(
        known.keys.select("name", "key", "short", F.lit(None).cast("int").alias("place"))
    )
    sizes = known.pairs.select("name", "n_pairs", "length").distinct()
    enough = lambda n: 100 * n >= part * F.col("n_pairs")
    own = made.select("doc_id", "row", F.inline(kinds))
    met = (F.col("own.key") == F.col("of.key")) & F.col("own.short").eqNullSafe(F.col("of.short"))
    hit = F.when(F.col("place").isNotNull(), F.struct("place", "at"))
    group = ["row", "doc_id", "name"]
    retrieved = (
        own.alias("own")
        .join(F.broadcast(looked).alias("of"), met)
        .groupBy("row", "doc_id", "name")
        .agg(F.bool_or(F.col("own.short").isNotNull()).alias("retrieved"), F.collect_set(hit).alias("hits"))
        .filter("retrieved")
    )
    found = retrieved.join(F.broadcast(sizes), "name").filter(enough(F.size(F.array_distinct("hits.place"))))
    group += ["n_pairs", "length"]
    same = Window.partitionBy(*group, "place").orderBy("at")
    # A pair is the first of its shingle for all stretches that start after the one before and
    # reach it; sums over these intervals count the distinct shingles of each stretch.
    begin = F.greatest(F.lag("at").over(same) + 1, F.col("at") - SPREAD * F.col("length"))
    step = lambda *values: F.struct(
        *[v.cast("int").alias(n) for n, v in zip(("pos", "n", "reach", "start"), values)]
    )
    at, none = F.col("at"), F.lit(None)
    steps = F.inline(
        F.array(
            step(F.col("begin"), F.lit(1), at, none), step(at, F.lit(0), none, at), step(at + 1, F.lit(-1), none, none)
        )
    )
    passed = Window.partitionBy(*group).orderBy("pos")
    stretches = (
        found.select(*group, F.inline("hits"))
        .withColumn("begin", begin)
        .select(*group, steps)
        .withColumns({"n_found": F.sum("n").over(passed), "past": F.max("reach").over(passed) + 2})
        .filter("start is not null")
    )
    best = F.max(F.struct("n_found", (F.col("start") - F.col("past")).alias("a"), (-F.col("start")).alias("b")))
    return (
        stretches.groupBy(*group)
        .agg(best.alias("m"))
        .filter(enough(F.col("m.n_found")))
        .select(
            "doc_id",
            F.col("name").alias("template"),
            F.col("m.n_found").cast("bigint").alias("n_found"),
            F.col("n_pairs").cast("bigint").alias("n_shingles"),
            (-F.col("m.b")).cast("bigint").alias("first_word"),
            (-F.col("m.b") - F.col("m.a")).cast("bigint").alias("past_word"),
        )
    )
