"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of s shingles (runs of five words, or of all its words if there are fewer) is looked for in windows of 2 s
shingles, one every s, so that any s shingles in a row lie whole in a window. A window that holds ``containment`` of the
template has at least a Jaccard similarity j = q s / (2 s + (1 - q) s) with it; with one row to a band, b bands meet with
probability 1 - (1 - j)^b, and b is set so that this is ``1 - miss`` at least. Windows without any of a few telling words
are left out first: the words are chosen so that more than 1 - q of each template's shingles hold one, so that no window
that could reach the containment is lost. All of it is DataFrame operations; templates are a bounded table.

Defined results: a null or blank text has no match; rows that share an id are reported together; a window is compared
as a set, so repeated shingles count once; extra columns are not looked at; an empty table gives an empty one. Words
are runs of letters and digits, in lower case.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: The wording of well-known public notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}
WIDTH = 5


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def shingle_set(words: list[str]) -> tuple[int, list[str]]:
    """(width, distinct shingles) of a template."""
    width = min(WIDTH, len(words))
    return width, list(dict.fromkeys(" ".join(words[i : i + width]) for i in range(len(words) - width + 1)))


def telling_words(templates: dict[str, str], containment: float) -> list[str]:
    """Few words such that more than 1 - containment of each template's shingles hold one of them; long words and words
    of many templates first."""
    sets = {k: shingle_set(template_words(t))[1] for k, t in templates.items()}
    spread = Counter(w for s in sets.values() for w in {w for x in s for w in x.split()})
    order = sorted(spread, key=lambda w: (-min(len(w), 7), -spread[w], w))
    chosen: list[str] = []

    def lacks(s):
        return sum(any(w in x.split() for w in chosen) for x in s) <= (1 - containment) * len(s)

    while any(lacks(s) for s in sets.values()):
        open_ = [s for s in sets.values() if lacks(s)]
        chosen.append(max((w for w in order if w not in chosen), key=lambda w: (min(len(w), 6), sum(any(w in x.split() for x in s) for s in open_))))
    return [w for w in chosen if any(w in x.split() for s in sets.values() for x in s)]


def bands_for(size: int, containment: float, miss: float) -> int:
    j = containment * size / (2 * size + (1 - containment) * size)
    return math.ceil(math.log(miss) / math.log(1 - j))


def minhashes(shingles, bands: int):
    """One min-hash for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, i))))


def shingles_of(words, width):
    """Distinct shingles of a window's words; ``width`` is a column."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.array_join(F.slice(words, i, width), " ")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 1e-4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, license, containment, n_windows, first_word): the templates that each document holds, with the largest
    containment, the number of windows that reach it and the first word of the first one."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    tell = telling_words(templates, containment)
    made = [(name, *shingle_set(template_words(t))) for name, t in templates.items()]
    rows = [(name, width, len(s), s) for name, width, s in made if s]
    table = spark.createDataFrame(rows, "license string, width int, n int, shingles array<string>")
    bands = max(bands_for(n, containment, miss) for _, _, n, _ in rows)
    known = table.select("license", "width", "n", "shingles", F.posexplode(minhashes(F.col("shingles"), bands)).alias("band", "hash"))

    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    some = F.lit(False)
    for w in tell:
        some = some | F.contains("lower", F.lit(w))
    words = docs.select(F.col(key), lower.alias("lower")).where(some).select(key, F.split(F.trim(F.regexp_replace("lower", r"[^\p{L}\p{N}]+", " ")), " ").alias("words"))
    kinds = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(n).alias("n")) for w, n in sorted({(w, n) for _, w, n, _ in rows})])
    told = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(tell))
    # written: the few texts that hold a telling word, so that their words are made once and not in every expression
    words = store(words, "license-words").withColumn("told", told)
    words = store(words.where(F.size("told") > 0), "license-told")

    def windows(kind):
        width, n = kind["width"], kind["n"]
        last = F.greatest(F.floor((F.size("words") - width) / n), F.lit(0)).cast("int")
        near = F.flatten(F.transform("told", lambda i: F.sequence(F.greatest(F.floor((i - width + 1) / n) - 1, F.lit(0)).cast("int"), F.floor(i / n).cast("int"))))
        ks = F.filter(F.array_distinct(near), lambda k: k <= last)
        return F.transform(ks, lambda k: F.struct(width.alias("width"), n.alias("n"), (k * n).alias("at"), F.slice("words", k * n + 1, 2 * n + width - 1).alias("own")))

    spread = words.select(key, F.explode(F.flatten(F.transform(kinds, windows))).alias("w")).select(key, "w.width", "w.n", "w.at", "w.own").where(F.size("own") >= F.col("width"))
    spread = spread.select(key, "width", "n", "at", shingles_of(F.col("own"), F.col("width")).alias("own"))
    hashed = spread.select(key, "width", "n", "at", "own", F.posexplode(minhashes(F.col("own"), bands)).alias("band", "hash"))
    met = hashed.join(F.broadcast(known), ["width", "n", "band", "hash"])  # templates times bands: a bounded table
    met = met.select(key, "license", "at", (F.size(F.array_intersect("own", "shingles")) / F.col("n")).alias("share")).where(F.col("share") >= containment)
    met = met.dropDuplicates([key, "license", "at"])
    best = met.groupBy(key, "license").agg(F.max("share").alias("containment"), F.count("*").alias("n_windows"), F.min("at").cast("long").alias("first_word"))
    return best


def oracle(table: str = "documents", templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """The same as SQL that compares every window with every template."""
    templates = TEMPLATES if templates is None else templates
    values = []
    for name, t in templates.items():
        width, s = shingle_set(template_words(t))
        values += [f"('{name}', {width}, {len(s)}, '{x}')" for x in s]
    return f"""
WITH t(license, width, n, shingle) AS (VALUES {", ".join(values)}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM {table}),
p AS (SELECT doc_id, words, unnest(range(0, len(words))) AS pos FROM w),
s AS (SELECT doc_id, pos, width, array_to_string(words[pos + 1 : pos + width], ' ') AS shingle
      FROM p, (SELECT DISTINCT width FROM t) WHERE pos + width <= len(words)),
h AS (SELECT doc_id, pos, t.* FROM s JOIN t USING (width, shingle)),
k AS (SELECT *, unnest([pos // n, pos // n - 1]) AS k FROM h),
c AS (SELECT doc_id, license, k, n, count(DISTINCT shingle) / n::DOUBLE AS share FROM k WHERE k >= 0 GROUP BY doc_id, license, k, n)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, min(k * n)::BIGINT AS first_word
FROM c WHERE share >= {containment} GROUP BY doc_id, license"""
