"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment over the whole text decides.

Everything is a DataFrame function.  A text is its sequence of hashed five-word shingles.
Windows of 1, 2 or 4 shingles begin at every shingle; a template of n shingles is indexed by
all its windows of the largest such length that is not above n.  A window has ``BANDS`` bands of
one MinHash each: the minimum of its shingles under a hash of its own.  A text and a template that share a band of a window are compared:
what the passages of the text hold of the template is merged as a set, which is never larger
than the template, and counted after that.

A text holds a template if it contains 0.8 of its shingles, wherever they stand in it.  As many shingles in a
row as a window has are retrieved for certain, since equal windows have equal minima.  In the worst case
all shingles stand alone, each among others that the template does not have.  The minimum of a template's window is then
that of a window of the text with probability 5/6 for windows of two, 11/14 for four.  Templates of two or
three shingles must have all of them, and are missed by all eight bands with (1/6)^8 = 0.0000006; a longer one has
a window of which three of four are there, and is missed with at most (1 - 3/4 * 11/14)^8 = 0.0008.

Long texts are cut into passages only to bound what is in memory: every word, window and shingle that a
template can have is whole in some passage, and no cut makes words or shingles of its own.
"""

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtrace.llm.common import table

WORDS = 5
BANDS = 8
LENGTHS = (1, 2, 4)
#: Longer texts are read in passages of so many characters.
PASSAGE = 1 << 18
#: Up to so many shingles the index is part of the plan and sent to all tasks; a larger one is joined like any table.
SMALL_INDEX = 20_000

# Well-known notices, as they are usually written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]+"
NO_WORD_PATTERN = r"[^\p{L}\p{M}\p{N}_]+"


def bound(value: Column, function) -> Column:
    """The function of a value that is computed once, however often the function uses it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def shingles(text: Column, whole: Column | None = None) -> Column:
    """Hashes of the runs of five words, in order; one run of all words if a whole text has fewer, none without words."""
    hashes = F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1)), lambda word: F.xxhash64(word))
    run = lambda w: (
        F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])))
        .when((F.size(w) > 0) & (F.lit(True) if whole is None else whole), F.array(F.xxhash64(w)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return bound(hashes, run)


def window_keys(runs: Column | str, places: Column | str, lengths: list[int]) -> Column:
    """The distinct band minima of all windows of the lengths that hold one of the places of the sequence.

    A window of one shingle needs one band; a sequence shorter than a window is one window.
    """
    bands = F.array(*[F.lit(x) for x in range(BANDS)])

    def of_length(length: int) -> Column:
        if length == 1:
            return F.transform(places, lambda p: F.get(runs, p))
        last = F.greatest(F.size(runs) - length, F.lit(0))
        around = F.transform(places, lambda p: F.array(*[F.least(F.greatest(p - j, F.lit(0)), last) for j in range(length)]))
        lowest = lambda start: F.transform(bands, lambda band: F.array_min(F.transform(F.slice(runs, start + 1, length), lambda x: F.xxhash64(x, band))))
        return F.flatten(F.transform(F.array_distinct(F.flatten(around)), lowest))

    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))


def all_places(runs: Column | str) -> Column:
    return F.transform(runs, lambda _, i: i)


def template_keys(known: DataFrame) -> DataFrame:
    """(license, key): the band minima of each template's windows of its own length."""
    parts = []
    for n, above in zip(LENGTHS, [*LENGTHS[1:], 1 << 30], strict=True):
        own = known.filter((F.size("runs") >= n) & (F.size("runs") < above)).withColumn("places", all_places("runs"))
        parts.append(own.select("license", F.explode(window_keys("runs", "places", [n])).alias("key")))
    return reduce(DataFrame.unionByName, parts).distinct()


def written(rows: DataFrame) -> DataFrame:
    """The rows as part of the plan."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def passages(texts: DataFrame, overlap: int) -> DataFrame:
    """(id, row, piece, whole): the texts of (id, row, text), those longer than ``PASSAGE`` and the overlap in overlapping pieces.

    Of a longer text the words stand in lower case with one blank between them, so that the length of a shingle is bounded;
    a word that a piece holds only in part is left out of that piece.
    """
    whole = F.length("text") <= PASSAGE + overlap
    words = F.trim(F.regexp_replace(F.lower("text"), NO_WORD_PATTERN, " "))
    texts = texts.withColumn("text", F.when(whole, F.col("text")).otherwise(words))
    last = F.when(whole, F.lit(0)).otherwise(F.floor((F.length("text") - 1) / PASSAGE).cast("int"))
    parts = texts.select("id", "row", "text", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    # a blank before the first and behind the last word of the text; what stands before the first blank of a piece and behind its last is cut off
    cut = F.substring(F.concat(F.lit(" "), "text", F.lit(" ")), F.col("part") * PASSAGE + 1, F.lit(PASSAGE + overlap))
    cut = F.regexp_replace(F.regexp_replace(cut, "^[^ ]++", ""), "(?<= )[^ ]++$", "")
    return parts.select("id", "row", F.when(whole, F.col("text")).otherwise(cut).alias("piece"), whole.alias("whole"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, runs): the shingles of each template, in order."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    return rows.select("license", shingles(F.col("text")).alias("runs"))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, license, n_shingles, n_found, containment): one row per id and template of which the text holds enough.

    Case, punctuation and line breaks do not matter.  Null and empty texts hold nothing.  Rows with the same id, null ids
    too, are reported together with the best containment of one of them.  Counts are of distinct shingles over the whole text at any
    length.  Other columns are not read.  Templates without words match nothing.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if not templates:
        templates = {"": ""}
    overlap = 4 * max(len(t) for t in templates.values()) + 1000

    # the templates are an argument, so what is made of them is as bounded as they are; it is made once
    known = written(template_table(spark, templates))
    wanted = known.select("license", F.array_distinct("runs").alias("wanted"))
    index = wanted.select("license", F.size("wanted").alias("n_shingles"), F.explode("wanted").alias("run"))
    windows = written(template_keys(known))
    small = sum(len(re.findall(r"\w+", t)) for t in templates.values()) <= SMALL_INDEX

    # rows of the same id and text hold the same, so the text's digest stands for the row
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), text.alias("text")).select("id", "text", F.md5("text").alias("row"))
    entries = index.select("license", "n_shingles", F.col("run").alias("key"), F.lit(False).alias("band")).unionByName(
        windows.withColumn("band", F.lit(True)), allowMissingColumns=True,
    )
    if small:
        fixed, keys = (F.lit(sorted(r[0] for r in t.distinct().collect())).cast("array<bigint>") for t in (index.select("run"), windows.select("key")))
        entries = F.broadcast(entries)
        # a minimum that a template has is one of its shingles, so windows without any of them have no indexed key
        places = lambda runs, held: F.filter(F.transform(runs, lambda x, i: F.when(F.array_contains(held, x), i)), lambda p: p.isNotNull())
        held_of = lambda runs: F.array_intersect(runs, fixed)
        met_of = lambda runs, held: F.array_intersect(bound(places(runs, held), lambda p: window_keys(runs, p, list(LENGTHS))), keys)
    else:
        held_of = F.array_distinct
        met_of = lambda runs, held: window_keys(runs, all_places(runs), list(LENGTHS))
    tagged = lambda values, band: F.transform(values, lambda x: F.struct(x.alias("key"), F.lit(band).alias("band")))
    both = lambda runs, held: F.concat(tagged(held, False), tagged(met_of(runs, held), True))
    none = F.array().cast("array<struct<key: bigint, band: boolean>>")
    # one expression from the words to the keys: columns of their own would be put into one another by the optimizer and computed again for each use
    of_runs = lambda runs: bound(held_of(runs), lambda held: F.when(F.size(held) > 0, both(runs, held)).otherwise(none))
    asked = passages(texts, overlap).select("id", "row", F.explode(bound(shingles(F.col("piece"), F.col("whole")), of_runs)).alias("entry"))
    found = asked.select("id", "row", "entry.key", "entry.band").join(entries, ["key", "band"])
    merged = found.groupBy("id", "row", "license").agg(
        F.max("n_shingles").alias("n_shingles"), F.size(F.collect_set(F.when(~F.col("band"), F.col("key")))).alias("n_found"), F.max("band").alias("retrieved"),
    )
    enough = merged.filter(F.col("retrieved") & (F.col("n_found") >= F.lit(least) * F.col("n_shingles")))
    best = enough.groupBy("id", "license").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))
    return best.select(F.col("id").alias(id_column), "license", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-known notices that each document holds; null and empty texts hold none, rows of one id count as their best."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op4_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in sorted(TEMPLATES.items()))
    return f"""
WITH templates(license, text) AS (VALUES {values}),
both_kinds AS (
    SELECT license, NULL::BIGINT AS doc_id, regexp_extract_all(lower(text), '{WORD_PATTERN}') AS words FROM templates
    UNION ALL
    SELECT NULL, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_PATTERN}') FROM documents
), runs AS (
    SELECT license, doc_id, array_to_string(words[i:i + {WORDS - 1}], ' ') AS run
    FROM (SELECT license, doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 1}, least(len(words), 1)) + 1)) AS i FROM both_kinds)
), wanted AS (
    SELECT DISTINCT license, run FROM runs WHERE license IS NOT NULL
), sizes AS (
    SELECT license, count(*) AS n FROM wanted GROUP BY license
), found AS (
    SELECT d.doc_id, w.license, count(DISTINCT w.run) AS n
    FROM runs d JOIN wanted w ON d.run = w.run WHERE d.license IS NULL GROUP BY d.doc_id, w.license
)
SELECT f.doc_id, f.license, s.n::INTEGER AS n_shingles, f.n::INTEGER AS n_found, f.n / s.n AS containment
FROM found f JOIN sizes s USING (license) WHERE f.n >= 0.8 * s.n
"""


OP4_SQL = _op4_sql()
