"""License scans with MinHash bands over overlapping text windows [DataFrame operations only].

Texts and templates are cut into words (runs of letters and digits, lower
case) and shingles of five words. Templates are classed by their number of
shingles: class c has more than 2^(c-1) and at most 2^c. For each class a text
is cut into windows of 2^(c+1) shingles that overlap by half, so every place
where a template can stand lies whole in one window.

A window that holds four fifths of a template's shingles is like it by at
least 0.4 / 2.1 = 0.19 (Jaccard). With ``BANDS`` = 64 bands of one MinHash
value each, such a window shares a band with the template with probability
1 - (1 - 0.19)^64 > 0.99999. Band matches are candidates only: a match counts
if at least ``LEAST`` of the template's shingles stand in the window, compared
as texts.

A window without any shingle of any template shares no band with one, so only
windows around such shingles are signed; the others are left out before the
costly part. The templates' band table is bounded by the template list and is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, small_table, text_or_empty

SHINGLE = 5
BANDS = 64
LEAST = 0.8

#: Public license notices (fixed values): identifier and text.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text_words: Column) -> Column:
    """The word shingles of an array of words, as texts (fewer words than a shingle: one of all; none: none)."""
    def of(w):
        n = F.size(w)
        made = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))),
                           lambda i: F.array_join(F.slice(w, i, F.least(n, F.lit(SHINGLE))), " "))
        return F.when(n > 0, made).otherwise(F.array().cast("array<string>"))

    return bound(text_words, of)


def hashed(texts: Column) -> Column:
    return F.transform(texts, lambda s: F.xxhash64(s))


def bands(all_hashes: Column) -> Column:
    """The MinHash value of each band of an array of shingle hashes."""
    return bound(all_hashes, lambda hashes: F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, band)))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, cls, shingles, n, values): one row per template, a table as long as the list."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates)]
    made = small_table(spark, rows, "template int, license string, notice string")
    made = made.select("template", "license", F.array_distinct(shingles(words(F.col("notice")))).alias("shingles"))
    return (made.withColumn("n", F.size("shingles")).withColumn("cls", F.ceil(F.log2("n")).cast("int"))
            .withColumn("values", bands(hashed(F.col("shingles")))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word, n_words, found): one row for each document and license found.

    ``containment`` is the largest share of a template's shingles in one window,
    ``first_word`` (from 0) and ``n_words`` say which window, ``found`` is its
    text in normal form. Null texts, texts without words and texts without a
    license have no row. Rows that repeat an id count as one document. An empty
    table gives no rows; other columns are not looked at.
    """
    spark = df.sparkSession
    known = template_table(spark, templates)
    # Both as long as the template list.
    classes = sorted(r["cls"] for r in known.select("cls").distinct().collect())
    own = [r["h"] for r in known.select(F.explode(hashed(F.col("shingles"))).alias("h")).distinct().collect()]

    base = df.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    def positions(h):
        return F.filter(F.transform(h, lambda x, i: F.when(x.isin(own), i).otherwise(-1)), lambda i: i >= 0)

    hits = bound(hashed(shingles(F.col("w"))), positions)
    near = base.withColumn("hits", hits)  # a text without hits has no windows below

    def windows(cls):
        step, size = 1 << cls, 1 << (cls + 1)
        starts = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.array(
            F.floor(p / step).cast("int"), F.greatest(F.floor(p / step).cast("int") - 1, F.lit(0))))))
        return F.transform(starts, lambda s: F.struct(
            F.lit(cls).alias("cls"), (s * step).alias("first_word"),
            F.slice("w", s * step + 1, size + SHINGLE - 1).alias("words")))

    cut = near.select("doc_id", F.explode(F.concat(*[windows(c) for c in classes])).alias("x")).select("doc_id", "x.*")
    signed = cut.withColumn("own", shingles(F.col("words"))).withColumn(
        "value", F.explode(F.array_distinct(F.transform(bands(hashed(F.col("own"))),
                                                        lambda v, i: F.struct(i.alias("band"), v.alias("v"))))))
    table = F.broadcast(known.select("template", "cls", F.posexplode("values").alias("band", "v")))
    retrieved = (signed.select("doc_id", "cls", "first_word", "words", "own", "value.band", "value.v")
                 .join(table, ["cls", "band", "v"])
                 .groupBy("doc_id", "first_word", "words", "template").agg(F.first("own").alias("own")))
    verified = retrieved.join(F.broadcast(known.select("template", "license", "shingles", "n")), "template").select(
        "doc_id", "license", "first_word", "words",
        (F.size(F.array_intersect("shingles", "own")) / F.col("n")).alias("containment"))
    best = F.max(F.struct("containment", (-F.col("first_word")).alias("before"), (-F.size("words")).alias("short"),
                          F.array_join("words", " ").alias("found")))
    return (verified.where(F.col("containment") >= LEAST).groupBy("doc_id", "license").agg(best.alias("b"))
            .select("doc_id", "license", F.col("b.containment").alias("containment"),
                    (-F.col("b.before")).alias("first_word"), (-F.col("b.short")).alias("n_words"),
                    F.col("b.found").alias("found")))
