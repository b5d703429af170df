"""License scans: base phrases, and diagonal voting against license templates.

The rolling word k-grams of every whole text are hashed and joined to the positions of
the same k-grams in the templates; hashes that no template has are left out before, and a
match has to agree word by word, so a chance hash never votes.  A match votes for the diagonal ``position in text -
position in template``.  Votes are summed by diagonal, neighbouring diagonals (words
put in or left out) are merged, and a merged span is verified: it has to hold enough of
the template's k-grams in not too many words.  The template table is broadcast: its
size is that of the template list, not of the data.

Votes are keyed by a 96-bit fingerprint of the text, so copies vote once and a large
group of copies is one key.

Defined results: a null text is empty (no words, no labels, score 0); texts shorter
than a k-gram have base phrases only; a very long text is scanned whole in its row; repeated rows stay; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
K = 3
#: Diagonals this close are one alignment.
MAX_SHIFT = 4
#: A span holds this share of the template's k-grams, in at most this many times its words.
MIN_COVERAGE = 0.6
MAX_STRETCH = 1.5
#: Fixed values: (label, notice) of widely used public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def normalised(text: Column) -> Column:
    """The words of a text joined by single spaces.

    ``lower`` differs from lower-casing A-Z only outside ASCII, and no phrase or
    template has words that come from there (the Kelvin sign is kept apart below).
    """
    kept = F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å"))
    return F.btrim(F.regexp_replace(F.lower(kept), SEPARATORS, " "))


def _split(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def phrase_places(norm: Column, phrases=PHRASES) -> Column:
    """array<struct<at, label>>: all places where a phrase's words stand consecutively."""
    kind = "array<struct<at:int,label:string>>"

    def places(w: Column) -> Column:
        every = []
        for phrase, label in phrases:
            parts = phrase.split()
            stands = lambda i, parts=parts: F.when(
                F.get(w, i) == parts[0], F.array_join(F.slice(w, i + 1, len(parts)), " ") == " ".join(parts)
            ).otherwise(F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(w) - 1), _one_argument(stands))
            every.append(F.transform(found, _labelled(label)))
        return F.concat(*every)

    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    any_phrase = F.lit(False)
    for phrase, _ in phrases:
        any_phrase = any_phrase | F.contains(padded, F.lit(f" {phrase} "))
    return F.when(any_phrase, let(_split(norm), places)).otherwise(F.array()).cast(kind)


def _one_argument(f):
    return lambda i: f(i)


def _labelled(label: str):
    return lambda i: F.struct(i.alias("at"), F.lit(label).alias("label"))


def _text_key() -> tuple[Column, Column]:
    t = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(t).alias("k1"), F.crc32(t.cast("binary")).alias("k2")


def _gram_hashes(words: Column, k: int) -> Column:
    def grams(h: Column) -> Column:
        last = F.size(h) - k
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[h.getItem(i + j) for j in range(k)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), grams)


def template_positions(spark, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram, words, template, tpos, label, n_grams, n_words): a row per k-gram of a template."""
    rows = [(n, label, " ".join(template_words(text))) for n, (label, text) in enumerate(templates)]
    df = spark.createDataFrame(rows, "template int, label string, norm string")
    n_words = F.size(F.split("norm", " "))
    return df.select(
        "template",
        "label",
        n_words.alias("n_words"),
        (n_words - k + 1).alias("n_grams"),
        F.split("norm", " ").alias("w"),
        F.posexplode(_gram_hashes(F.split("norm", " "), k)).alias("tpos", "gram"),
    ).withColumn("words", F.array_join(F.slice("w", F.col("tpos") + 1, k), " ")).drop("w")


def vote(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """Verified spans: (k1, k2, template, label, start, end, coverage), words from 0, end exclusive."""
    positions = template_positions(docs.sparkSession, templates, k)
    known = [r["gram"] for r in positions.select("gram").distinct().collect()]  # bounded by the template list

    def held(w: Column) -> Column:
        every = F.transform(_gram_hashes(w, k), lambda g, i: F.struct(g.alias("gram"), i.alias("pos")))
        some = F.filter(every, lambda x: x["gram"].isin(known))
        return F.transform(some, lambda x: F.struct(x["gram"], x["pos"], F.array_join(F.slice(w, x["pos"] + 1, k), " ").alias("words")))

    grams = docs.select(*_text_key(), F.explode(let(_split(normalised(F.col("text"))), held)).alias("x")).select("k1", "k2", "x.*")
    key = ["k1", "k2", "template", "label", "n_words", "n_grams"]
    # the template list bounds this broadcast: one row per k-gram of a template
    votes = grams.join(F.broadcast(positions), ["gram", "words"]).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    diagonals = votes.groupBy(*key, "diagonal").agg(
        F.collect_set("tpos").alias("held"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    along = W.partitionBy(*key).orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(along)) > MAX_SHIFT
    merged = (
        diagonals.withColumn("_new", F.coalesce(far, F.lit(False)).cast("int"))
        .withColumn("alignment", F.sum("_new").over(along))
        .groupBy(*key, "alignment")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"),
            F.min("first").alias("start"),
            (F.max("last") + k).alias("end"),
        )
        .withColumn("coverage", F.col("n_held") / F.col("n_grams"))
    )
    fits = (F.col("coverage") >= MIN_COVERAGE) & (F.col("end") - F.col("start") <= F.col("n_words") * MAX_STRETCH + K)
    return merged.where(fits).select("k1", "k2", "template", "label", "start", "end", "coverage")


def op7_licenses(docs: DataFrame) -> DataFrame:
    """Base phrases and voted labels of every document."""
    docs = docs.select("doc_id", "text")
    per_text = (
        vote(docs)
        .groupBy("k1", "k2")
        .agg(F.collect_set("label").alias("_voted"), F.max("coverage").alias("_coverage"))
        .withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    )
    norm = normalised(F.col("text"))
    base = docs.select(
        "doc_id",
        *_text_key(),
        let(
            norm,
            lambda n: F.struct(
                F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
                phrase_places(n).alias("places"),
            ),
        ).alias("_b"),
    )
    joined = base.join(per_text, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    at = F.transform("_b.places", lambda p: p["at"])
    labels = F.array_distinct(F.transform("_b.places", lambda p: p["label"]))
    join = lambda c: F.array_join(F.sort_array(c), ",")
    every = F.array_distinct(F.concat(labels, F.coalesce("_voted", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        F.col("_b.n_words").alias("n_words"),
        F.size("_b.places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        join(labels).alias("base_labels"),
        join(every).alias("labels"),
        F.when(F.size("_b.places") > 0, 1.0).otherwise(F.coalesce("_coverage", F.lit(0.0))).alias("score"),
    )
