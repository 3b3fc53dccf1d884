"""License scans by diagonal voting, in DataFrame functions only.

The rolling word k-grams of all texts are hashed and joined with the positions at which
license templates hold the same k-gram.  Hits of one template lie on a diagonal
(place in the text less place in the template); a diagonal's votes are counted,
neighbouring diagonals (words put in or left out) are merged, and a merged span is
verified by the share of the template's words that it covers in order.

The template table's size is fixed by the templates, so it is broadcast; texts are read
once, and past the join only hits and one row per text are left to shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose words, in a row, give a label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Usual license notices, (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced"),
)


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def words_of(text: Column) -> Column:
    """A text's words with A-Z in lower case.

    ``lower`` also changes letters beyond A-Z, but no other letter of a phrase or template
    can come of it once the Kelvin sign, whose small letter is k, is replaced.
    """
    return F.filter(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u00ff"))), NOT_WORD), lambda w: w != "")


def _grams(words: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none of a shorter text."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    hashed = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...], k: int) -> DataFrame:
    """``gram, template, label, at, n_grams``: a row per k-gram of each template, hashed as the texts' are."""
    rows = [(i, label, template_words(text)) for i, (label, text) in enumerate(templates)]
    if any(len(x[2]) < k for x in rows):
        raise ValueError(f"a template has fewer than {k} words")
    table = spark.createDataFrame(rows, "template int, label string, words array<string>")
    return table.select("template", "label", (F.size("words") - k + 1).alias("n_grams"), F.posexplode(_grams(F.col("words"), k)).alias("at", "gram"))


def _phrase_starts(words: Column, phrase: str) -> Column:
    """The places where a phrase's words stand in a row."""
    first, *rest = phrase.split()

    def start(word: Column, i: Column) -> Column:
        here = word == first
        for j, other in enumerate(rest):
            here = here & F.coalesce(F.get(words, i + 1 + j) == other, F.lit(False))
        return F.when(here, i)

    return F.filter(F.transform(words, start), lambda i: i.isNotNull())


def _phrases_in(rows: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds ``starts``, the places of each label's phrases; texts without the phrases' rarest words aren't searched."""
    labels = sorted(set(phrases.values()))
    none = F.array().cast("array<struct<label:string,starts:array<int>>>")
    named = F.lit(False)
    for word in sorted({p.split()[-1] for p in phrases}):
        named = named | F.array_contains("words", word)
    found = F.array(*[
        F.struct(F.lit(label).alias("label"), F.flatten(F.array(*[_phrase_starts(F.col("words"), p) for p, x in phrases.items() if x == label])).alias("starts"))
        for label in labels
    ]) if labels else none
    return rows.withColumn("found", F.when(named, F.filter(found, lambda x: F.size(x["starts"]) > 0)).otherwise(none))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    k: int = 3,
    drift: int = 2,
    least_share: float = 0.7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licenses named or quoted in every row's whole text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.
    n_base counts the places of all phrases, first_word and last_word are their least and
    greatest start (null without any); base_labels and labels are distinct, sorted and comma-joined,
    labels with those of the templates found; score is the best verified share of a template (1 for
    a phrase, 0 for neither); spans holds each span found: first and last word, label, template, share.
    Diagonals at most ``drift`` apart merge; a span needs ``least_share`` of its template's
    k-grams within half as many words again as the template has.  Of spans that overlap, those with
    the best share stay.

    Defined cases: a null or empty text has no words, empty labels and score 0; very long texts are scanned whole; repeated
    rows and equal ids get a result each; spans are ordered by place, label and template; an empty
    table gives an empty result; other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    # Rows are told apart by where they are read; nothing is joined back by it.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", words_of(F.col("text")).alias("words"))
    rows = _phrases_in(rows, phrases).withColumn("starts", F.flatten("found.starts"))
    rows = rows.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"), F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("found.label", ",").alias("base_labels"), _grams(F.col("words"), k).alias("grams"),
    )
    kept = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    places = rows.select(*kept, F.posexplode_outer("grams").alias("place", "gram"))
    # The table has as many rows as the templates have words, whatever the texts.
    hits = places.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), "gram", "left")
    # Of a text's first place one row stays even without a hit, for the text itself.
    hits = hits.filter(F.col("template").isNotNull() | (F.coalesce("place", F.lit(0)) == 0))
    diagonal = F.col("place") - F.col("at")
    voted = hits.groupBy("row", "template", F.when(F.col("template").isNotNull(), diagonal).alias("diagonal")).agg(
        *[F.first(c).alias(c) for c in [*kept[1:], "label", "n_grams"]], F.min("place").alias("start"), F.max("place").alias("stop"), F.collect_set("at").alias("ats")
    )
    return _judged(voted, kept, k, drift, least_share)


def _judged(voted: DataFrame, kept: list[str], k: int, drift: int, least_share: float) -> DataFrame:
    """Merge neighbouring diagonals of a text and template, verify the spans, gather them by text."""
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > drift).cast("int"), F.lit(1))
    merged = voted.withColumn("gap", gap).withColumn("run", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("ats"))))
    spans = merged.groupBy("row", "template", "run").agg(
        *[F.first(c).alias(c) for c in [*kept[1:], "label", "n_grams"]], F.min("start").alias("start"), (F.max("stop") + k - 1).alias("stop"), covered.alias("covered")
    )
    share = F.col("covered") / F.col("n_grams")
    close = (F.col("stop") - F.col("start") + 1) * 2 <= (F.col("n_grams") + k - 1) * 3
    spans = spans.withColumn("share", F.when(F.col("template").isNotNull() & (share >= least_share) & close, share))
    # Verified spans that overlap form an island, where the best share wins.
    by_place = Window.partitionBy("row").orderBy(F.col("share").isNull(), "start", "stop", "template")
    reach = F.max(F.when(F.col("share").isNotNull(), F.col("stop"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("island", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max("share").over(Window.partitionBy("row", "island"))
    won = F.when(F.col("share") == best, F.struct(F.col("start").alias("first"), F.col("stop").alias("last"), "label", "template", "share"))
    out = spans.withColumn("won", won).groupBy("row").agg(*[F.first(c).alias(c) for c in kept[1:]], F.sort_array(F.collect_list("won")).alias("spans"))
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    out = out.withColumns({
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("spans.label")))), ","),
        "score": F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0))),
    })
    return out.select(*kept[1:], "labels", "score", "spans")
