"""License scans by diagonal voting, in DataFrame operations only.

Every word pair of every text meets the pairs of the templates by an equi join on a hash; equal words, and the next
word for longer templates, confirm a hit. Hits of a template at the same offset of text and template are votes of a
diagonal, kept as a bit mask for each stretch of places of the template, so votes are summed up before the shuffle and a
template may have any length. Diagonals near each other belong to one copy with a word more or less and are merged;
the share of the template's grams that a span holds verifies it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters between words; a word is a run of ASCII letters and digits and of characters beyond ASCII.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases (fixed values) whose every place counts, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Sentences of licenses and notices with their labels; ``scan`` takes any list, whole licenses too.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Diagonals at most this far apart are one copy.
DRIFT = 3
#: Share of a notice's grams that a span must hold.
COVERAGE = 0.7

#: Places of a template whose votes share a mask.
STRETCH = 62


def template_rows(phrases: dict[str, str], notices: list[tuple[str, str]]) -> list[tuple]:
    """Words, template, label, whether a phrase, place and number of grams of each gram of each template."""
    rows = []
    entries = [(label, text.split(), 2) for text, label in phrases.items()] + [(label, text.split(), 3) for label, text in notices]
    for number, (label, words, k) in enumerate(entries):
        if len(words) < k:
            raise ValueError(f"a template has at least {k} words: {' '.join(words)}")
        for i in range(len(words) - k + 1):
            rows.append((words[i], words[i + 1], words[i + 2] if k == 3 else None, number, label, k == 2, i, len(words) - k + 1))
    return rows


def templates(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """One row for each gram of each template, with the hash of its first two words."""
    schema = "w1 string, w2 string, w3 string, template int, label string, phrase boolean, place int, grams int"
    return spark.createDataFrame(template_rows(phrases, notices), schema).withColumn("pair", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str]] = NOTICES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document of ``docs``.

    docs: doc_id, text. A null text is empty. ``score`` is the largest share of a template that a span holds: 1 for a
    phrase. Labels are empty strings where there are none. Rows that repeat id and text are one document; null ids
    stay null; an empty table gives an empty result; other columns are ignored.
    """
    known = F.broadcast(templates(docs.sparkSession, phrases, notices))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = F.contains("text", F.lit("K")) | F.contains("text", F.lit("İ"))
    words = F.split(F.lower(F.when(odd, F.regexp_replace("text", "[Kİ]", "é")).otherwise(F.col("text"))), GAPS, -1)
    base = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), words.alias("words"))
    lead = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("words") > 1) & (F.get("words", F.size("words") - 1) == ""), 1).otherwise(0)
    placed = base.withColumns({"lead": lead, "n_words": F.size("words") - lead - tail})
    at = F.explode(F.sequence(F.col("lead"), F.greatest(F.col("lead"), F.col("lead") + F.col("n_words") - 2)))
    word = [F.coalesce(F.get("words", F.col("at") + i), F.lit("")) for i in range(3)]
    grams = placed.select("doc_id", "digest", "n_words", "lead", "words", at.alias("at")).select(
        "doc_id", "digest", "n_words", (F.col("at") - F.col("lead")).alias("at"), F.xxhash64(word[0], word[1]).alias("pair"), *[w.alias(f"d{i}") for i, w in enumerate(word)]
    )
    hit = (grams["pair"] == known["pair"]) & (F.col("d0") == F.col("w1")) & (F.col("d1") == F.col("w2")) & (F.col("w3").isNull() | (F.col("d2") == F.col("w3")))
    doc = ["doc_id", "digest"]
    votes = (
        grams.join(known, hit, "left")
        .withColumn("stretch", F.floor(F.col("place") / STRETCH))
        .groupBy(*doc, "n_words", "template", "label", "phrase", "grams", (F.col("at") - F.col("place")).alias("diagonal"), "stretch")
        .agg(F.bit_or(F.expr(f"shiftleft(1L, place % {STRETCH})")).alias("mask"))
    )
    near = Window.partitionBy(*doc, "template").orderBy("diagonal", "stretch")
    drift = F.when(F.col("phrase"), 0).otherwise(DRIFT)
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= drift, 0).otherwise(1)
    spans = (
        votes.withColumn("apart", apart)
        .withColumn("copy", F.sum("apart").over(near.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*doc, "n_words", "template", "label", "phrase", "grams", "copy", "stretch")
        .agg(F.bit_count(F.bit_or("mask")).alias("held"), F.min("diagonal").alias("start"))
        .groupBy(*doc, "n_words", "template", "label", "phrase", "grams", "copy")
        .agg(F.sum("held").alias("held"), F.min("start").alias("start"))
        .withColumn("share", F.col("held") / F.col("grams"))
        .withColumn("base", F.col("phrase") & (F.col("share") == 1))
        .withColumn("found", F.col("base") | (~F.col("phrase") & (F.col("share") >= coverage)))
    )
    start = F.when(F.col("base"), F.col("start")).cast("long")

    def joined(condition: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col(condition), F.col("label")))), ",")

    return (
        spans.groupBy(*doc, "n_words")
        .agg(
            F.coalesce(F.sum(F.col("base").cast("long")), F.lit(0).cast("long")).alias("n_base"),
            F.min(start).alias("first_word"),
            F.max(start).alias("last_word"),
            joined("base").alias("base_labels"),
            joined("found").alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .select("doc_id", F.col("n_words").cast("long"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )
