"""License scans by diagonal voting.

The rolling 2-gram hashes of all texts are joined to the positions of the same 2-grams in license
templates; the words are compared in the join, so every match is exact. Matches of a document and
template are counted per diagonal (text position minus template position). Neighbouring diagonals
are merged, which bridges inserted or dropped words, and a merged span is verified by the share of
the template's 2-grams it covers. Short phrases are templates that must be covered on one diagonal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwatch.llm.words import lower_ascii
from tarnwatch.session import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that must stand word by word. Fixed values.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Notices of public licenses as they stand in texts and source headers. Fixed values.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Licensed under the MIT License."),
    ("mit", "MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Templates the join may send to every task: all words of all templates stay below this bound.
MOST_TEMPLATE_WORDS = 100_000
#: Matches a diagonal needs to take part in a span; single common 2-grams don't tie spans together.
VOTES = 2
#: Diagonals this far apart belong to one span.
BAND = 3
#: Share of a template's 2-grams that a span must cover.
COVERAGE = 0.8


def template_positions(spark: SparkSession, phrases: dict[str, str], templates) -> DataFrame:
    """Rows ``template, label, phrase, grams, place, left, right``: the 2-grams of the templates."""
    rows = []
    named = [(label, text, True) for label, text in phrases.items()] + [(label, text, False) for label, text in templates]
    for number, (label, text, phrase) in enumerate(named):
        words = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        if len(words) < 2:
            raise ValueError("a template needs two words")
        rows += [(number, label, phrase, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATE_WORDS} template words")
    return spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, place int, left string, right string")


def license_spans(documents: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES,
                  band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: ``doc_id, text_hash, label, phrase, start, stop, score``.

    A phrase gives one span for each place it stands at; a template one for each merged group of
    diagonals. ``start`` and ``stop`` are word numbers from 0, ``score`` the covered share. Rows
    repeating both ``doc_id`` and text are found once.
    """
    text = lower_ascii(F.col("text").cast("string"))
    words = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
    )
    grams = words.where(F.size("words") > 1).select(
        "doc_id", "text_hash",
        F.posexplode(F.expr("arrays_zip(words, slice(words, 2, size(words) - 1))")).alias("at", "gram"),
    ).select("doc_id", "text_hash", "at", F.col("gram.words").alias("w"), F.col("gram.1").alias("next"))
    positions = template_positions(documents.sparkSession, phrases, templates)
    hashed = positions.withColumn("gram_hash", F.xxhash64("left", "right"))
    hits = (
        grams.withColumn("gram_hash", F.xxhash64("w", "next"))
        .join(F.broadcast(hashed), "gram_hash")
        .where((F.col("w") == F.col("left")) & (F.col("next") == F.col("right")))
        .withColumn("diagonal", F.col("at") - F.col("place"))
    )
    key = ["doc_id", "text_hash", "template", "label", "phrase", "grams"]
    # staged: phrases and templates both read it, and the texts are cut into words only once
    diagonals = stage(hits.groupBy(*key, "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last")
    ), "license-diagonals")
    exact = diagonals.where(F.col("phrase") & (F.size("places") == F.col("grams"))).select(
        "doc_id", "text_hash", "label", "phrase", F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("grams")).alias("stop"), F.lit(1.0).alias("score"),
    )
    order = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    merged = (
        diagonals.where(~F.col("phrase") & (F.size("places") >= F.least(F.lit(VOTES), F.col("grams"))))
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > band).cast("int"), F.lit(0)))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*key, "span")
        .agg(F.flatten(F.collect_list("places")).alias("places"), F.min("first").alias("start"), F.max("last").alias("last"))
        .withColumn("score", F.size(F.array_distinct("places")) / F.col("grams"))
        # a span longer than the template allows is made of scattered common words
        .where((F.col("score") >= coverage) & (F.col("last") - F.col("start") <= 2 * (F.col("grams") + 1)))
        .select("doc_id", "text_hash", "label", "phrase", "start", (F.col("last") + 1).alias("stop"), "score")
    )
    return exact.unionByName(merged)


def scan(documents: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base columns describe the places of phrases; ``labels`` adds those of template spans, ``score``
    is the best covered share (0 without a span).

    Defined cases: null text is empty and has no words; texts of one word have no 2-grams; rows
    repeating a ``doc_id`` with another text are scanned separately; an empty table gives an empty
    result; other columns are not read.
    """
    text = lower_ascii(F.col("text").cast("string"))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    joined = lambda labels: F.coalesce(F.concat_ws(",", F.sort_array(labels)), F.lit(""))
    found = license_spans(documents, **options).groupBy("doc_id", "text_hash").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    ).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
