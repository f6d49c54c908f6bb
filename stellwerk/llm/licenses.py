"""License scan by diagonal voting.

A document and a license text that say the same thing share word pairs at a constant offset:
on one diagonal. All rolling pairs of words are hashed and joined to the positions at which
templates have them; each hit votes for the diagonal (its word position less the template's).
Neighbouring diagonals are merged, so that a few words put in or left out do not split a
match, and a merged span counts if its hits, verified word by word, cover enough of the
template. The phrases of the base scan are templates whose whole diagonal must be there.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stellwerk.session import materialise

#: What a word is (once A-Z are lower-cased), and the base phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Usual wordings of licenses, as found in notices and file headers.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
        "mit",
    ),
    ("Licensed under the MIT License", "mit"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("licensed under the GNU General Public License, version 2", "gpl-2.0"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu"),
    ("under the terms of the GNU Lesser General Public License", "lgpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
    ("dedicated to the public domain under CC0 1.0 Universal", "cc0-1.0"),
)
#: Pairs of these alone say nothing about a license and do not vote (base phrases have none).
COMMON = frozenset("a an and any as at be by for from in is it of on or that the this to under with you".split())
#: Share of a template's voting pairs that a span must cover; diagonals at most this far apart are merged.
COVERAGE, NEIGHBOURS = 0.9, 2


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    base: bool
    pairs: tuple[tuple[int, str, str], ...]
    words: int


def templates(phrases: Sequence[tuple[str, str]] = PHRASES, texts: Sequence[tuple[str, str]] = TEMPLATES) -> list[Template]:
    """Templates with the positions of their voting pairs; each needs two words at least."""
    out = []
    for number, (text, label, base) in enumerate([*((t, k, True) for t, k in phrases), *((t, k, False) for t, k in texts)]):
        words = re.findall(WORD, text.lower())
        pairs = tuple(
            (i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if base or not (a in COMMON and b in COMMON)
        )
        if not pairs:
            raise ValueError(f"no pair of words votes for {text!r}")
        out.append(Template(number, label, base, pairs, len(words)))
    return out


def _positions(spark: SparkSession, known: Sequence[Template]) -> DataFrame:
    rows = [(t.number, t.base, t.label, len(t.pairs), t.words, i, a, b) for t in known for i, a, b in t.pairs]
    table = spark.createDataFrame(
        rows, "template int, base boolean, label string, pairs int, words int, at int, t1 string, t2 string"
    ).withColumn("gram", F.xxhash64("t1", "t2"))
    return F.broadcast(table) if len(rows) <= 20_000 else table


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _diagonals(docs: DataFrame, known: Sequence[Template]) -> DataFrame:
    """Votes: one row per document, template and diagonal, with the template positions that voted."""
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    listed = docs.select("id", "mark", words.alias("w")).where("size(w) > 1")
    pairs = listed.selectExpr("id", "mark", "posexplode(arrays_zip(w, slice(w, 2, size(w) - 1))) AS (pos, pair)")
    pairs = pairs.select("id", "mark", "pos", F.col("pair.w").alias("w1"), F.col("pair.1").alias("w2"))
    votes = (
        pairs.where("w2 IS NOT NULL")
        .withColumn("gram", F.xxhash64("w1", "w2"))
        .join(_positions(docs.sparkSession, known), "gram")
        .where("w1 = t1 AND w2 = t2")
    )
    # All grouping is within a document: one shuffle of the votes serves every step.
    return (
        votes.select("id", "mark", "template", "base", "label", "pairs", "words", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
        .repartition("id", "mark")
        .groupBy("id", "mark", "template", "base", "label", "pairs", "words", "diagonal")
        .agg(F.collect_set("at").alias("ats"))
    )


def _spans(diagonals: DataFrame) -> DataFrame:
    """Spans of merged diagonals: share of the template covered, and first and last word."""
    by = ["id", "mark", "template"]
    ordered = Window.partitionBy(*by).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(ordered)
    near = diagonals.withColumn("new", F.coalesce((gap > NEIGHBOURS).cast("int"), F.lit(1)))
    near = near.withColumn("span", F.sum("new").over(ordered))
    first, last = F.col("diagonal") + F.array_min("ats"), F.col("diagonal") + F.array_max("ats") + 1
    return near.groupBy(*by, "label", "base", "pairs", "words", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min(first).alias("first"),
        F.max(last).alias("last"),
    ).select("*", (F.col("covered") / F.col("pairs")).alias("share"))


def scan(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    texts: Sequence[tuple[str, str]] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """For every row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of base phrases, first_word and last_word are the first words of
    the first and last one (null without any). labels holds base labels and those of the
    templates found. spans lists what was found, base places included, as (label, first word,
    last word, share). score is the largest share of a template covered by one span, 0 without a
    hit. A null text has no words; repeated rows get equal results; other columns are not read.
    """
    known = templates(phrases, texts)
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("text"))
    # Few and small, and read twice below; written once, the texts are voted on once.
    diagonals = materialise(_diagonals(rows, known))
    place = (
        diagonals.where(F.col("base") & (F.size("ats") == F.col("pairs")))
        .select("id", "mark", "label", F.lit(True).alias("base"), F.col("diagonal").alias("first"),
                (F.col("diagonal") + F.col("words") - 1).alias("last"), F.lit(1.0).alias("share"))
    )
    span = _spans(diagonals.where("NOT base")).where("last - first < 1.5 * words").select(
        "id", "mark", "label", F.lit(False).alias("base"), "first", "last", "share"
    )
    found = F.col("base") | (F.col("share") >= COVERAGE)
    hits = place.union(span).groupBy("id", "mark").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set(F.when(found, F.col("label")))).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_set(F.when(found, F.struct("first", "last", "label", "share")))).alias("spans"),
    )
    counted = rows.select("id", "mark", F.regexp_count(lowered(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    hits = hits.withColumnRenamed("id", "hit")
    none = F.array().cast("array<string>")
    return counted.join(hits, F.col("id").eqNullSafe(F.col("hit")) & (counted["mark"] == hits["mark"]), "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_labels", none), ",").alias("base_labels"),
        F.array_join(F.coalesce("labels", none), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
