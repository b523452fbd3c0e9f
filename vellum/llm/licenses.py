"""License scan by diagonal voting, in DataFrame functions only.

Templates are short license texts and phrases.  Every rolling word k-gram of every text is
hashed and joined to the positions where that k-gram stands in a template; the words are
compared as well, so a hash collision cannot vote.  A hit at word p of the text and word t
of the template votes for the diagonal p - t.  Votes are aggregated by diagonal and
neighbouring diagonals (a few inserted or missing words) are merged; where repeats chain up
to more than one template, each diagonal is taken with its close neighbours alone.

A span is verified by the share of the template's k-grams that it holds, each counted once,
and by its words: the word that decides between licenses (a version number, NonCommercial)
must stand near its place in the template, and the words after a hit must not make it
another license (CC BY followed by NonCommercial).  A text that names two versions gets both.

The template table is fixed by the caller (some hundred k-grams here), so broadcasting it
does not grow with the texts.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, documents, land

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals this close are one span.
DRIFT = 4
#: Least share of a template's k-grams in a verified span.
COVER = 0.6
#: Words kept on each side of a hit, in which the deciding word is looked for.
REACH = 8
#: Words that make another license of CC BY.
ELEMENTS = ["noncommercial", "non", "nc", "sharealike", "share", "sa", "noderivatives", "noderivs", "no", "nd"]

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening words of public license texts and notices, and their labels.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the "
                 "License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
              "either version 3 of the License, or any later version"),
    ("gpl-2", "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
              "either version 2 of the License, or any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def deciding(label: str, w: list[str]) -> tuple[int | None, list[str], list[str]]:
    """(place of the deciding word in the template or None, words accepted for it, words refused
    after a hit) of a template's words."""
    name, _, last = label.rpartition("-")
    accepted = [last, f"v{last}", f"{name}v{last}"] if last.isdigit() else ["nc", "noncommercial", "non"] if last == "nc" else []
    return next((i for i, x in enumerate(w) if x in accepted), None), accepted, ELEMENTS if label == "cc-by" else []


def gram_rows(base=BASE, templates=TEMPLATES) -> list[tuple]:
    rows = []
    for i, (label, text, is_base) in enumerate([(v, k, True) for k, v in base.items()]
                                               + [(label, t, False) for label, t in templates]):
        w = template_words(text)
        decides = (None, [], []) if is_base else deciding(label, w)
        rows += [(" ".join(w[j:j + K]), i, j, len(w) - K + 1, label, is_base, *decides) for j in range(len(w) - K + 1)]
    return rows


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(hash, gram, template, at, n_grams, label, is_base, decides, accepted, refused), one row
    per template position."""
    t = spark.createDataFrame(gram_rows(base, templates), "gram string, template int, at int, n_grams int, label string, "
                              "is_base boolean, decides int, accepted array<string>, refused array<string>")
    w = F.split("gram", " ")
    return t.withColumn("hash", F.xxhash64(*[F.get(w, j) for j in range(K)]))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS, -1), "")


def _decided(before: Column, after: Column) -> Column:
    """Whether the template's deciding word stands within DRIFT words of its place as seen from
    a hit; ``before`` and ``after`` are the text's words from the hit outwards."""
    def near(side: Column, i: Column) -> Column:
        first = F.greatest(i - DRIFT, F.lit(0))
        return F.arrays_overlap(F.slice(side, first + 1, i + DRIFT + 1 - first), F.col("accepted"))

    right, left = F.col("decides") - F.col("at") - K, F.col("at") - 1 - F.col("decides")
    return F.when(right >= 0, near(after, right)).when(left >= 0, near(before, left)).otherwise(True)


def votes(docs: DataFrame, grams: DataFrame, known: list[str]) -> DataFrame:
    """One pass over the texts: a row per k-gram hit, and one with ``at`` null per text.
    ``known`` are the templates' k-grams: only their places have their surroundings kept."""
    d = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", words(F.col("text")).alias("words"))
    d = d.select("__row", "doc_id", "words", F.size("words").alias("n_words"))
    last = F.greatest(F.col("n_words") - K, F.lit(-1))
    rolled = d.select("__row", "doc_id", "n_words", "words", F.explode(F.sequence(F.lit(-1), last)).alias("pos"))
    at = [F.get("words", F.col("pos") + j) for j in range(K)]
    rolled = rolled.select("__row", "doc_id", "n_words", "pos",
                           F.when(F.col("pos") >= 0, F.xxhash64(*at)).alias("__hash"),
                           F.concat_ws(" ", *at).alias("__gram"), "words")
    hit, pos = F.col("__gram").isin(known), F.col("pos")
    rolled = rolled.select(
        "__row", "doc_id", "n_words", "pos", "__hash", "__gram",
        F.when(hit, F.reverse(F.slice("words", F.greatest(pos - REACH, F.lit(0)) + 1, F.least(pos, F.lit(REACH))))).alias("__before"),
        F.when(hit, F.slice("words", pos + K + 1, REACH)).alias("__after"))
    joined = rolled.join(F.broadcast(grams), (F.col("__hash") == F.col("hash")) & (F.col("__gram") == F.col("gram")),
                         "left")
    return joined.where((F.col("pos") < 0) | F.col("at").isNotNull()).select(
        "__row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "pos",
        "template", "at", "n_grams", "label", "is_base",
        F.coalesce(_decided(F.col("__before"), F.col("__after")), F.lit(True)).alias("decided"),
        ((F.col("at") < F.col("n_grams") - 1) & F.coalesce(F.array_contains("refused", F.get("__after", F.lit(0))), F.lit(False))
         ).alias("other"))


def spans(hits: DataFrame) -> DataFrame:
    """Verified spans: (__row, label, is_base, start, end, cover).

    Base phrases need every k-gram on one diagonal, which is an exact occurrence.  For the
    others neighbouring diagonals are merged first, and the words are verified (see above)."""
    h = hits.where(F.col("at").isNotNull()).withColumn("diagonal", F.col("pos") - F.col("at"))
    kind = ["__row", "template", "n_grams", "label", "is_base"]
    lines = h.groupBy(*kind, "diagonal").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.collect_set("at").alias("ats"),
        F.max("decided").alias("decided"), F.max("other").alias("other"))
    per = Window.partitionBy("__row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(per)
    new = F.when(gap.isNull() | (gap > DRIFT) | F.col("is_base"), 1).otherwise(0)
    lines = lines.withColumn("__new", new).withColumn("band", F.sum("__new").over(per))
    cover = lambda ats: F.size(F.array_distinct(F.flatten(ats))) / F.col("n_grams")
    result = ["__row", "label", "is_base", "start", "end", "cover"]
    verified = F.col("is_base") | (F.col("decided") & ~F.col("other"))
    need = F.when(F.col("is_base"), 1.0).otherwise(COVER)
    near = F.col("is_base") | (F.col("end") - F.col("start") <= 2 * (F.col("n_grams") + K))
    bands = lines.groupBy(*kind, "band").agg(
        F.min("start").alias("start"), (F.max("end") + K).alias("end"), F.collect_list("ats").alias("ats"),
        F.max("decided").alias("decided"), F.max("other").alias("other")).withColumn("cover", cover(F.col("ats")))
    bands = bands.where((F.col("cover") >= need) & near & verified)
    # Bands that are none of it as a whole: diagonals with their close neighbours.
    close = per.rangeBetween(-DRIFT, DRIFT)
    parts = lines.where(~F.col("is_base")).join(bands.select("__row", "template", "band"), ["__row", "template", "band"], "left_anti")
    parts = parts.select(*kind, "diagonal", F.min("start").over(close).alias("start"), (F.max("end").over(close) + K).alias("end"),
                         cover(F.collect_list("ats").over(close)).alias("cover"), F.max("decided").over(close).alias("decided"),
                         F.max("other").over(close).alias("other")).where((F.col("cover") >= COVER) & verified)
    best = F.min(F.struct(-F.col("cover"), F.col("diagonal").alias("at"))).over(close)["at"]
    parts = parts.withColumn("__best", best).where(F.col("__best") == F.col("diagonal"))
    return bands.select(*result).unionByName(parts.select(*result))


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has __row, doc_id, n_words for every input row; spans the
    verified spans in words [start, end) with label, is_base and cover.

    Null and empty texts have no words and no spans.  Repeated rows and null ids are rows
    of their own (``__row`` tells them apart).  Other columns are not read; an empty table
    gives two empty tables."""
    grams = template_grams(docs.sparkSession, base, templates)
    known = sorted({r[0] for r in gram_rows(base, templates)})
    hits = land(votes(documents(docs, id_col, text_col), grams, known), "votes")
    return hits.where(F.col("pos") < 0).select("__row", "doc_id", "n_words"), spans(hits)


def labelled(docs: DataFrame, **columns) -> DataFrame:
    """Per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts, found = scan(docs, **columns)
    base = F.col("is_base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = found.groupBy("__row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max("cover").alias("score"))
    return texts.join(per, "__row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"), F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
