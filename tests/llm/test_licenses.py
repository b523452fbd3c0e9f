import re

from vellum.llm import licenses

from .data import SCHEMA, with_clashes

TEXTS = [
    "Released under the MIT License. Under the-MIT license!", "cc by nc cc by NC", "cc-by, nc", "Apache License, Version 2.0",
    "licensed under the GNU General Public License, version 3.", "licensed under the gnu public license version 3",
    "under the mit", "", None, "é Under The Mit License é", "the license", "x " * 5000 + "cc by nc " + "y " * 5000,
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated "
    "documentation files, to deal in the Software without restriction",
]


def brute(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w))
            if w[i:i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_base_phrases_equal_brute_force_and_labels_contain_them(spark):
    df = with_clashes(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA))
    got = {r.doc_id: r for r in licenses.labelled(df).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[4].labels == "gpl-3" and got[4].score == 1
    assert got[12].labels == "mit"                       # one word changed: neighbouring diagonals
    assert got[10].labels == "" and got[10].score == 0


FSF = ("it under the terms of the GNU General Public License as published by the Free Software Foundation, "
       "either version {} of the License, or (at your option) any later version")
CC = "Licensed under a Creative Commons Attribution{} {} International License"
GPL = "licensed under the GNU General Public License"
NAMED = [(FSF.format(2), "gpl-2"), (FSF.format(3), "gpl-3"), (FSF.format("2 or version 3"), "gpl-2,gpl-3"), (FSF.format(1), ""),
         (CC.format("", "4.0"), "cc-by"), (CC.format("", "3.0"), "cc-by"), (CC.format("-NonCommercial", "4.0"), "cc-by-nc"),
         (CC.format("-Non-Commercial", "4.0"), "cc-by-nc"), (CC.format("-NonCommercial", "3.0"), "cc-by-nc"),
         (CC.format("", "4.0") + ". Not so: " + CC.format("-NonCommercial", "4.0"), "cc-by,cc-by-nc"),
         ("GNU General Public License " * 3, ""), (GPL, ""), (GPL + " (GPL) version 3", "gpl-3"), (GPL + " v3", "gpl-3"),
         (GPL + " v2", ""), (GPL + ", version 2", ""),
         ("GNU General Public License " * 9 + GPL + ", version 3 " + "GNU General Public License " * 9, "gpl-3"),
         ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mpl-2"), ("Licensed under CC BY-NC 3.0", "cc-by-nc")]


def test_deciding_words_and_dense_repeats(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMED)], SCHEMA)
    got = {r.doc_id: r.labels for r in licenses.labelled(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(NAMED)] == NAMED


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, TEXTS[0]), (1, TEXTS[0]), (1, TEXTS[0])], SCHEMA)
    assert [r.n_base for r in licenses.labelled(df).collect()] == [2, 2, 2]
    assert licenses.labelled(df.limit(0)).collect() == []


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], SCHEMA)
    texts, found = licenses.scan(df)
    for d in (texts, found):
        assert "Python" not in d._jdf.queryExecution().toString() and "Pandas" not in d._jdf.queryExecution().toString()
