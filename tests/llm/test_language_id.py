import zlib

import numpy as np
import pytest

from vellum.llm import language_id as L
from vellum.llm.queries import read

from .data import CLASHING

SCHEMA = "doc_id bigint, text string, lang string"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(read(spark, SF, "documents").select("doc_id", "text", "lang"))


def test_held_out_accuracy_on_the_corpus(spark, model):
    docs = read(spark, SF, "documents")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = L.predict(docs, model).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es", "und"}
        letters = any(c.isalpha() for c in lang[r.doc_id][1] or "")
        assert (r.lang_pred == "und") == (not letters)
    test = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in test) >= 0.98 * len(test)


def test_a_prediction_depends_on_the_text_alone_and_edges_are_defined(spark, model):
    text = "Étion dans, le qui la mentmentque çen, queé équeelle"
    rows = [(1, text, "de"), (2, text, None), (None, text, "en"), (4, None, "fr"), (5, "", None), (6, "12 345 -- ½ Ⅷ_", "en"),
            (7, text, "es"), (7, text, "es"), (8, "x", None), (9, (text + " ") * 40_000, None), (10, " \n" * 500_000, "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.held_out, r.lang_pred, r.score) for r in L.predict(df, model).collect()), key=str)
    assert [g[2] for g in got if g[0] in (1, 2, None, 7, 9)] == ["fr"] * 6
    assert len({g[3] for g in got if g[0] in (1, 2, None, 7)}) == 1
    assert [(g[2], g[3]) for g in got if g[0] in (4, 5, 6, 10)] == [("und", 0.0)] * 4
    assert all(not g[1] for g in got if g[0] is None)
    from pyspark.sql import functions as F
    more = df.withColumns({c: F.lit("clash") for c in [*CLASHING, "held_out", "score", "idx", "val", "whole"]})
    assert sorted(map(str, L.predict(more, model).collect())) == sorted(map(str, L.predict(df, model).collect()))
    assert L.predict(df.limit(0)).collect() == []


def test_only_training_rows_teach(spark):
    """Rows held out, without a language or without an id leave the model as it is."""
    train = [(d, f"the cat and the dog {d}", "en") if d % 2 else (d, f"der hund und die katze {d}", "de")
             for d in range(200) if zlib.crc32(str(d).encode()) % 3 != 1]
    other = [(d, "zzz qqq", "xx") for d in range(200) if zlib.crc32(str(d).encode()) % 3 == 1]
    other += [(None, "zzz qqq", "xx"), (1001, "zzz qqq", None)]
    rows = [r for r in L.predict(spark.createDataFrame(train + other, SCHEMA)).collect()]
    assert {r.lang_pred for r in rows} == {"en", "de"}
    assert {r.lang_pred for r in rows if r.doc_id is not None and r.doc_id < 200 and not r.held_out and r.doc_id % 2} == {"en"}
    none = L.predict(spark.createDataFrame(other, SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = L.predict(spark.createDataFrame(train[:1] + other, SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {(train[0][2], 1.0)}


def test_families_come_first_and_unknown_codes_stand_alone():
    assert L.family("en-US") == L.family("de") == "germanic" and L.family("pt_BR") == "romance"
    assert L.family("xx") == "=xx" != L.family("yy")
    rnd = np.random.default_rng(0)
    vocabulary = {x: ["".join(rnd.choice(list(a), 4)) for _ in range(40)] for x, a in
                  {"en": "abcdef", "de": "defghi", "fr": "stuvwx", "es": "vwxyzs", "xx": "klmnop"}.items()}
    rows, langs = [], []
    for lang, words in vocabulary.items():
        for _ in range(30):
            rows.append(L.features(" ".join(rnd.choice(words, 20))))
            langs.append(lang)
    m = L.Model.fit(rows, langs)
    assert m.families.names == ["=xx", "germanic", "romance"]
    assert {f: p.names for f, p in m.within.items()} == {"=xx": ["xx"], "germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert len(m.families.weights) == 3 and len(m.within["romance"].weights) == 1
    for lang, words in vocabulary.items():
        assert m.predict(" ".join(words))[0] == lang


def test_features_do_not_depend_on_the_block(monkeypatch):
    text = "Words, and more words; déjà vu 123 über-alles " * 30
    whole = L.features(text)
    for block in (1, 2, 5, 64):
        monkeypatch.setattr(L, "BLOCK", block)
        part = L.features(text)
        assert np.array_equal(part[0], whole[0]) and np.allclose(part[1], whole[1])


def test_svm_separates_what_is_separable():
    rnd = np.random.default_rng(1)
    rows, y = [], []
    for k in range(60):
        idx = np.sort(rnd.choice(np.arange(50), 10, replace=False)) + (0 if k % 2 else 40)
        rows.append((idx, np.full(10, 10 ** -0.5)))
        y.append(1.0 if k % 2 else -1.0)
    w = L.fit_svm(rows, np.array(y))
    assert all(np.sign(w[i] @ v + w[-1]) == s for (i, v), s in zip(rows, y))
