"""Scalar helpers against Python's own string semantics."""
import pytest
from pyspark.sql import functions as F

from vellum import config as C
from vellum.functions import text as T

WS_SAMPLES = ["", " ", "\x1c", "\x85", " ", " ", "　", "​", " a ", "\x1f\x1ex ",
              "\t\n\x0b\x0c\r", "abc\n", "᠎", "﻿"]


def test_whitespace_constant_is_python_isspace():
    assert C.WHITESPACE == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_strip_and_blank_match_python(spark):
    df = spark.createDataFrame([(s,) for s in WS_SAMPLES], "s string")
    got = df.select("s", T.strip("s").alias("st"), T.is_blank("s").alias("b")).collect()
    for r in got:
        assert r.st == r.s.strip(), repr(r.s)
        assert r.b == (not r.s.strip()), repr(r.s)


@pytest.mark.parametrize("n", [0, 1, 2999, 3000, 3001, 4000, 4001, 30000, 30001])
def test_slices_match_python(spark, n):
    text = ("é😀ab" * (n // 4 + 1))[:n]
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(T.slices("t", 4000, keep_empty=True).alias("c"),
                  T.slices("t", 3000, cap=10, keep_empty=False).alias("p")).first()
    chunks = [text[i:i + 4000] for i in range(0, len(text), 4000)] or [""]
    pages = [text[i:i + 3000] for i in range(0, len(text), 3000)][:10]
    assert r.c == chunks
    assert r.p == pages
    assert "".join(r.c) == text                      # chunks concatenate to the source
    assert "".join(r.p) == text[:30000]              # pages keep the first 30,000 characters


def test_fixed_decimal_matches_python_on_exact_values(spark):
    ns = [0, 1, 63, 64, 192, 1000, 1023, 1024, 4000, 10485760, 10485761, 5 * 1048576 // 100 * 100,
          64 + 128 * 7, 1048576 * 3 // 2, 52428, 52429]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    got = df.select("n", T.size_kb_text("n").alias("kb"), T.size_mb_text("n", 1).alias("mb1"),
                    T.size_mb_text("n", 2).alias("mb2")).collect()
    for r in got:
        assert r.kb == f"{r.n / 1024:.2f}"
        assert r.mb1 == f"{r.n / 1048576:.1f}"
        assert r.mb2 == f"{r.n / 1048576:.2f}"


def test_mask_secret(spark):
    keys = ["", "abc", "12345678", "123456789", "sk-test-key-for-pytest"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.m for r in df.select("k", T.mask_secret("k").alias("m")).collect()}
    for k in keys:
        assert got[k] == f"{k[:4]}...{k[-4:] if len(k) > 8 else ''}"
    assert got["12345678"] == "1234..."


def test_paragraph_split_escape_and_names(spark):
    texts = ["a\n\nb", "x\n\n", "\n\n \n\n", "& < >", "a\n\n\nb", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.split_paragraphs("t").alias("p"), T.xml_escape("t").alias("e")).collect()
    for r in got:
        assert r.p == r.t.split("\n\n")
        assert r.e == r.t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    paths = spark.createDataFrame([("output/x.docx",), ("output/a.b.pdf",), ("noext",)], "p string")
    names = [r.n for r in paths.select(T.download_name("p").alias("n")).collect()]
    assert names == ["livro_traduzido.docx", "livro_traduzido.pdf", "livro_traduzido.noext"]


def test_format_normalise_and_drop_cap(spark):
    df = spark.createDataFrame([("pdf",), ("PDF",), ("docx",), (None,), ("txt",)], "f string")
    assert [r.n for r in df.select(T.normalise_format("f").alias("n")).collect()] == \
        ["pdf", "docx", "docx", "docx", "docx"]
    d = spark.createDataFrame([(" x",), ("😀ab",), ("a",)], "t string")
    got = d.select(T.first_char("t").alias("c"), T.rest_after_first("t").alias("r")).collect()
    assert [(r.c, r.r) for r in got] == [(" ", "x"), ("😀", "ab"), ("a", "")]


def test_fixed_decimal_of_very_long_durations(spark):
    import decimal
    import random
    rnd = random.Random(5)
    ns = [rnd.randrange(10**12, 9 * 10**17) for _ in range(2000)] + [999_999_950, 999_950, 50, 150]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    for r in df.select("n", T.fixed_decimal("n", 1_000_000, 4).alias("t")).collect():
        exact = decimal.Decimal(r.n) / 1_000_000
        assert r.t == str(exact.quantize(decimal.Decimal("0.0001"), rounding=decimal.ROUND_HALF_EVEN)), r.n


def test_slices_of_a_very_long_text_are_linear(spark):
    import time
    text = "añ😀\n" * 2_000_000
    df = spark.createDataFrame([(text,)], "t string").cache()
    df.count()
    t0 = time.perf_counter()
    got = df.select(F.size(T.slices("t", 4000, keep_empty=True)).alias("n"),
                    F.element_at(T.slices("t", 4000, keep_empty=True), -1).alias("last")).first()
    assert got.n == 2000 and got.last == text[-4000:]
    assert time.perf_counter() - t0 < 20


def test_job_ids_differ_for_parts_that_look_alike(spark):
    rows = [("a|b", None), ("a", "b"), (None, "a|b"), ("a", None), (None, "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(T.job_id_hash("x", "y").alias("j")).distinct().count() == len(rows)
