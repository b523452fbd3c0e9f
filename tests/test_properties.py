"""Property checks (hypothesis) of the text helpers against Python, one Spark job per
property, and input-order independence of the layouts."""
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vellum import config as C
from vellum.functions import text as T
from vellum.operators import layout

from conftest import chapters_df

ALPHABET = st.sampled_from(list(C.WHITESPACE) + list("ab\n\n&<>é😀") + ["​", "﻿"])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=60)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_text_helpers_agree_with_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", T.strip("t").alias("s"), T.is_blank("t").alias("b"),
                    T.split_paragraphs("t").alias("p"),
                    T.slices("t", 7, keep_empty=True).alias("c"),
                    T.slices("t", 5, cap=3, keep_empty=False).alias("g")).collect()
    for r in got:
        t = texts[r.i]
        assert r.s == t.strip()
        assert r.b == (not t.strip())
        assert r.p == t.split("\n\n")
        assert r.c == ([t[k:k + 7] for k in range(0, len(t), 7)] or [""])
        assert r.g == [t[k:k + 5] for k in range(0, len(t), 5)][:3]


def test_layout_is_independent_of_input_order(spark):
    rows = [(i, ("page text " * (i * 97))) for i in range(1, 9)] + [(20, ""), (15, "a\n\nb")]
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)

    def stream(r):
        pos = layout.chapter_positions(chapters_df(spark, r), paragraphs=True)
        d = layout.docx_elements(pos).select("seq", "kind", "chapter_id", "text").collect()
        p = layout.pdf_elements(pos).select("seq", "kind", "chapter_id", "text").collect()
        return sorted(d), sorted(p)

    assert stream(rows) == stream(shuffled)


GROUPS = st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b", "c"]),
                            st.integers(0, 9)), min_size=1, max_size=120)


@settings(max_examples=5, deadline=None)
@given(GROUPS, st.integers(1, 9))
def test_blocked_scan_equals_python_prefix_sums(spark, rows, blocks):
    from vellum.operators.scan import previous_values, running_sums
    data = [(g, i, w) for i, (g, w) in enumerate(rows)]         # order key i is unique
    df = spark.createDataFrame(data, "g string, o int, w int")
    got = {(r.g, r.o): (r.s, r.n, r.total) for r in running_sums(
        df, ["g"], ["o"], {"s": F.col("w"), "n": F.lit(1)}, blocks=blocks,
        totals={"total": "s"}).collect()}
    lag = {(r.g, r.o): r.pw for r in previous_values(df, ["g"], ["o"], {"pw": "w"},
                                                     blocks=blocks).collect()}
    want, want_lag, seen = {}, {}, {}
    totals = {}
    for g, o, w in data:
        totals[g] = totals.get(g, 0) + w
    for g, o, w in data:
        s, n, prev = seen.get(g, (0, 0, None))
        want[(g, o)] = (s, n, totals[g])
        want_lag[(g, o)] = prev
        seen[g] = (s + w, n + 1, w)
    assert got == want
    assert lag == want_lag
