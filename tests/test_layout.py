"""Layout element streams against a plain-Python model of the DOCX / PDF stories."""
import random

from pyspark.sql import Window, functions as F

from vellum.operators import layout
from vellum.operators.scan import previous_values, running_sums
from vellum.plans import pipeline
from vellum.operators import translate

from conftest import chapters_df


def docx_model(rows):
    s = [c for _, c in sorted(enumerate(rows), key=lambda t: (t[1][0], t[0]))]
    out, page_no = [], 1
    for i, (cid, content) in enumerate(s):
        out.append(("title", f"Capítulo {cid}"))
        pages = [content[k:k + 3000] for k in range(0, len(content), 3000)]
        for j, p in enumerate(pages):
            if j == 0:
                out.append(("dropcap", p[0]))
            out.append(("body", p[1:] if j == 0 else p))
            out.append(("number", str(page_no)))
            page_no += 1
            if j < len(pages) - 1 or i < len(s) - 1:
                out.append(("break", None))
    return out


def pdf_model(rows):
    s = [c for _, c in sorted(enumerate(rows), key=lambda t: (t[1][0], t[0]))]
    out = []
    for i, (cid, content) in enumerate(s):
        if i > 0:
            out.append(("break", None))
        out.append(("title", f"Capítulo {cid}"))
        out.append(("spacer", None))
        for p in content.split("\n\n"):
            if p.strip():
                out.append(("body", p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")))
                out.append(("gap", None))
    return out


def spark_stream(els):
    rows = els.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1))      # dense, from 1
    return [(r.kind, r.text) for r in rows]


FIXTURES = {
    "marked": [(1, "alpha marker"), (2, "beta marker"), (3, "gamma marker")],
    "unordered": [(3, "three"), (1, "one"), (2, "two")],
    "varying": [(1, "short"), (2, "ten " * 10), (3, "fifty words " * 50 * 60)],
    "empty_last": [(1, "x" * 3001), (2, "")],
    "duplicates": [(2, "second a"), (1, "first"), (2, "second b")],
    "single": [(7, "😀 émoji\n\nline")],
    "long": [(1, "y" * 30001), (2, "z" * 30000)],
    "paragraphs": [(1, "a\n\nb"), (2, "trailing\n\n"), (3, "\n\n \n\n"), (4, "& < >")],
}


def test_docx_and_pdf_streams_match_model(spark):
    for name, rows in FIXTURES.items():
        for bounded in (False, True):
            pos = layout.chapter_positions(chapters_df(spark, rows), bounded=bounded, blocks=3,
                                           paragraphs=True)
            assert spark_stream(layout.docx_elements(pos)) == docx_model(rows), name
            assert spark_stream(layout.pdf_elements(pos)) == pdf_model(rows), name


def test_pages_are_numbered_without_holes_and_parity_aligned(spark):
    rows = FIXTURES["varying"] + FIXTURES["long"]
    rows = [(i, c) for i, (_, c) in enumerate(rows, start=1)]
    p = layout.page_rows(layout.chapter_positions(chapters_df(spark, rows))).orderBy("page_no").collect()
    assert [r.page_no for r in p] == list(range(1, len(p) + 1))
    assert all(r.align == ("LEFT" if r.page_no % 2 == 0 else "RIGHT") for r in p)
    assert [r.has_break for r in p][-1] is False and all(r.has_break for r in p[:-1])


def test_flagship_path_equals_generic_path(spark):
    rows = [(i, ("lorem ipsum " * (i * 700))) for i in range(1, 6)] + [(9, "")]
    ch = chapters_df(spark, rows)
    fast = pipeline.flagship(ch, translate.IdentityModel())
    t = pipeline.translate_books(ch, translate.IdentityModel())
    slow = pipeline.numbered_pages(t)
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_skew_safe_scan_equals_window_with_one_hot_group(spark):
    rnd = random.Random(7)
    data = [("hot", i, rnd.randint(0, 9)) for i in range(3000)]
    data += [(f"g{k}", i, rnd.randint(0, 9)) for k in range(50) for i in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(data, "g string, o int, w int")
    got = running_sums(df, ["g"], ["o"], {"s": F.col("w"), "n": F.lit(1)}, blocks=16)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumns({"s": F.coalesce(F.sum("w").over(w), F.lit(0)),
                          "n": F.coalesce(F.count("*").over(w), F.lit(0))})
    key = lambda r: (r.g, r.o)
    assert sorted(got.select("g", "o", "s", "n").collect(), key=key) == \
        sorted(ref.select("g", "o", "s", "n").collect(), key=key)
    lag = previous_values(df, ["g"], ["o"], {"pw": "w"}, blocks=16)
    ref_lag = df.withColumn("pw", F.lag("w").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(lag.select("g", "o", "pw").collect(), key=key) == \
        sorted(ref_lag.select("g", "o", "pw").collect(), key=key)


def test_paragraph_split_keeps_positions(spark):
    ch = chapters_df(spark, FIXTURES["paragraphs"])
    got = sorted((r.id, r.para_idx, r.text) for r in layout.split_paragraphs(ch).collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "trailing"), (4, 0, "&amp; &lt; &gt;")]


def test_truncation_audit(spark):
    ch = chapters_df(spark, [(1, "a" * 30000), (2, "b" * 30001), (3, "")])
    got = {r.id: (r.pages_kept, r.pages_dropped, r.chars_lost)
           for r in layout.truncation_audit(ch).collect()}
    assert got == {1: (10, 0, 0), 2: (10, 1, 1), 3: (0, 0, 0)}


def test_long_chapter_comes_out_whole_by_default(spark):
    ch = chapters_df(spark, [(1, "x" * 40000)])
    assert layout.paginate(ch).count() == 14
    assert layout.paginate(ch, max_pages=10).count() == 10
    pages = pipeline.flagship(ch, translate.IdentityModel()).collect()
    # 10 chunks joined by 9 newlines
    assert sum(len(p.text) for p in pages) == 40009


def test_null_book_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 4)], "g string, o int, w int")
    got = sorted((str(r.g), r.o, r.s) for r in running_sums(df, ["g"], ["o"], {"s": F.col("w")}, blocks=3).collect())
    assert got == [("None", 1, 0), ("None", 2, 2), ("a", 1, 0)]
    ch = spark.createDataFrame([(None, 1, 0, "x"), ("b", 1, 0, "y")], "book_id string, id bigint, ordinal bigint, content string")
    assert layout.chapter_positions(ch).count() == 2
