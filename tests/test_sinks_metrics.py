"""Sinks, counts, read-back and request round trips on inline fixtures."""
from pyspark.sql import functions as F

from vellum import config as C
from vellum.operators import layout, metrics, validate
from vellum.sinks import read_artifacts, write_artifacts, write_rejects
from vellum.sources import options, requests

from conftest import chapters_df
from test_layout import FIXTURES, docx_model, pdf_model


def _books(spark):
    a = chapters_df(spark, FIXTURES["varying"] + [(9, "")], book="a")
    b = chapters_df(spark, FIXTURES["paragraphs"], book="b")
    c = chapters_df(spark, FIXTURES["long"], book="c")
    return a.unionByName(b).unionByName(c)


def test_layout_counts_equal_the_element_streams(spark):
    pos = layout.chapter_positions(_books(spark), paragraphs=True)
    counts = {r.book_id: r for r in metrics.layout_counts(pos).collect()}
    docx = {r.book_id: r.n for r in layout.docx_elements(pos).groupBy("book_id")
            .agg(F.count("*").alias("n")).collect()}
    pdf = {r.book_id: r.n for r in layout.pdf_elements(pos).groupBy("book_id")
           .agg(F.count("*").alias("n")).collect()}
    assert set(counts) == {"a", "b", "c"}
    for book, r in counts.items():
        assert r.docx_elements == docx[book], book
        assert r.pdf_elements == pdf[book], book


def test_render_text_reads_the_docx_story_back(spark):
    rows = FIXTURES["varying"] + [(9, "")]
    els = layout.docx_elements(layout.chapter_positions(chapters_df(spark, rows), bounded=True))
    got = layout.render_text(els).collect()
    want = "".join(t if k == "dropcap" else ("\f" if k == "break" else t) + "\n" for k, t in docx_model(rows))[:-1]
    assert len(got) == 1 and got[0].text == want
    assert got[0].n_elements == len(docx_model(rows))


def test_render_text_of_the_pdf_story(spark):
    rows = FIXTURES["paragraphs"]
    els = layout.pdf_elements(layout.chapter_positions(chapters_df(spark, rows), paragraphs=True))
    got = layout.render_text(els).first().text
    shown = {"break": "\f", "spacer": "", "gap": ""}
    assert got == "\n".join(shown.get(k, t) for k, t in pdf_model(rows))


def test_layout_errors_mark_only_the_chapter_without_content(spark):
    ch = chapters_df(spark, [(1, "one"), (1, None), (3, "three")])        # a repeated display id
    els = layout.pdf_elements(layout.chapter_positions(ch, paragraphs=True))
    rows = els.orderBy("seq").collect()
    marked = [(r.chapter_id, r.kind, r.seq) for r in rows if r.element_error is not None]
    assert marked == [(1, "title", 6)]
    assert [r.kind for r in rows if 5 <= r.seq <= 7] == ["break", "title", "spacer"]


def test_styled_elements_keep_parity_alignment_for_numbers(spark):
    pos = layout.chapter_positions(chapters_df(spark, [(1, "x" * 7000)]))
    s = layout.styled(layout.docx_elements(pos), options.styles(spark), "docx")
    nums = s.where("kind = 'number'").orderBy("seq").collect()
    assert [r.align for r in nums] == ["RIGHT", "LEFT", "RIGHT"]
    assert s.where("kind = 'title'").first().align == "RIGHT"
    assert s.count() == layout.docx_elements(pos).count()          # left join adds no row


def test_every_style_row_meets_an_element(spark):
    pos = layout.chapter_positions(chapters_df(spark, [(1, "x" * 7000), (2, "a\n\nb")]), paragraphs=True)
    kinds = {("docx", r.kind) for r in layout.docx_elements(pos).collect()} | {
        ("pdf", r.kind) for r in layout.pdf_elements(pos).collect()}
    assert kinds == {(s[0], s[1]) for s in C.STYLES}


def test_resolve_limits_defaults_and_overrides(spark):
    tenants = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "tenant string")
    ov = spark.createDataFrame([("t1", 5, None, None), ("t2", None, 7, False)],
                               "tenant string, max_file_size bigint, max_chapters int, "
                               "use_background_tasks boolean")
    got = {r.tenant: (r.max_file_size, r.max_chapters, r.use_background_tasks)
           for r in options.resolve_limits(tenants, ov).collect()}
    d = C.Limits()
    assert got == {"t1": (5, d.max_chapters, d.use_background_tasks),
                   "t2": (d.max_file_size, 7, False),
                   "t3": (d.max_file_size, d.max_chapters, d.use_background_tasks)}


def test_artifact_rerun_replaces_only_the_jobs_it_writes(spark, tmp_path):
    path = str(tmp_path / "artifacts")
    first = spark.createDataFrame([("j1", 1, "old"), ("j1", 2, "old"), ("j2", 1, "keep")],
                                  "job_id string, seq bigint, text string")
    write_artifacts(first, path, "0001")
    again = spark.createDataFrame([("j1", 1, "new")], "job_id string, seq bigint, text string")
    write_artifacts(again, path, "0002")
    write_artifacts(again, path, "0002")                 # the same run again
    back = sorted((r.job_id, r.seq, r.text) for r in read_artifacts(spark, path).collect())
    assert back == [("j1", 1, "new"), ("j2", 1, "keep")]


def test_rejects_are_split_and_appended(spark, tmp_path):
    ch = chapters_df(spark, [(1, "ok"), (2, "   ")], book="blank").unionByName(
        chapters_df(spark, [(1, "fine")], book="good"))
    g = validate.blank_chapter_guard(ch)
    ok, bad = validate.split_rejects(g)
    assert [r.book_id for r in ok.collect()] == ["good"]
    path = str(tmp_path / "rejects")
    write_rejects(bad, path)
    write_rejects(bad, path)
    got = spark.read.parquet(path).collect()
    assert [(r.book_id, r.reject_reason) for r in got] == [("blank", C.REJECT_BLANK_CHAPTER)] * 2


def test_requests_in_parts_round_trip_to_the_same_chapters(spark):
    rows = [(i % 4 + 1, f"chapter text {i}") for i in range(11)]        # repeated ids too
    ch = chapters_df(spark, rows, book="7")
    req = requests.requests_from_chapters(ch, "Francês", part_size=3)
    assert req.count() == 4                                   # ceil(11 / 3) bounded rows
    assert max(len(r.chapters) for r in req.collect()) == 3
    back = requests.request_chapters(req.withColumn("output_format", F.lit("docx")))
    key = ["book_id", "id", "ordinal", "content"]
    assert sorted(back.select(*key).collect()) == sorted(ch.select(*key).collect())


def test_chapter_lists_follow_id_then_submission_order(spark):
    ch = chapters_df(spark, [(2, "bb"), (1, "a"), (2, "cccc")])
    r = metrics.chapter_lists(ch).first()
    assert list(r.ids) == [1, 2, 2] and list(r.lengths) == [1, 2, 4]


def test_parts_of_any_size_keep_ordinals_apart_and_a_replay_counts_once(spark):
    a = chapters_df(spark, [(i, f"a{i}") for i in range(150)], book="x")
    b = chapters_df(spark, [(i, f"b{i}") for i in range(20)], book="x")
    req = requests.requests_from_chapters(a, "Francês", 150).unionByName(
        requests.requests_from_chapters(b, "Francês", 150).withColumn("part", F.lit(1).cast("bigint")))
    req = req.unionByName(req).withColumn("output_format", F.lit("docx"))
    rows = requests.request_chapters(req).collect()
    assert len(rows) == 170
    assert sorted(r.ordinal for r in rows) == list(range(170))
    assert {r.ordinal: r.content for r in rows}[150] == "b0"
    checked = validate.request_reject_reason(req.dropDuplicates(["part"]), 160).collect()
    assert {r.reject_reason for r in checked} == {"Maximum 160 chapters allowed"}


def test_a_refused_book_leaves_a_reject_row(spark):
    from vellum.plans import pipeline
    long = chapters_df(spark, [(i, "text") for i in range(101)], book="long")
    ok = chapters_df(spark, [(1, "text")], book="ok")
    none = chapters_df(spark, [(1, "text")], book="none").withColumn("book_id", F.lit(None).cast("string"))
    run = pipeline.run_jobs(long.unionByName(ok).unionByName(none))
    assert {(r.book_id, r.reject_reason) for r in run.rejects.collect()} == {
        ("long", "Maximum 100 chapters allowed"), (None, "field required: book_id")}
    assert {r.book_id for r in run.elements.collect()} == {"ok"}
    assert {r.job_id for r in run.elements.collect()} == {r.job_id for r in run.events.collect()}
