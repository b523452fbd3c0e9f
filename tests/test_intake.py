"""Requests, files, ordered validation, edits."""
import os
import tempfile

from pyspark.sql import functions as F

from vellum import config as C
from vellum.operators import edits, validate
from vellum.sources import files as FS, requests as RQ

from conftest import chapters_df


def test_request_schema_checks(spark):
    d = tempfile.mkdtemp(prefix="vellum-test-req-")
    lines = [
        '{"book_id":"good","chapters":[{"id":1,"content":"a"},{"id":2,"content":"b"}],"target_language":"Francês"}',
        '{"book_id":"empty","chapters":[],"target_language":"Francês"}',
        '{"book_id":"nolang","chapters":[{"id":1,"content":"a"}]}',
        '{"book_id":"word","chapters":[{"id":"one","content":"a"}],"target_language":"Francês"}',
        '{"book_id": broken',
    ]
    with open(os.path.join(d, "r.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    req = RQ.schema_reject_reason(RQ.read_requests(spark, d)).cache()
    reasons = {r.book_id: r.schema_error for r in req.collect()}
    assert reasons["good"] is None
    assert reasons["empty"] is None
    assert reasons["nolang"] == "field required: target_language"
    assert reasons["word"] in ("malformed request", "chapter needs an integer id and a content")
    assert reasons[None] == "malformed request"
    checked = validate.request_reject_reason(req.where("schema_error is null"))
    by = {r.book_id: r.reject_reason for r in checked.collect()}
    assert by == {"good": None, "empty": "No chapters provided"}
    ch = RQ.request_chapters(req.where("book_id = 'good'")).collect()
    assert [(r.id, r.ordinal, r.content) for r in ch] == [(1, 0, "a"), (2, 1, "b")]


def test_too_many_chapters_limit_is_inclusive(spark):
    rows = [("b100", list(range(100))), ("b101", list(range(101)))]
    df = spark.createDataFrame([(b, [(i, "x") for i in ids]) for b, ids in rows],
                               "book_id string, chapters array<struct<id:bigint,content:string>>")
    got = {r.book_id: r.reject_reason for r in validate.request_reject_reason(df).collect()}
    assert got == {"b100": None, "b101": "Maximum 100 chapters allowed"}


def test_file_checks_in_order(spark):
    rows = [("ok", "application/pdf", 100, 2, None), ("type", "text/plain", 100, 2, None),
            ("eq", "application/pdf", 1048576, 2, None), ("over", "application/pdf", 1048577, 2, None),
            ("nulltype", None, 100, 2, None), ("exerr", "application/pdf", 100, None, "bad xref"),
            ("blank", "application/pdf", 100, 0, None), ("many", "application/pdf", 100, 101, None),
            ("both", "text/plain", 2000000, 0, None)]
    df = spark.createDataFrame(rows, "name string, content_type string, length bigint, n_pages int, "
                                     "extract_error string")
    got = {r.name: r.reject_reason for r in
           validate.file_reject_reason(df, C.Limits(max_file_size=1048576)).collect()}
    assert got == {
        "ok": None, "type": "Only PDF files are supported", "eq": None,
        "over": "File size exceeds the maximum limit of 1.0MB", "nulltype": "Only PDF files are supported",
        "exerr": "Error processing PDF: bad xref", "blank": C.REJECT_NO_TEXT,
        "many": "The PDF contains too many pages/chapters (101). Maximum allowed is 100.",
        "both": "Only PDF files are supported"}


def test_binary_files_and_pluggable_extractor(spark):
    d = tempfile.mkdtemp(prefix="vellum-test-files-")
    docs = {"a.txt": "page one\fpage two\f", "b.txt": "first\f  \fthird", "c.txt": " \f\n",
            "bad.txt": None}
    for name, text in docs.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(text.encode("utf-8") if text is not None else b"\xff\xfe\x00bad")
    files = FS.scan_files(spark, d, glob="*.txt")
    assert files.where(F.col("length") <= 10).count() == 2
    pages = FS.extract_with(files, FS.page_text_extractor("\f"))
    got = sorted((os.path.basename(r.path), r.id, r.content, r.extract_error is not None)
                 for r in pages.collect())
    assert ("b.txt", 1, "first", False) in got and ("b.txt", 3, "third", False) in got   # id gap
    assert not any(p[0] == "c.txt" for p in got)                                       # all blank
    assert [p for p in got if p[0] == "bad.txt"][0][3] is True                          # error row
    summary = {os.path.basename(r.path): (r.n_pages, r.extract_error is not None)
               for r in FS.file_summary(files, pages).collect()}
    assert summary["a.txt"] == (2, False) and summary["c.txt"][0] is None


def test_edits(spark):
    ch = chapters_df(spark, [(1, "a"), (2, "b"), (2, "b2"), (5, "e")])
    e = spark.createDataFrame([("b1", 2, 1, "new"), ("b1", 2, 2, "newer")],
                              "book_id string, id bigint, edit_seq int, content string")
    got = sorted((r.id, r.content) for r in edits.update_chapters(ch, e).collect())
    assert got == [(1, "a"), (2, "newer"), (2, "newer"), (5, "e")]
    app = edits.append_chapter(ch).where("content = ''").first()
    assert (app.id, app.ordinal) == (6, 4)
    one = chapters_df(spark, [(1, "only")], book="solo")
    rem = spark.createDataFrame([("b1", 2), ("solo", 1)], "book_id string, id bigint")
    left = sorted((r.book_id, r.id) for r in edits.remove_chapters(ch.unionByName(one), rem).collect())
    assert left == [("b1", 1), ("b1", 5), ("solo", 1)]
    empty = spark.createDataFrame([], "book_id string, id bigint, ordinal bigint, content string")
    books = spark.createDataFrame([("none",)], "book_id string")
    assert [tuple(r) for r in edits.next_chapter_id(empty, books).collect()] == [("none", 1, 0)]
    two = chapters_df(spark, [(1, "a"), (2, "b")], book="two")
    both = spark.createDataFrame([("two", 2, 1), ("two", 1, 2)], "book_id string, id bigint, removal_seq int")
    assert [r.id for r in edits.remove_chapters(two, both).collect()] == [1]      # the last one stays


def test_blank_chapter_guard_and_limit(spark):
    ch = chapters_df(spark, [(1, "a"), (2, " 　")]).unionByName(chapters_df(spark, [(1, "x")], "b2"))
    got = {r.book_id: r.accepted for r in validate.blank_chapter_guard(ch).collect()}
    assert got == {"b1": False, "b2": True}
    g = {r.book_id: r.accepted for r in validate.max_chapters_guard(ch, 1).collect()}
    assert g == {"b1": False, "b2": True}


def test_pdf_magic_bytes(spark):
    d = tempfile.mkdtemp(prefix="vellum-test-magic-")
    for name, data in {"real.pdf": b"%PDF-1.7\n...", "fake.pdf": b"<html>"}.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    files = FS.scan_files(spark, d, glob="*.pdf")
    got = {os.path.basename(r.path): r.ok for r in
           files.select("path", validate.has_pdf_magic("content").alias("ok")).collect()}
    assert got == {"real.pdf": True, "fake.pdf": False}
