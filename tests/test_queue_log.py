"""The queue between accepting and running, the engine's own log, segments, chapter faults."""
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vellum.operators import layout
from vellum.operators.runlog import ProgressLog, RunLog
from vellum.plans import registry as R
from vellum.session import scratch_path
from vellum.sources import requests as RQ
from vellum.store import RunStore
from vellum.streaming import queue, stream

from conftest import chapters_df


def _lines(spark, *books):
    out = None
    for book, rows in books:
        ch = chapters_df(spark, rows, book)
        req = RQ.requests_from_chapters(ch, "L", None).withColumn("output_format", F.lit("pdf"))
        out = req if out is None else out.unionByName(req)
    return R.request_lines(out)


def test_each_accepted_job_runs_once(spark):
    root = scratch_path(spark, "queue")
    lines = _lines(spark, ("a", [(1, "one")]), ("b", [(1, "two")]), ("long", [(i, "x") for i in range(101)]))
    parts = R.request_lines(RQ.requests_from_chapters(chapters_df(spark, [(1, "p")], "parts"), "L", 1)
                            .withColumn("output_format", F.lit(None).cast("string")))
    queue.drain_intake(lines.unionByName(lines).unionByName(parts), root)
    assert sorted(r.book_id for r in queue.accepted(spark, root).collect()) == ["a", "b"]
    assert {(r.book_id, r.reject_reason) for r in queue.refused(spark, root).collect()} == {
        ("long", "Maximum 100 chapters allowed"), ("parts", RQ.IN_PARTS)}
    mine = queue.waiting(spark, root).where("book_id = 'a'").select(F.col("job_id").alias("submission"))
    queue.claims(spark, root).claim(mine, "died")
    assert [r.book_id for r in queue.waiting(spark, root).collect()] == ["b"]
    assert queue.run_waiting(spark, root, "next") == ["died", "next"]
    assert queue.run_waiting(spark, root, "idle") == []
    assert sorted((r.run, r.book_id) for r in queue.runs(spark, root).read("jobs").collect()) == [("died", "a"), ("next", "b")]
    queue.drain_intake(lines, root)                         # landed again later: another stream, the same ledger
    assert queue.accepted(spark, root).count() == 2


def test_a_failing_stage_leaves_its_row_and_goes_on_failing(spark):
    log = RunLog(RunStore(spark, scratch_path(spark, "log")), "r")
    df = spark.range(100)
    with log.stage("copy", "ids") as s:
        s.watch(df, n=F.count("*"), top=F.max("id")).write.parquet(scratch_path(spark, "ids"))
    with pytest.raises(PySparkException):
        with log.stage("check", "ids") as s:
            s.watch(df, n=F.count("*")).select(F.assert_true(F.col("id") < 50, "too large")).collect()
    rows = {(r.stage, r.status): r for r in log.read().collect()}
    assert set(rows) == {("copy", "started"), ("copy", "finished"), ("check", "started"), ("check", "failed")}
    assert rows["copy", "finished"].metrics == {"n": 100, "top": 99} and rows["copy", "finished"].seconds > 0
    assert "too large" in rows["check", "failed"].error and rows["check", "failed"].metrics is None


def test_streams_are_logged_by_batch(spark):
    log = RunLog(RunStore(spark, scratch_path(spark, "log")), "r")
    landing = scratch_path(spark, "in")
    for k in range(2):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(landing)
    listener = ProgressLog(log)
    spark.streams.addListener(listener)
    try:
        src = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(landing)
        stream._drain(src.writeStream.format("parquet").option("path", scratch_path(spark, "out")), scratch_path(spark, "ckpt"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    listener.flush()
    assert sum(r.metrics["n_input"] for r in log.read().collect() if r.metrics) == 20


def test_segments_are_the_book_text_and_a_range_reads_its_part(spark):
    ch = chapters_df(spark, [(1, "é" * 4000), (2, "b" * 3500), (3, "")], "x").unionByName(chapters_df(spark, [(1, "y")], "y"))
    els = layout.docx_elements(layout.chapter_positions(ch))
    whole = {r.book_id: r.text + "\n" for r in layout.render_text(els).collect()}
    at = scratch_path(spark, "segments")
    layout.write_segments(layout.book_segments(els), at)
    seg = spark.read.parquet(at)
    for book, text in whole.items():
        mine = seg.where(F.col("book_id") == book).orderBy("start").collect()
        assert "".join(r.text for r in mine) == text
        data = text.encode()
        assert [r.start for r in mine] == [sum(m.n_bytes for m in mine[:i]) for i in range(len(mine))]
        for a, b in ((0, 10), (3, 7000), (5999, 8100), (len(data) - 4, len(data) + 50), (7, 7)):
            got = layout.read_range(seg, book, a, b).orderBy("start").collect()
            assert b"".join(bytes(r.bytes) for r in got) == data[a:b]


def test_faulty_chapters_are_marked_and_the_others_go_on(spark):
    ch = chapters_df(spark, [(1, "one\n\ntwo"), (2, "bell \x07"), (3, None), (4, "tab\tand\r\nline � fine"), (5, "￾")])
    broken = ch.where("id = 1").withColumns({"id": F.lit(6).cast("bigint"), "ordinal": F.lit(9).cast("bigint"),
                                             "content": F.expr("cast(X'EDA08061' as string)")})
    ch = ch.unionByName(broken)
    els = layout.pdf_elements(layout.chapter_positions(ch, paragraphs=True)).collect()
    marked = {r.chapter_id: r.element_error for r in els if r.element_error}
    assert marked == {2: layout.BAD_CHARACTER, 3: layout.NO_CONTENT, 5: layout.BAD_CHARACTER, 6: layout.NOT_UNICODE}
    assert {r.chapter_id for r in els if r.kind == "body"} == {1, 4} and len({r.chapter_id for r in els if r.kind == "title"}) == 6
    assert sorted(r.seq for r in els) == list(range(1, len(els) + 1))
