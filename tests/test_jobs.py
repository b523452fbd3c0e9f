"""Job event reduction, status views and the download gate on inline event fixtures."""
import datetime as dt

from pyspark.sql import functions as F

from vellum import config as C
from vellum.operators import jobs, layout, metrics

from conftest import chapters_df

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
SCHEMA = ("job_id bigint, event_id bigint, ts timestamp_ntz, status string, progress double, "
          "message string, file_path string, current_chapter int, total_chapters int")


def ev(job, eid, sec, status, progress, msg, path=None, total=None):
    return (job, eid, T0 + dt.timedelta(seconds=sec), status, progress, msg, path, None, total)


def fx_jobs(spark):
    rows = [
        ev(1, 1, 0, "queued", 0.0, C.MSG_QUEUED, total=3), ev(1, 2, 1, "translating", 0.1, C.MSG_TRANSLATING),
        ev(1, 3, 5, "formatting", 0.7, C.MSG_FORMATTING),
        ev(1, 4, 6, "completed", 1.0, C.MSG_COMPLETED, "output/1.docx"),
        ev(2, 5, 0, "queued", 0.0, C.MSG_QUEUED, total=2), ev(2, 6, 1, "translating", 0.1, C.MSG_TRANSLATING),
        ev(2, 7, 3, "error", None, "Erro: boom"),
        ev(3, 8, 0, "queued", 0.0, C.MSG_QUEUED), ev(3, 9, 2, "formatting", 0.7, C.MSG_FORMATTING),
        ev(3, 10, 4, "error", None, "Erro: layout"),
        ev(4, 11, 0, "completed", 1.0, C.MSG_COMPLETED),                      # no path
        ev(5, 13, 0, "translating", 0.1, C.MSG_TRANSLATING),
        ev(5, 12, 0, "queued", 0.0, C.MSG_QUEUED),                             # same ts: event id decides
        ev(6, 14, 0, "completed", 1.0, C.MSG_COMPLETED, "output/6.pdf"),      # file gone
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_latest_state_last_write_wins_per_field(spark):
    st = {r.job_id: r for r in jobs.latest_state(fx_jobs(spark)).collect()}
    assert (st[1].status, st[1].progress, st[1].file_path, st[1].total_chapters) == \
        ("completed", 1.0, "output/1.docx", 3)
    assert (st[2].status, st[2].progress, st[2].message) == ("error", 0.1, "Erro: boom")
    assert (st[3].status, st[3].progress) == ("error", 0.7)
    assert st[5].status == "translating"


def test_open_jobs_and_errors(spark):
    st = jobs.latest_state(fx_jobs(spark))
    assert {r.job_id for r in jobs.open_jobs(st).collect()} == {5}
    assert {r.job_id for r in jobs.job_errors(st).collect()} == {2, 3}


def test_download_gate_outcomes_in_order(spark):
    st = jobs.latest_state(fx_jobs(spark))
    probes = spark.createDataFrame([(i,) for i in [1, 2, 4, 6, 99]], "job_id bigint")
    listing = spark.createDataFrame([("output/1.docx",)], "path string")
    got = {r.job_id: (r.http_status, r.detail, r.filename)
           for r in jobs.download_gate(probes, st, listing).collect()}
    assert got == {1: (200, None, "livro_traduzido.docx"),
                   2: (400, "Translation job not completed yet", None),
                   4: (404, "Output file not found", None),
                   6: (404, "Output file not found on server", None),
                   99: (404, "Translation job not found", None)}


def test_missing_job_reads_as_completed_only_in_client_view(spark):
    st = jobs.latest_state(fx_jobs(spark))
    probes = spark.createDataFrame([(99,), (5,)], "job_id bigint")
    got = {r.job_id: (r.status, r.progress, r.current_chapter, r.total_chapters)
           for r in jobs.status_with_default(probes, st).collect()}
    assert got == {99: ("completed", 1.0, 1, 1), 5: ("translating", 0.1, 0, 0)}
    assert jobs.lookup(probes, st).count() == 1
    assert [r.job_id for r in jobs.lookup_missing(probes, st).collect()] == [99]


def test_stage_durations_and_text(spark):
    d = {r.event_id: (r.prev_status, r.duration_s, r.duration_text)
         for r in jobs.stage_durations(fx_jobs(spark), bounded=False).collect()}
    assert d[1] == (None, None, None)
    assert d[3] == ("translating", 4.0, "4.0000")
    assert d[13][0] == "queued" and d[13][1] == 0.0


def test_submit_and_progress(spark):
    books = spark.createDataFrame([("b1", 3)], "book_id string, n_chapters bigint")
    j = jobs.submit_jobs(books, "chapters", "Português", "docx").first()
    assert (j.status, j.progress, j.current_chapter, j.total_chapters) == ("queued", 0.0, 0, 3)
    f = jobs.submit_jobs(books, "files", "Português", "docx").first()
    assert (f.status, f.target_language) == ("pending", None)
    body = jobs.submission_response(jobs.submit_jobs(books, "files", "Português", "docx")).first().body
    assert '"chapters_extracted":3' in body and '"status":"pending"' in body


def test_lifecycle_events_for_a_good_and_a_failed_book(spark):
    books = spark.createDataFrame([("ok", 2), ("bad", 1)], "book_id string, n_chapters bigint")
    job_rows = jobs.submit_jobs(books, "chapters", "Português", "pdf")
    outcomes = spark.createDataFrame([("ok", False, None), ("bad", True, "boom")],
                                     "book_id string, failed boolean, error string")
    ids = {r.book_id: r.job_id for r in job_rows.collect()}
    ev_rows = jobs.lifecycle_events(job_rows, outcomes).collect()
    by_job = {}
    for r in sorted(ev_rows, key=lambda r: r.seq):
        by_job.setdefault(r.job_id, []).append(r)
    assert [r.status for r in by_job[ids["ok"]]] == ["queued", "translating", "formatting", "completed"]
    assert [r.status for r in by_job[ids["bad"]]] == ["queued", "translating", "error"]
    assert by_job[ids["bad"]][-1].message.endswith("boom") and by_job[ids["bad"]][-1].progress is None
    done = by_job[ids["ok"]][-1]
    assert done.progress == 1.0 and done.file_path.endswith(f"{ids['ok']}.pdf")
    # the events reduce to the terminal state
    st = {r.job_id: r.status for r in jobs.latest_state(
        job_rows.select("job_id").join(jobs.lifecycle_events(job_rows, outcomes), "job_id")
        .withColumn("event_id", F.col("seq").cast("bigint"))
        .withColumn("ts", F.lit(T0) + F.make_interval(secs=F.col("seq")))
        .withColumn("current_chapter", F.lit(None).cast("int"))
        .withColumn("total_chapters", F.lit(None).cast("int"))).collect()}
    assert st == {ids["ok"]: "completed", ids["bad"]: "error"}


def test_run_log_first_last_and_elapsed(spark):
    got = {r.job_id: (r.n_events, r.first_status, r.last_status, r.elapsed_text)
           for r in metrics.run_log(fx_jobs(spark)).collect()}
    assert got[1] == (4, "queued", "completed", "6.0000")
    assert got[5] == (2, "queued", "translating", "0.0000")       # same ts: event id orders


def test_stage_durations_blocked_equal_plain_window(spark):
    cols = ["job_id", "event_id", "prev_status", "duration_text"]
    a = jobs.stage_durations(fx_jobs(spark), bounded=False).select(*cols).collect()
    b = jobs.stage_durations(fx_jobs(spark), bounded=True).select(*cols).collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_translate_progress_per_chapter(spark):
    pos = layout.chapter_positions(chapters_df(spark, [(3, "c"), (1, "a"), (2, "b"), (4, "d")]))
    got = sorted((r.id, round(r.progress, 9), r.current_chapter)
                 for r in jobs.translate_progress(pos).collect())
    assert got == [(1, 0.1, 1), (2, 0.25, 2), (3, 0.4, 3), (4, 0.55, 4)]


def test_metrics_long_stacks_columns(spark):
    wide = spark.createDataFrame([("b", 2, 5)], "book_id string, n_chapters int, n_pages bigint")
    got = sorted((r.metric, r.value) for r in metrics.metrics_long(wide, ["n_chapters", "n_pages"]).collect())
    assert got == [("n_chapters", 2), ("n_pages", 5)]
