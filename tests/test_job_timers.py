"""Timers, replays and late events, over several micro-batches."""
from datetime import datetime, timedelta

from vellum import config as C
from vellum.session import scratch_path
from vellum.streaming import job_timers as J, stream

T0 = datetime(2024, 1, 1)
SCHEMA = ("job_id long, event_id long, ts timestamp, status string, message string, progress double, file_path string, "
          "current_chapter int, total_chapters int")
HOUR = 3_600_000


def ev(job, eid, hours, status, **kw):
    return (job, eid, T0 + timedelta(hours=hours), status, kw.get("message", status), kw.get("progress"), kw.get("path"),
            kw.get("chapter"), kw.get("total"))


def run(spark, batches, **options):
    """Rows per batch, in order, and the final state by job."""
    landing, sink = scratch_path(spark, "timers-in"), scratch_path(spark, "timers-out")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
    with J.rocksdb(spark):
        out = J.timed_job_stream(src, **{"delay": "1 hour", "stuck_ms": 5 * HOUR, "expiry_ms": 10 * HOUR, **options})

        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        stream._drain(out.writeStream.outputMode("update").foreachBatch(write), scratch_path(spark, "timers-ckpt"))
    rows = spark.read.parquet(sink)
    return rows.collect(), {r.job_id: r for r in J.last_rows(rows).collect()}


def test_replays_stuck_jobs_and_late_events(spark):
    q, t, f, c = C.STATUS_QUEUED, C.STATUS_TRANSLATING, C.STATUS_FORMATTING, C.STATUS_COMPLETED
    first = [ev(1, 1, 0, q, total=3), ev(1, 2, 1, t, progress=0.1), ev(1, 2, 1, t, progress=0.1), ev(2, 10, 0, q), ev(3, 20, 2, q),
             ev(4, 30, 0, q), ev(4, 31, 1, c, progress=1.0, path="output/4.docx")]
    second = [ev(1, 2, 1, t, progress=0.1), ev(1, 3, 2, f, progress=0.7), ev(3, 21, 3, t)]       # event 2 once more
    third = [ev(9, 90, 40, q)]                                                                  # time goes on
    fourth = [ev(2, 11, 40, t), ev(4, 32, 41, t), ev(9, 91, 41, c)]                             # after timeout, after expiry
    fifth = [ev(4, 33, 60, q), ev(9, 92, 61, t)]
    rows, last = run(spark, [first, second, third, fourth, fifth])
    assert (last[1].status, last[1].n_events, last[1].closed) == (C.STATUS_ERROR, 3, True)
    assert (last[1].progress, last[1].total_chapters) == (0.7, 3)
    assert last[1].message == J.STUCK_MESSAGE.format(s=5 * 3600)
    assert (last[2].status, last[2].n_events) == (C.STATUS_ERROR, 1) and last[3].status == C.STATUS_ERROR
    assert (last[4].status, last[4].n_events, last[4].file_path) == (c, 2, "output/4.docx")
    assert (last[9].status, last[9].n_events) == (c, 2)
    assert not [r for r in rows if r.job_id in (2, 4) and r.batch_id >= 3 and r.status == t]


def test_the_cut_into_batches_does_not_matter(spark):
    events = [ev(j, 100 * j + k, h, s) for j, hs in enumerate([(0, 1, 9), (0, 3, 7, 8), (0, 6), (2, 3, 4, 30)])
              for k, (h, s) in enumerate(zip(hs, ["queued", "translating", "formatting", "completed"]))]
    events += [ev(50, 9000, 100, "queued"), ev(51, 9001, 101, "queued")]
    events.sort(key=lambda e: e[2])
    view = lambda last: {k: (r.status, r.n_events, r.closed) for k, r in last.items() if k < 50}       # noqa: E731
    whole = view(run(spark, [events[:-1], events[-1:]])[1])
    parts = view(run(spark, [events[i:i + 3] for i in range(0, len(events), 3)])[1])
    assert whole == parts == {0: ("error", 2, True), 1: ("completed", 4, True), 2: ("error", 1, True), 3: ("error", 3, True)}


def test_processing_time_with_a_ttl(spark):
    events = [ev(1, 1, 0, "queued"), ev(1, 2, 1, "translating", progress=0.1), ev(2, 3, 0, "queued"), ev(2, 4, 1, "completed")]
    _, last = run(spark, [events, events, [ev(1, 5, 2, "formatting"), ev(2, 6, 3, "queued")]], ttl_ms=HOUR)
    assert {k: (r.status, r.n_events) for k, r in last.items()} == {1: ("formatting", 3), 2: ("completed", 2)}


def test_apply_event_keeps_the_newest_field_values():
    e = lambda ms, i, **kw: {"ms": ms, "event_id": i, "status": "translating", "message": "m", "progress": None,     # noqa: E731
                             "file_path": None, "current_chapter": None, "total_chapters": None, **kw}
    s, _ = J.apply_event(None, e(10, 1, progress=0.3, total_chapters=4), 100)
    s, _ = J.apply_event(s, e(5, 2, progress=0.1, status="queued", current_chapter=1), 100)      # older, later
    assert (s["progress"], s["status"], s["current_chapter"], s["last_ms"], s["n_events"]) == (0.3, "translating", 1, 10, 2)
    s, taken = J.apply_event(s, e(111, 3), 100)
    assert not taken and s["closed"] and s["status"] == C.STATUS_ERROR
