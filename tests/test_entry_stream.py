"""Driver contract, oracle agreement on the small tables, and stream = batch."""
import duckdb

import __spark_entry__ as E
from vellum.plans import registry as R
from vellum.streaming import stream

SF = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def _duck(sql):
    con = duckdb.connect()
    for t in ["documents", "conversations", "pages", "events", "customer", "orders"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return cols, res.fetchall()


def _same(spark, name):
    df = E.queries()[name](spark, SF)
    cols, rows = _duck(E.oracle_sql()[name])
    got = sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())
    exp = sorted(tuple(str(x) for x in r) for r in rows)
    return got == exp


def test_some_oracles(spark):
    for name in ["flagship_translate_books", "docx_elements", "latest_job_state", "extract_pages"]:
        assert _same(spark, name), name


def test_stream_state_equals_batch_and_replay_adds_nothing(spark):
    s = {r.job_id: (r.status, r.progress, r.file_path) for r in stream.job_state_query(spark, SF).collect()}
    b = {r.job_id: (r.status, r.progress, r.file_path) for r in R.latest_job_state(spark, SF).collect()}
    assert s == b


def test_available_now_rerun_is_idempotent(spark):
    from vellum.session import scratch_path
    sink, ckpt = scratch_path(spark, "t-sink"), scratch_path(spark, "t-ckpt")
    for _ in range(2):
        w = stream.conversation_chapters_stream(spark, SF).writeStream.format("parquet").option("path", sink)
        stream._drain(w, ckpt)
    assert spark.read.parquet(sink).count() == 87


def _requests(spark):
    from vellum.sources import requests
    return requests.requests_from_chapters(R.convs(spark, SF), R.LANG, None)


def test_replayed_batch_overwrites_its_output(spark):
    from vellum.session import scratch_path
    sink, landing = scratch_path(spark, "t-replay"), scratch_path(spark, "t-requests")
    _requests(spark).write.json(landing)
    from vellum.sources import requests
    batch = requests.read_requests(spark, landing)
    run = stream.run_batches(sink)
    run(batch, 0)
    once = spark.read.parquet(f"{sink}/elements").count()
    run(batch, 0)                                # the same batch id again (replay after failure)
    assert spark.read.parquet(f"{sink}/elements").count() == once > 0


def test_stream_publishes_no_part_of_a_failed_book(spark):
    """Two batches, one book each; a failing chapter in the second takes its whole book."""
    from vellum.operators import translate
    from vellum.session import scratch_path
    landing, sink, ckpt = (scratch_path(spark, f"t-{n}") for n in ("books", "books-out", "books-ckpt"))
    from vellum.sources import requests
    from conftest import chapters_df

    class FailsOnWord:
        def translate(self, text, target_language, *, key=None, attempt=1):
            if "FAIL" in text:
                raise RuntimeError("refused")
            return text

    for book, rows in (("good", [(1, "one"), (2, "two")]), ("bad", [(1, "fine"), (2, "FAIL")])):
        requests.requests_from_chapters(chapters_df(spark, rows, book), "Francês", None).coalesce(1).write.mode(
            "append").json(landing)
    w = stream.request_stream(spark, landing, 1).writeStream.foreachBatch(
        stream.run_batches(sink, FailsOnWord(), sleep=translate.no_sleep))
    stream._drain(w, ckpt)
    assert {r.book_id for r in spark.read.parquet(f"{sink}/elements").collect()} == {"good"}
    events = spark.read.parquet(f"{sink}/events").collect()
    assert sorted({r.status for r in events if r.seq == 2}) == ["error", "formatting"]
    assert len({r.batch_id for r in events}) == 2


def test_processing_time_pipeline_drains_landing(spark):
    from vellum.session import scratch_path
    landing = scratch_path(spark, "t-landing")
    _requests(spark).write.json(landing)
    sink, ckpt = scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt")
    q = stream.start_pipeline(spark, landing, sink, ckpt, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{sink}/elements").select("book_id").distinct().count() == \
        spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
