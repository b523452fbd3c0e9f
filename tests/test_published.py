"""Runs published by manifest, ledgers, memory, waves, and jobs in their own language."""
import pytest
from pyspark.sql import functions as F

from vellum import config as C
from vellum.operators import chunking, jobs, translate
from vellum.operators.ledger import SubmissionLedger
from vellum.plans import pipeline
from vellum.session import scratch_path
from vellum.sinks import list_artifacts, read_artifacts, read_rejects, write_artifacts, write_rejects
from vellum.sources import requests as RQ
from vellum.store import BucketedTable, RunStore

from conftest import chapters_df


def rows(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def got(df):
    return sorted((r.run, r.x) for r in df.collect())


def test_only_published_attempts_are_seen_and_a_rerun_replaces_its_run(spark):
    s = RunStore(spark, scratch_path(spark, "store"))
    s.write(s.begin(), "t", rows(spark, 99))                    # died before it published
    assert s.read("t", "x int").count() == 0
    s.put("a", t=rows(spark, 1, 2, 3))
    s.put("b", t=rows(spark, 4))
    s.write(s.begin(), "t", rows(spark, 98))
    assert got(s.read("t")) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]
    s.put("a", t=rows(spark, 7))                                # smaller than what it replaces
    assert got(s.read("t")) == [("a", 7), ("b", 4)]
    s.compact("all", ["a", "b"])
    assert got(s.read("t")) == [("all", 4), ("all", 7)]
    s.put("c", t=rows(spark, 5).limit(0))
    assert got(s.read("t")) == [("all", 4), ("all", 7)]
    with pytest.raises(ValueError):
        s.read("other")


def test_a_bucketed_table_is_found_again_under_other_settings(spark):
    at = scratch_path(spark, "bucketed")
    t = BucketedTable(spark, at, "k string, v int", "k", 3)
    t.append(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    t.close()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = BucketedTable(spark, at, "k string, v int", "k")
        assert again.buckets == 3 and again.read().count() == 2
        again.append(spark.createDataFrame([("c", 3)], "k string, v int"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.v for r in t.spark.table(again.name).collect()) == [1, 2, 3]


def test_a_submission_belongs_to_the_first_run_that_claims_it(spark):
    at = scratch_path(spark, "ledger")
    subs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "submission string")     # noqa: E731
    names = lambda df: sorted(r.submission for r in df.collect())                         # noqa: E731
    one = SubmissionLedger(spark, at, 2)
    assert names(one.claim(subs("a", "b", "a", None), "r1")) == ["a", "b"]
    two = SubmissionLedger(spark, at)
    assert names(two.claim(subs("b", "c"), "r2")) == ["c"]
    assert names(two.claim(subs("a", "b"), "r1")) == ["a", "b"]         # r1 again after a failure
    assert names(two.claim(subs("b", "c"), "r2")) == ["c"]
    assert two.table.read().count() == 3


def test_artifacts_of_a_smaller_rerun_leave_nothing_of_the_first(spark):
    path = scratch_path(spark, "artifacts")
    els = spark.createDataFrame([(f"j{i}", s, "old") for i in range(50) for s in (1, 2)], "job_id string, seq bigint, text string")
    write_artifacts(els, path, "1")
    write_artifacts(els.where("job_id in ('j1', 'j2')").withColumn("text", F.lit("new")), path, "1")
    assert sorted((r.job_id, r.seq, r.text) for r in read_artifacts(spark, path).collect()) == [
        ("j1", 1, "new"), ("j1", 2, "new"), ("j2", 1, "new"), ("j2", 2, "new")]
    assert sorted((r.job_id, r.path, r.n_elements) for r in list_artifacts(spark, path).collect()) == [
        ("j1", "output/j1.docx", 2), ("j2", "output/j2.docx", 2)]


def test_rejects_of_a_run_done_again_count_once(spark):
    path = scratch_path(spark, "rejects")
    bad = spark.createDataFrame([("b", "why")], "book_id string, reject_reason string")
    for run in ("1", "1", "2"):
        write_rejects(bad, path, run)
    assert sorted(r.run for r in read_rejects(spark, path).collect()) == ["1", "2"]


def test_completed_is_what_was_written(spark):
    ch = chapters_df(spark, [(1, "one"), (2, "two")], "a").unionByName(chapters_df(spark, [(1, "x")], "b"))
    at = scratch_path(spark, "published")
    job = pipeline.run_jobs(ch)
    lost = job.jobs.where("book_id = 'b'").first().job_id
    broken = pipeline.JobRun(job.jobs, job.events, job.elements.where("book_id = 'a'"), job.rejects)
    store = pipeline.publish(broken, at, "r")
    state = {r.job_id: (r.status, r.file_path) for r in jobs.run_state(store.read("events")).collect()}
    assert state[lost] == (C.STATUS_FORMATTING, None)
    assert {s for k, (s, _) in state.items() if k != lost} == {C.STATUS_COMPLETED}
    gate = jobs.download_gate(job.jobs.select("job_id"), jobs.run_state(store.read("events")), list_artifacts(spark, at))
    assert {r.job_id: r.http_status for r in gate.collect()}[lost] == 400
    done = jobs.run_state(store.read("events")).where("status = 'completed'").first()
    assert (done.current_chapter, done.total_chapters, done.progress) == (2, 2, 1.0)


def _request(spark, book, texts, lang, fmt=None, key=None, part=None):
    ch = [(i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(book, part, ch, lang, fmt, key)],
                                 "book_id string, part bigint, chapters array<struct<id:bigint,content:string>>, "
                                 "target_language string, output_format string, submission_key string")


def test_requests_are_told_apart_by_what_they_ask_for(spark):
    ask = lambda *a, **k: _request(spark, *a, **k)        # noqa: E731
    req = ask("b", ["x", "y"], "L1")
    for other in (ask("b", ["x", "y"], "L1"), ask("b", ["x", "y"], "L1", "txt"),            # replays: txt means docx
                  ask("b", ["x", "y"], "L2"), ask("b", ["x", "y"], "L1", "pdf"), ask("b", ["x", "z"], "L1"),
                  ask("b", ["x", "y"], "L1", key="again"), ask("c", ["x", "y"], "L1"),
                  ask("p", ["one"], "L1", part=0), ask("p", ["two"], "L1", part=1), ask("p", ["two"], "L1", part=1)):
        req = req.unionByName(other)
    assert RQ.distinct_requests(req).count() == 8 and RQ.distinct_requests(req).select("submission").distinct().count() == 7
    ch = RQ.request_chapters(req)
    assert ch.count() == 6 * 2 + 2
    assert [(r.ordinal, r.content) for r in ch.where("book_id = 'p'").orderBy("ordinal").collect()] == [(0, "one"), (1, "two")]
    run = pipeline.run_jobs(ch)
    rows_ = run.jobs.collect()
    assert len({r.job_id for r in rows_}) == 7
    assert {(r.target_language, r.output_format) for r in rows_} == {("L1", "docx"), ("L2", "docx"), ("L1", "pdf")}
    els = run.elements.join(run.jobs.select("job_id", "target_language", "output_format"), "job_id").collect()
    assert len({r.job_id for r in els}) == 7 and {r.book_id for r in els} == {"b", "c", "p"}
    assert {r.kind for r in els if r.output_format == "pdf"} == {"break", "title", "spacer", "body", "gap"}
    assert {r.text for r in els if r.target_language == "L2" and r.kind == "dropcap"} == {"["}
    assert {r.text for r in els if r.target_language == "L2" and r.kind == "body"} == {"L2] k", "L2] l"}
    assert len({(r.job_id, r.seq) for r in els}) == len(els)


def test_chapter_events_stop_at_the_first_failure(spark):
    job_rows = spark.createDataFrame([("j",), ("k",)], "job_id string")
    done = spark.createDataFrame([("j", i, i, i in (3, 5)) for i in range(1, 7)] + [("k", 1, 1, False), ("other", 1, 1, False)],
                                 "job_id string, id bigint, ordinal bigint, failed boolean")
    ev = sorted((r.job_id, r.step, round(r.progress, 6), r.current_chapter, r.message) for r in
                jobs.chapter_events(job_rows, done).collect())
    assert [e[:4] for e in ev] == [("j", 1, 0.1, 1), ("j", 2, 0.2, 2), ("j", 3, 0.3, 3), ("k", 1, 0.1, 1)]
    assert ev[2][4] == "Traduzindo capítulo 3/6..."


def counting(path, bad=()):
    """A model that appends a line per call to a file which the workers share."""
    class Counting:
        def translate(self, text, target_language, *, key=None, attempt=1):
            with open(path, "a") as f:
                f.write(text[:20] + "\n")
            if any(b in text for b in bad):
                raise RuntimeError("refused")
            return f"{target_language}:{text}"
    return Counting()


def calls(path):
    try:
        return len(open(path).readlines())
    except FileNotFoundError:
        return 0


def test_the_memory_answers_what_was_translated_before(spark, tmp_path):
    memory = translate.TranslationMemory(spark, scratch_path(spark, "memory"), 2)
    ch = chapters_df(spark, [(1, "same"), (2, "same"), (3, "  "), (4, "BAD"), (5, "other")])
    chunks = chunking.chunk_chapters(ch)

    def run(log, texts=chunks, lang="L", bad=("BAD",)):
        out = translate.translate_chunks(texts, counting(str(tmp_path / log), bad), target_language=lang, memory=memory,
                                         sleep=translate.no_sleep)
        return {r.id: (r.translated, r.attempts) for r in out.collect()}, calls(tmp_path / log)

    first, n = run("1")
    assert n == 2 + 4 and first[1] == first[2] == ("L:same", 1) and first[3] == ("", 0) and first[4] == (None, 4)
    second, n = run("2")
    assert n == 4 and {k: v[0] for k, v in second.items()} == {k: v[0] for k, v in first.items()}     # BAD is tried again
    assert second[1] == ("L:same", 0)
    third, n = run("3", bad=())
    assert n == 1 and third[4] == ("L:BAD", 1)
    assert run("4", bad=())[1] == 0
    assert run("5", lang="M", bad=())[1] == 3                                                        # another language


def test_waves_stop_a_failed_book_and_a_rerun_goes_on_where_it_stopped(spark, tmp_path):
    ch = chapters_df(spark, [(1, "".join(f"{i:03d}" + ("!" if i == 9 else ".") for i in range(100)))], "bad").unionByName(
        chapters_df(spark, [(1, "".join(f"{i:03d}." for i in range(40)))], "good")).unionByName(chapters_df(spark, [(1, "")], "none"))
    chunks = chunking.chunk_chapters(ch, 4)
    store = RunStore(spark, scratch_path(spark, "waves"))

    def run(log):
        out = translate.translate_in_waves(chunks, counting(str(tmp_path / log), ("!",)), store=store, run="r", first=4,
                                           target_language="L", sleep=translate.no_sleep)
        return out, calls(tmp_path / log)

    out, n = run("1")
    # Waves of 4 and 8: the tenth chunk fails (four attempts), nothing after the twelfth is sent.
    assert n == 12 + 3 + 40
    got_ = out.groupBy("book_id").agg(F.count("*").alias("n"), F.max("wave").alias("w"), F.bool_or(F.col("error").isNotNull()).alias("bad"))
    assert {r.book_id: (r.n, r.w, r.bad) for r in got_.collect()} == {"bad": (12, 1, True), "good": (40, 3, False), "none": (1, 0, False)}
    again, n = run("2")
    assert n == 0 and again.count() == 53
