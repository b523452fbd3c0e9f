"""Job table: submission rows, the event log, its reduction to the latest state,
status views, lookups and the download gate.

A job's state is "last write wins per field": every event sets status and message,
all but errors set progress, only completion sets the file path.  The reduction is a
``groupBy(job).agg(max_by ...)``: partial aggregation first, so a job with a huge
number of events never moves its rows into one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as T
from .scan import previous_values, running_sums

EVENT_ORDER = ["ts", "event_id"]


def submit_jobs(books: DataFrame, intake: str, target_language: str | Column,
                output_format: str | Column = "docx", submission: str | Column = "0") -> DataFrame:
    """Accepted book (book_id, n_chapters) -> job row.  ``submission`` tells submissions of
    one book apart: a book sent again under another one is another job.  Typed chapters are 'queued' and
    keep language and format; extracted files are 'pending' and keep neither."""
    lang = target_language if isinstance(target_language, Column) else F.lit(target_language)
    fmt = output_format if isinstance(output_format, Column) else F.lit(output_format)
    chapters_route = intake == "chapters"
    sent = submission if isinstance(submission, Column) else F.lit(submission)
    return books.select(
        T.job_id_hash(F.lit(intake), "book_id", lang, fmt, sent).alias("job_id"),
        "book_id",
        F.lit(intake).alias("intake"),
        F.lit(C.STATUS_QUEUED if chapters_route else C.STATUS_PENDING).alias("status"),
        F.lit(0.0).alias("progress"),
        F.lit(0).alias("current_chapter"),
        F.col("n_chapters").cast("int").alias("total_chapters"),
        F.lit(C.MSG_QUEUED if chapters_route else C.MSG_PENDING).alias("message"),
        (lang if chapters_route else F.lit(None).cast("string")).alias("target_language"),
        (fmt if chapters_route else F.lit(None).cast("string")).alias("output_format"),
    )


def submission_response(jobs: DataFrame) -> DataFrame:
    """Response body per accepted submission, as JSON text."""
    chapters_route = F.col("intake") == "chapters"
    body_chapters = F.to_json(F.struct(
        F.col("job_id"), F.col("status"), F.lit(C.MSG_SUBMITTED).alias("message"),
        T.status_url("job_id").alias("file_url")))
    body_files = F.to_json(F.struct(
        F.col("job_id"), F.col("status"), F.lit(C.MSG_PENDING).alias("message"),
        T.status_url("job_id").alias("file_url"),
        F.col("total_chapters").alias("chapters_extracted")))
    return jobs.select("job_id", "book_id", "intake",
                       F.when(chapters_route, F.lit(200)).otherwise(F.lit(202))
                       .alias("http_status"),
                       F.when(chapters_route, body_chapters).otherwise(body_files).alias("body"))


def latest_state(events: DataFrame) -> DataFrame:
    """Reduce job events (job_id, event_id, ts, status, progress, message, file_path,
    current_chapter, total_chapters) to one row per job."""
    order = F.struct(*[F.col(c) for c in EVENT_ORDER])

    def last_set(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))

    return events.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("message", order).alias("message"),
        F.max_by("event_id", order).alias("last_event_id"),
        F.coalesce(last_set("progress"), F.lit(0.0)).alias("progress"),
        last_set("file_path").alias("file_path"),
        F.coalesce(last_set("current_chapter"), F.lit(0)).alias("current_chapter"),
        F.coalesce(last_set("total_chapters"), F.lit(0)).alias("total_chapters"),
        F.count("*").alias("n_events"),
    )


def status_view(state: DataFrame) -> DataFrame:
    return state.select("job_id", "status", "progress", "current_chapter", "total_chapters",
                        "message")


def is_terminal(status: Column) -> Column:
    """Completed ends a job; unlike the polling client, an error is terminal too."""
    return status.isin(C.STATUS_COMPLETED, C.STATUS_ERROR)


def open_jobs(state: DataFrame) -> DataFrame:
    return state.where(~is_terminal(F.col("status"))).select("job_id", "status", "progress")


def job_errors(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == C.STATUS_ERROR).select("job_id", "message", "progress")


def lookup(probes: DataFrame, state: DataFrame) -> DataFrame:
    return probes.join(status_view(state), "job_id", "inner")


def lookup_missing(probes: DataFrame, state: DataFrame) -> DataFrame:
    return (probes.join(state.select("job_id"), "job_id", "left_anti")
                  .withColumns({"http_status": F.lit(C.GATE_UNKNOWN[0]),
                                "detail": F.lit(C.GATE_UNKNOWN[1])}))


def status_with_default(probes: DataFrame, state: DataFrame) -> DataFrame:
    """Client behaviour: an unknown job reads as completed (opt-in; off in the server)."""
    v = status_view(state).withColumn("_found", F.lit(True))
    j = probes.join(v, "job_id", "left")
    missing = F.col("_found").isNull()
    return j.select(
        "job_id",
        F.when(missing, F.lit(C.STATUS_COMPLETED)).otherwise(F.col("status")).alias("status"),
        F.when(missing, F.lit(1.0)).otherwise(F.col("progress")).alias("progress"),
        F.when(missing, F.lit(1)).otherwise(F.col("current_chapter")).alias("current_chapter"),
        F.when(missing, F.lit(1)).otherwise(F.col("total_chapters")).alias("total_chapters"),
        F.when(missing, F.lit(C.MSG_MISSING_AS_DONE)).otherwise(F.col("message")).alias("message"),
    )


def download_gate(probes: DataFrame, state: DataFrame, listing: DataFrame) -> DataFrame:
    """Outcome per requested job, first failing check wins: unknown job, not completed,
    no path, file missing from the listing (``path`` column), else the download name."""
    s = state.select("job_id", "status", "file_path", F.lit(True).alias("_known"))
    files = listing.select(F.col("path").alias("file_path"), F.lit(True).alias("_exists")).distinct()
    # The listing meets the job states that have a path, then the probes: an unknown job
    # never carries a NULL path into a join.
    found = s.where(F.col("file_path").isNotNull()).join(files, "file_path").select("job_id", "_exists")
    j = probes.join(s, "job_id", "left").join(found, "job_id", "left")
    gate = (F.when(F.col("_known").isNull(), F.lit(C.GATE_UNKNOWN[1]))
             .when(F.col("status") != C.STATUS_COMPLETED, F.lit(C.GATE_NOT_DONE[1]))
             .when(F.col("file_path").isNull(), F.lit(C.GATE_NO_PATH[1]))
             .when(F.col("_exists").isNull(), F.lit(C.GATE_FILE_GONE[1])))
    code = (F.when(F.col("_known").isNull(), F.lit(C.GATE_UNKNOWN[0]))
             .when(F.col("status") != C.STATUS_COMPLETED, F.lit(C.GATE_NOT_DONE[0]))
             .when(F.col("file_path").isNull(), F.lit(C.GATE_NO_PATH[0]))
             .when(F.col("_exists").isNull(), F.lit(C.GATE_FILE_GONE[0]))
             .otherwise(F.lit(200)))
    return j.select("job_id", code.alias("http_status"), gate.alias("detail"),
                    F.when(gate.isNull(), T.download_name("file_path")).alias("filename"))


def stage_durations(events: DataFrame, *, bounded: bool = False) -> DataFrame:
    """Seconds since the job's previous event, also as text with 4 decimals."""
    prev = previous_values(events, ["job_id"], EVENT_ORDER,
                           {"prev_ts": "ts", "prev_status": "status"}, bounded=bounded)
    micros = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts"))
    return prev.select("job_id", "event_id", "status", "prev_status",
                       (micros / F.lit(1e6)).alias("duration_s"),
                       T.fixed_decimal(micros, 1000000, 4).alias("duration_text"))


def translate_progress(positioned: DataFrame) -> DataFrame:
    """Progress while translating chapter ``ch_idx`` of ``n``: 0.1 + 0.6 * idx / n,
    current chapter idx + 1, message with the chapter id."""
    idx = F.col("ch_idx").cast("double")
    n = F.col("n_chapters").cast("double")
    return positioned.select(
        "book_id", "id", "ordinal",
        (F.lit(C.PROGRESS_TRANSLATE_START) + F.lit(C.PROGRESS_TRANSLATE_SPAN) * (idx / n))
        .alias("progress"),
        (F.col("ch_idx") + 1).cast("int").alias("current_chapter"),
        T.chapter_message("id", "n_chapters").alias("message"),
    )


def chapter_events(jobs: DataFrame, finished: DataFrame, *, bounded: bool = False) -> DataFrame:
    """A ``translating`` row per chapter that was reached: step = its place in the book,
    progress by the share of chapters before it, message with its id.

    ``finished``: job_id, id, ordinal, failed per chapter.  A book goes on in chapter order until
    its first failure, so later chapters leave no row.  Places are running sums that do not
    gather a book (``scan``), or a plain window where books are known to be small (``bounded``)."""
    slim = finished.select("job_id", "id", "ordinal", "failed")
    placed = running_sums(slim, ["job_id"], ["id", "ordinal"],
                          {"ch_idx": F.lit(1), "_bad": F.when(F.col("failed"), 1).otherwise(0)},
                          totals={"n_chapters": "ch_idx"}, bounded=bounded)
    idx, n = F.col("ch_idx").cast("double"), F.col("n_chapters").cast("double")
    progress = F.lit(C.PROGRESS_TRANSLATE_START) + F.lit(C.PROGRESS_TRANSLATE_SPAN) * (idx / n)
    return placed.where(F.col("_bad") == 0).join(jobs.select("job_id"), "job_id", "left_semi").select(
        "job_id", F.lit(1).alias("seq"), (F.col("ch_idx") + 1).cast("int").alias("step"),
        F.lit(C.STATUS_TRANSLATING).alias("status"), progress.alias("progress"),
        T.chapter_message("id", "n_chapters").alias("message"), F.lit(None).cast("string").alias("file_path"),
        (F.col("ch_idx") + 1).cast("int").alias("current_chapter"), F.col("n_chapters").cast("int").alias("total_chapters"))


def lifecycle_events(jobs: DataFrame, outcomes: DataFrame, finished: DataFrame | None = None, *,
                     bounded: bool = False) -> DataFrame:
    """Event log of pipeline runs: submit -> translating -> formatting -> completed, or
    -> error with the translation error (progress stays where it was).  ``outcomes``: job_id
    (or book_id), failed, error.  With ``finished`` (see ``chapter_events``) the translating step goes on
    chapter by chapter.  Ordered by (seq, step)."""
    key = "job_id" if "job_id" in outcomes.columns else "book_id"
    j = jobs.join(outcomes.select(key, "failed", "error"), key, "left")
    failed = F.coalesce(F.col("failed"), F.lit(False))
    none = F.lit(None)

    def step(seq, status, progress, message, path, keep, current=none, total=none):
        return F.struct(F.lit(seq).alias("seq"), F.lit(0).alias("step"), status.alias("status"),
                        progress.cast("double").alias("progress"), message.alias("message"),
                        path.cast("string").alias("file_path"), current.cast("int").alias("current_chapter"),
                        total.cast("int").alias("total_chapters"), keep.alias("keep"))

    steps = F.array(
        step(0, F.col("status"), F.col("progress"), F.col("message"), none, F.lit(True), F.lit(0), F.col("total_chapters")),
        step(1, F.lit(C.STATUS_TRANSLATING), F.lit(C.PROGRESS[C.STATUS_TRANSLATING]),
             F.lit(C.MSG_TRANSLATING), none, F.lit(True)),
        step(2, F.lit(C.STATUS_ERROR), none, F.concat(F.lit(C.MSG_ERROR_PREFIX), F.col("error")),
             none, failed),
        step(2, F.lit(C.STATUS_FORMATTING), F.lit(C.PROGRESS[C.STATUS_FORMATTING]),
             F.lit(C.MSG_FORMATTING), none, ~failed),
        step(3, F.lit(C.STATUS_COMPLETED), F.lit(C.PROGRESS[C.STATUS_COMPLETED]),
             F.lit(C.MSG_COMPLETED),
             T.output_path("job_id", T.normalise_format(F.col("output_format"))), ~failed),
    )
    out = j.select("job_id", F.inline(F.filter(steps, lambda s: s["keep"]))).drop("keep")
    return out if finished is None else out.unionByName(chapter_events(jobs, finished, bounded=bounded))


def settled(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``completed`` only for jobs with an artifact: the row stays, with the artifact's path,
    where ``artifacts`` (job_id, path) holds one; a job without one stays at formatting."""
    done = F.col("status") == C.STATUS_COMPLETED
    paths = artifacts.select("job_id", F.col("path").alias("_path"))
    return (events.where(~done).unionByName(
        events.where(done).join(paths, "job_id").withColumn("file_path", F.col("_path")).drop("_path")))


def run_state(events: DataFrame) -> DataFrame:
    """``latest_state`` of a run's own events, which are ordered by (seq, step)."""
    return latest_state(events.withColumns({
        "ts": F.timestamp_seconds(F.col("seq")), "event_id": F.col("step").cast("bigint")}))
