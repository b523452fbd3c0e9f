"""A queue between accepting and running.

The accepting stream answers every request at once: a job row and its chapters, or a reject
row, published per micro-batch.  The running side reads jobs that no run has claimed, claims
them for a run of its own and publishes what it made.  Both sides remember what they took in a
ledger, so a batch or a run that died is done again with the same jobs, and no job runs twice.

Under ``root``: ``requests`` (ledger), ``intake`` (jobs, chapters, rejects by micro-batch), ``claims`` (ledger),
``runs`` (published runs).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import text as T
from ..operators import jobs, validate
from ..operators.ledger import SubmissionLedger
from ..plans import pipeline
from ..session import materialize, scratch_path
from ..sources import requests as RQ
from ..store import RunStore
from . import stream

JOB_SCHEMA = ("job_id string, book_id string, intake string, status string, progress double, current_chapter int, "
              "total_chapters int, message string, target_language string, output_format string")
REJECT_SCHEMA = "book_id string, target_language string, n_chapters bigint, reject_reason string"


def intake(spark: SparkSession, root: str) -> RunStore:
    return RunStore(spark, f"{root}/intake")


def runs(spark: SparkSession, root: str) -> RunStore:
    return RunStore(spark, f"{root}/runs")


def claims(spark: SparkSession, root: str) -> SubmissionLedger:
    return SubmissionLedger(spark, f"{root}/claims")


def accept_batches(root: str, opts: C.PipelineOptions = C.PipelineOptions()):
    """``foreachBatch`` function of the accepting stream."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark, name = batch.sparkSession, f"batch-{batch_id}"
        checked = RQ.schema_reject_reason(batch, whole=True)
        lines = RQ.distinct_requests(checked)
        # Written once: what follows would read and parse the batch again and again.
        mine = materialize(lines.join(SubmissionLedger(spark, f"{root}/requests").claim(lines, name), "submission", "left_semi"))
        bad = mine.where(F.col("schema_error").isNotNull()).select(
            "book_id", "target_language", F.lit(None).cast("bigint").alias("n_chapters"),
            F.col("schema_error").alias("reject_reason"))
        good = mine.where(F.col("schema_error").isNull()).drop("submission", "_content")
        ok, refused = validate.split_rejects(validate.request_reject_reason(good, opts.limits.max_chapters))
        # A submission in parts is refused by its lines together: one row.
        refused = refused.select("submission", "book_id", "target_language", "n_chapters", "reject_reason").distinct()
        chapters = RQ.request_chapters(ok.drop("submission")).withColumn(
            "output_format", T.normalise_format("output_format"))
        job = T.job_id_hash(F.lit("chapters"), "book_id", "target_language", "output_format", "submission")
        store = intake(spark, root)
        attempt = store.begin()
        written = store.write(attempt, "chapters", chapters.withColumn("job_id", job))
        books = written.groupBy("book_id", "target_language", "output_format", "submission").agg(
            F.count(F.lit(1)).alias("n_chapters"))
        store.write(attempt, "jobs", jobs.submit_jobs(books, "chapters", F.col("target_language"), F.col("output_format"),
                                                      F.col("submission")))
        store.write(attempt, "rejects", refused.drop("submission").unionByName(bad))
        store.publish(name, attempt)
    return run


def accepted(spark: SparkSession, root: str) -> DataFrame:
    return intake(spark, root).read("jobs", JOB_SCHEMA)


def refused(spark: SparkSession, root: str) -> DataFrame:
    return intake(spark, root).read("rejects", REJECT_SCHEMA)


def waiting(spark: SparkSession, root: str) -> DataFrame:
    """Accepted jobs that no run has claimed."""
    taken = claims(spark, root).table.read().select(F.col("submission").alias("job_id"))
    return accepted(spark, root).join(taken.hint("merge"), "job_id", "left_anti")


def run_waiting(spark: SparkSession, root: str, run: str, model=None, opts: C.PipelineOptions = C.PipelineOptions(),
                **options) -> list[str]:
    """First does again the runs that claimed jobs and never published (their driver died), then
    claims what is waiting for ``run``.  Returns the runs that were published."""
    ledger, out = claims(spark, root), []
    published = {r.run for r in runs(spark, root).runs().collect()}
    # One row per run.
    begun = {r.run for r in ledger.table.read().select("run").distinct().collect()}
    ledger.claim(waiting(spark, root).select(F.col("job_id").alias("submission")), run)
    for name in [*sorted(begun - published - {run}), run]:
        mine = ledger.table.read().where(F.col("run") == name).select(F.col("submission").alias("job_id"))
        if mine.limit(1).count():
            chapters = intake(spark, root).read("chapters").drop("run").join(mine.hint("merge"), "job_id", "left_semi")
            pipeline.publish(pipeline.run_jobs(chapters.drop("job_id"), model, opts, **options), f"{root}/runs", name)
            out.append(name)
    return out


def start_intake(spark: SparkSession, landing: str, root: str, checkpoint: str,
                 opts: C.PipelineOptions = C.PipelineOptions(), processing_time: str | None = stream.POLL_PERIOD):
    """The long-running accepting stream (drained once with ``processing_time=None``)."""
    w = (stream.request_stream(spark, landing).writeStream.foreachBatch(accept_batches(root, opts))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def drain_intake(lines: DataFrame, root: str, opts: C.PipelineOptions = C.PipelineOptions()) -> None:
    """Lands request lines (``value``, JSON text) in four files and accepts them two files at a
    time."""
    spark, landing = lines.sparkSession, scratch_path(lines.sparkSession, "queue-landing")
    lines.repartition(4).write.text(landing)
    w = stream.request_stream(spark, landing, 2).writeStream.foreachBatch(accept_batches(root, opts))
    stream._drain(w, scratch_path(spark, "queue-ckpt"))
