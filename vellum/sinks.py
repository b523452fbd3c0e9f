"""Sinks: artifacts by job, reject rows.  Both are published by run (``store.RunStore``): what
a run wrote is seen as a whole or not at all, and a run done again replaces itself."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .store import RunStore

INDEX_SCHEMA = "job_id string, path string, n_elements bigint, run string"


def artifact_rows(elements: DataFrame) -> DataFrame:
    """Element rows in files of even size (as many as the run needs, a huge job is split),
    sorted by job and sequence inside."""
    return elements.hint("rebalance", "job_id").sortWithinPartitions("job_id", "seq")


def artifact_index(written: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per artifact that was written: job_id, path, n_elements.  ``jobs`` (job_id,
    output_format) gives the extension."""
    per = written.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_elements"))
    if jobs is None:
        return per.select("job_id", T.output_path("job_id", F.lit("docx")).alias("path"), "n_elements")
    fmt = T.normalise_format(F.col("output_format"))
    return per.join(jobs.select("job_id", "output_format"), "job_id").select(
        "job_id", T.output_path("job_id", fmt).alias("path"), "n_elements")


def write_artifacts(elements: DataFrame, path: str, run: str, jobs: DataFrame | None = None) -> None:
    """Element rows of a run's jobs, with an index of the artifacts.  Writing a run again
    replaces all of it, also jobs that the second attempt does not have; other runs stay."""
    store = RunStore(elements.sparkSession, path)
    attempt = store.begin()
    written = store.write(attempt, "elements", artifact_rows(elements))
    store.write(attempt, "artifacts", artifact_index(written, jobs))
    store.publish(run, attempt)


def list_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, n_elements, run): each job's artifact of the latest run (largest name)
    that wrote one."""
    a = RunStore(spark, path).read("artifacts", INDEX_SCHEMA)
    return a.groupBy("job_id").agg(F.max_by(F.struct("path", "n_elements", "run"), "run").alias("a")).select("job_id", "a.*")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Each job's rows from the latest run (largest name) that wrote it."""
    last = list_artifacts(spark, path).select("job_id", "run")
    return RunStore(spark, path).read("elements").join(last, ["job_id", "run"], "left_semi").drop("run")


def write_rejects(rejected: DataFrame, path: str, run: str | None = None) -> None:
    """Refused input with its reason: with ``run`` published as that run's (a rerun replaces
    them, read with ``read_rejects``), else appended."""
    if run is None:
        rejected.write.mode("append").parquet(path)
    else:
        RunStore(rejected.sparkSession, path).put(run, rejects=rejected)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return RunStore(spark, path).read("rejects")
