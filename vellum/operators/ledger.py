"""Submissions that were taken, in a table that batch and stream share."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..store import BucketedTable

SCHEMA = "submission string, run string"


class SubmissionLedger:
    """``claim`` hands every submission to the first run that asks for it, once.

    The table is bucketed and sorted by submission: a batch meets it by a sort-merge anti-join
    that moves the batch's digests only, never the ledger and never a chapter.  A run that is
    done again after a failure is given what it was given before."""

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.table = BucketedTable(spark, location, SCHEMA, "submission", buckets)

    def claim(self, submissions: DataFrame, run: str) -> DataFrame:
        """(submission) of those that belong to ``run``: unseen before, or taken by it."""
        asked = submissions.select("submission").where(F.col("submission").isNotNull()).distinct()
        new = asked.join(self.table.read().hint("merge"), "submission", "left_anti")
        self.table.append(new.withColumn("run", F.lit(run)))
        return asked.join(self.table.read().where(F.col("run") == run).hint("merge"), "submission", "left_semi")
