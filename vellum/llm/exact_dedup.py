"""Exact copies against a persistent digest index.

The index is a Parquet table (digest, keep_id, batch rows) bucketed and sorted by digest.
A batch of documents is reduced to its distinct digests first (partial/final aggregate,
so a digest that a third of all rows share reaches its reducer once per map task), the
distinct digests that the index lacks are found by a sort-merge anti-join against the
buckets, and only those are appended.  Texts are never shuffled to find copies.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..store import BucketedTable
from .common import documents, land, scratch

SCHEMA = "digest BINARY, keep_id BIGINT"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """``DigestIndex(spark, location).add(docs)`` decides a batch and extends the index.

    A text that the index knows from an earlier batch keeps that batch's row.  Adding the
    same batch again gives the same decisions and appends nothing, so a job that failed
    half way is simply run again."""

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = BucketedTable(spark, location or scratch(spark, "digests"), SCHEMA, "digest", buckets)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

        ``group_size`` counts the batch's rows with an equal text.  Null text is the empty
        text.  A null doc_id is never smaller than another; a group of null ids alone has a
        null keep_id and all its rows are kept = true.  Rows that repeat both doc_id and
        text share one decision.  Other columns of ``docs`` are not read, whatever their
        names.  An empty batch gives no rows and appends none."""
        rows = documents(docs, id_col, text_col)
        rows = land(rows.select("doc_id", digest(F.col("text")).alias("digest")), "digests")
        groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"),
                                            F.count(F.lit(1)).alias("group_size"))
        new = groups.join(self.table.read().hint("merge"), "digest", "left_anti")
        self.table.append(new.select("digest", F.col("first_id").alias("keep_id")))
        # Written before the join with the rows: both sides then come by a shuffle of their
        # own, which AQE splits where one digest holds a large share of the rows.
        decided = land(groups.join(self.table.read().hint("merge"), "digest")
                             .select("digest", "keep_id", "group_size"), "decided")
        return rows.join(decided, "digest").select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat both id
    and text, one.  The text crosses one shuffle, for the semi-join with the kept keys."""
    index = index or DigestIndex(docs.sparkSession)
    key = lambda i, h: F.sha2(F.concat(F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), h), 256)
    kept = (index.add(docs, id_col, text_col).where("kept")
                 .select(key(F.col("doc_id"), F.col("text_sha256")).alias("__vellum_key")).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumn("__vellum_key", key(F.col(id_col).cast("bigint"), F.lower(F.hex(digest(text)))))
    return (keyed.join(kept, "__vellum_key", "left_semi")
                 .dropDuplicates(["__vellum_key"]).drop("__vellum_key"))
