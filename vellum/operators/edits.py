"""Chapter edits: update by id, append an empty chapter, remove by id."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def next_chapter_id(chapters: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """max(id) + 1 per book; with ``books`` (book_id), books without chapters too: 1."""
    per = chapters.groupBy("book_id").agg(F.max("id").alias("_id"), F.max("ordinal").alias("_ord"))
    if books is not None:
        per = books.select(F.col("book_id").alias("_b")).distinct().join(
            per, F.col("_b").eqNullSafe(F.col("book_id")), "left").drop("book_id").withColumnRenamed("_b", "book_id")
    return per.select("book_id", (F.coalesce("_id", F.lit(0)) + 1).alias("next_id"),
                      (F.coalesce("_ord", F.lit(-1)) + 1).alias("next_ordinal"))


def append_chapter(chapters: DataFrame) -> DataFrame:
    """Each book gains one empty chapter with the next id, at the end."""
    new = next_chapter_id(chapters).select(
        "book_id", F.col("next_id").alias("id"), F.col("next_ordinal").alias("ordinal"),
        F.lit("").alias("content"))
    return chapters.select("book_id", "id", "ordinal", "content").unionByName(new)


def update_chapters(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """Every chapter whose (book, id) has an edit takes the content of the latest edit
    (``edit_seq``); duplicated ids are all updated."""
    last = edits.groupBy("book_id", "id").agg(
        F.max_by("content", "edit_seq").alias("_new"))
    j = chapters.join(last, ["book_id", "id"], "left")
    return (j.withColumn("edited", F.col("_new").isNotNull())
             .withColumn("content", F.coalesce("_new", "content")).drop("_new"))


def remove_chapters(chapters: DataFrame, removals: DataFrame) -> DataFrame:
    """Applies removals (book_id, id[, removal_seq]) in order; the one that would take a
    book's last chapter is refused.  A removal takes every chapter with its id.

    Only the last removal that hits something can be refused, because all earlier ones
    leave a chapter behind: when the removals of a book name all its chapters, the
    chapters of the last one (largest ``removal_seq``, then id) stay."""
    seq = F.col("removal_seq") if "removal_seq" in removals.columns else F.lit(0)
    first = removals.groupBy("book_id", "id").agg(F.min(seq).alias("_seq"))
    hit = chapters.join(first, ["book_id", "id"], "left")
    per = hit.groupBy("book_id").agg(
        F.bool_and(F.col("_seq").isNotNull()).alias("_all"),
        F.max(F.struct("_seq", "id")).alias("_last"))
    gone = (first.join(per, "book_id")
                 .where(~(F.col("_all") & (F.struct("_seq", "id") == F.col("_last")))).select("book_id", "id"))
    return chapters.join(gone, ["book_id", "id"], "left_anti")
