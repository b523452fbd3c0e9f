"""Chunking of chapters for the model and ordered reassembly of the results."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import text as T

# A chapter is identified by (book_id, ordinal); ``id`` is its display id and sort key
# (ids may repeat inside a book, the submission ordinal never does).
CHAPTER_KEY = ["book_id", "ordinal", "id"]


def chunk_plan(chapters: DataFrame, size: int = C.CHUNK_SIZE) -> DataFrame:
    """Per chapter: length, number of model calls, and whether one call suffices."""
    n = F.length("content")
    return chapters.select(
        *CHAPTER_KEY,
        n.cast("bigint").alias("n_chars"),
        T.slice_count("content", size, at_least_one=True).cast("bigint").alias("n_chunks"),
        (n <= size).alias("single_request"),
    )


def chunk_chapters(chapters: DataFrame, size: int = C.CHUNK_SIZE,
                   carry: list[str] | None = None) -> DataFrame:
    """One row per ``content[i:i+size]`` slice, cut mid-word; an empty chapter gives one
    empty chunk.  Only keys and the slice leave this step, never the whole chapter text."""
    carry = [c for c in (carry or []) if c in chapters.columns]
    return chapters.select(
        *CHAPTER_KEY, *carry,
        F.posexplode(T.slices("content", size, keep_empty=True)).alias("chunk_idx", "chunk"),
    )


def reassemble(translated: DataFrame, text_col: str = "translated",
               carry: list[str] | None = None) -> DataFrame:
    """Chapter text = translated chunks joined by a newline in chunk order (not finish
    order).  A blank chunk contributes "" and still its separator; a failed chunk (NULL)
    is skipped, and ``failed`` / ``error`` tell which chapters lost one.  Output is
    hash-partitioned on the chapter key."""
    carry = carry or []
    parts = F.array_sort(F.collect_list(F.struct(F.col("chunk_idx"), F.col(text_col).alias("t"))))
    aggs = [F.array_join(F.transform(parts, lambda x: x["t"]), C.CHUNK_JOINER).alias("content"),
            F.count("*").alias("n_chunks")]
    cols = set(translated.columns)
    if "error" in cols:
        err = F.col("error").isNotNull()
        aggs += [F.bool_or(err).alias("failed"),
                 F.min_by(F.col("error"), F.when(err, F.col("chunk_idx"))).alias("error")]
    if "attempts" in cols:
        aggs.append(F.sum("attempts").cast("bigint").alias("n_calls"))
    return translated.groupBy(*CHAPTER_KEY, *carry).agg(*aggs)
