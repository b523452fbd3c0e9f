"""Counts and volumes the pipeline logs, as tables (all plain aggregates)."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T


def chapter_counts(chapters: DataFrame) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"))


def chapter_lists(chapters: DataFrame) -> DataFrame:
    """Ids and lengths per book in (id, ordinal) order, as logged after translation.
    One array per book: use on books within the chapter limit."""
    s = F.array_sort(F.collect_list(F.struct("id", "ordinal", F.length("content").alias("n"))))
    return chapters.groupBy("book_id").agg(
        F.transform(s, lambda x: x["id"]).alias("ids"),
        F.transform(s, lambda x: x["n"]).alias("lengths"))


def layout_counts(positioned: DataFrame) -> DataFrame:
    """Per book: chapters, DOCX pages, PDF paragraphs, and the element counts of both
    layouts (only a page of the book's last chapter in (id, ordinal) order can go without
    a break, so a book ending in an empty chapter keeps all its breaks; every chapter but
    the first starts with a PDF page break)."""
    g = positioned.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"),
        F.sum("n_pages").cast("bigint").alias("n_pages"),
        F.sum("n_paras").cast("bigint").alias("n_paragraphs"),
        F.count_if(F.col("n_pages") > 0).alias("_with_pages"),
        F.max_by("n_pages", F.struct("id", "ordinal")).alias("_last_pages"))
    return g.select(
        "book_id", "n_chapters", "n_pages", "n_paragraphs",
        (F.col("n_chapters") + 3 * F.col("n_pages") + F.col("_with_pages")
         - F.when(F.col("_last_pages") > 0, 1).otherwise(0)).alias("docx_elements"),
        (3 * F.col("n_chapters") - 1 + 2 * F.col("n_paragraphs")).alias("pdf_elements"))


def extraction_summary(files: DataFrame, text_col: str = "text", sep: str = "\f") -> DataFrame:
    """Per file: pages seen, pages kept (non-blank), skipped, characters kept.  Row-local:
    no page leaves its file."""
    pages = F.split(F.col(text_col), sep, -1)
    kept = F.filter(pages, lambda p: ~T.is_blank(p))
    f = files.select("file", F.size(pages).cast("bigint").alias("n_pages"), kept.alias("kept"))
    return f.select("file", "n_pages", F.size("kept").cast("bigint").alias("n_extracted"),
                    (F.col("n_pages") - F.size("kept")).alias("n_skipped"),
                    F.aggregate(F.transform("kept", lambda p: F.length(p).cast("bigint")),
                                F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_chars"))


def run_log(events: DataFrame) -> DataFrame:
    """Per job: first and last status and the time between first and last event."""
    order = F.struct("ts", "event_id")
    first_ts, last_ts = F.min_by("ts", order), F.max_by("ts", order)
    g = events.groupBy("job_id").agg(
        F.count("*").alias("n_events"),
        F.min_by("status", order).alias("first_status"),
        F.max_by("status", order).alias("last_status"),
        F.timestamp_diff("MICROSECOND", first_ts, last_ts).alias("elapsed_us"))
    return g.select("job_id", "n_events", "first_status", "last_status",
                    (F.col("elapsed_us") / F.lit(1e6)).alias("elapsed_s"),
                    T.fixed_decimal(F.col("elapsed_us"), 1000000, 4).alias("elapsed_text"))


def metrics_long(per_book: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide per-book metrics to (book_id, metric, value) rows."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS BIGINT)" for m in metrics)
    return per_book.selectExpr("book_id", f"stack({len(metrics)}, {stack}) AS (metric, value)")
