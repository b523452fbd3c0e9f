"""Validation with ordered reject reasons: the first failing check wins, as in the
request handlers.  Book-level checks are aggregates (partial/final), never a window."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as T
from ..sources.requests import distinct_requests
from .scan import null_safe_join


REJECT_NO_BOOK = "field required: book_id"


def is_pdf(content_type) -> Column:
    """``content_type == 'application/pdf'``; a NULL type is not a PDF."""
    ct = F.col(content_type) if isinstance(content_type, str) else content_type
    return ct.eqNullSafe(F.lit(C.PDF_CONTENT_TYPE))


def has_pdf_magic(content) -> Column:
    """Optional content test: the bytes start with ``%PDF`` (the declared type can lie)."""
    c = F.col(content) if isinstance(content, str) else content
    return F.substring(c, 1, 4) == F.lit(bytearray(b"%PDF"))


def size_ok(length, max_size: int | Column) -> Column:
    """Rejected only when strictly larger than the limit."""
    ln = F.col(length) if isinstance(length, str) else length
    mx = max_size if isinstance(max_size, Column) else F.lit(max_size)
    return ln <= mx


def too_large_message(max_size: int | Column) -> Column:
    mx = max_size if isinstance(max_size, Column) else F.lit(max_size)
    head, tail = C.REJECT_TOO_LARGE.split("{mb}")
    return F.concat(F.lit(head), T.size_mb_text(mx, 1), F.lit(tail))


def too_many_pages_message(n, max_chapters) -> Column:
    a, rest = C.REJECT_TOO_MANY_PAGES.split("{n}")
    b, c = rest.split("{max}")
    return F.concat(F.lit(a), n.cast("string"), F.lit(b), max_chapters.cast("string"), F.lit(c))


def too_many_chapters_message(max_chapters) -> Column:
    a, b = C.REJECT_TOO_MANY_CHAPTERS.split("{max}")
    return F.concat(F.lit(a), max_chapters.cast("string"), F.lit(b))


def file_reject_reason(files: DataFrame, limits: C.Limits | None = None,
                       max_file_size: Column | None = None,
                       max_chapters: Column | None = None) -> DataFrame:
    """File intake, in order: type, size, extraction error, no text, too many pages.
    Needs ``content_type, length, n_pages, extract_error``."""
    limits = limits or C.Limits()
    mx = max_file_size if max_file_size is not None else F.lit(limits.max_file_size)
    mc = max_chapters if max_chapters is not None else F.lit(limits.max_chapters)
    n = F.coalesce(F.col("n_pages"), F.lit(0))
    reason = (F.when(~is_pdf("content_type"), F.lit(C.REJECT_NOT_PDF))
               .when(~size_ok("length", mx), too_large_message(mx))
               .when(F.col("extract_error").isNotNull(),
                     F.concat(F.lit(C.REJECT_EXTRACT_ERROR.split("{e}")[0]), F.col("extract_error")))
               .when(n == 0, F.lit(C.REJECT_NO_TEXT))
               .when(n > mc, too_many_pages_message(n, mc)))
    return files.withColumn("reject_reason", reason)


def tenant_file_reject_reason(files: DataFrame, limits: DataFrame) -> DataFrame:
    """``file_reject_reason`` with each tenant's own limits (``options.resolve_limits``: tenant,
    max_file_size, max_chapters); a file of a tenant without limits has the defaults."""
    d = C.Limits()
    j = null_safe_join(files, limits.select("tenant", F.col("max_file_size").alias("_size"),
                                            F.col("max_chapters").alias("_count")), ["tenant"], "left")
    checked = file_reject_reason(j, max_file_size=F.coalesce("_size", F.lit(d.max_file_size)),
                                 max_chapters=F.coalesce("_count", F.lit(d.max_chapters)))
    return checked.drop("_size", "_count")


def request_reject_reason(requests: DataFrame, max_chapters: int = C.MAX_CHAPTERS) -> DataFrame:
    """Chapter intake, in order: no chapters, too many chapters (limit inclusive).  The
    chapters of all parts of a submission count together (``n_chapters``); lines landed again
    are left out, and another submission of the same book is judged on its own."""
    own = F.coalesce(F.when(F.col("chapters").isNotNull(), F.size("chapters")), F.lit(0))
    lines = distinct_requests(requests)
    per = lines.groupBy("submission").agg(F.sum(own).cast("bigint").alias("n_chapters"))
    n = F.col("n_chapters")
    reason = (F.when(n <= 0, F.lit(C.REJECT_NO_CHAPTERS))
               .when(n > max_chapters, too_many_chapters_message(F.lit(max_chapters))))
    return lines.drop("_content").join(per, "submission").withColumn("reject_reason", reason)


def max_chapters_guard(chapters: DataFrame, max_chapters: int = C.MAX_CHAPTERS) -> DataFrame:
    """Per book: chapter count and whether it is within the (inclusive) limit."""
    counts = chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    ok = F.col("n_chapters") <= max_chapters
    return counts.select("book_id", "n_chapters", ok.alias("accepted"),
                         F.when(~ok, too_many_chapters_message(F.lit(max_chapters)))
                         .alias("reject_reason"))


def book_reject_reason(chapters: DataFrame, max_chapters: int = C.MAX_CHAPTERS,
                       by: list[str] | None = None) -> DataFrame:
    """Per book (book_id, n_chapters, reject_reason): no book id, too many chapters.  ``by``
    tells submissions of a book apart."""
    counts = chapters.groupBy(*(by or ["book_id"])).agg(F.count("*").alias("n_chapters"))
    return counts.withColumn("reject_reason", F.when(F.col("book_id").isNull(), F.lit(REJECT_NO_BOOK))
                             .when(F.col("n_chapters") > max_chapters,
                                   too_many_chapters_message(F.lit(max_chapters))))


def blank_chapter_guard(chapters: DataFrame) -> DataFrame:
    """Client rule: any blank chapter refuses the whole book."""
    g = chapters.groupBy("book_id").agg(F.bool_or(T.is_blank("content")).alias("has_blank"),
                                        F.count("*").alias("n_chapters"))
    return g.select("book_id", "n_chapters", "has_blank",
                    (~F.col("has_blank")).alias("accepted"),
                    F.when(F.col("has_blank"), F.lit(C.REJECT_BLANK_CHAPTER)).alias("reject_reason"))


def progress_in_domain(progress) -> Column:
    p = F.col(progress) if isinstance(progress, str) else progress
    return p.between(0.0, 1.0)


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(reason).isNull()), df.where(F.col(reason).isNotNull())
