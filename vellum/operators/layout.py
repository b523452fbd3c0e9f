"""Book layout as ordered element rows.

Per book, chapters are ordered by (id, ordinal): a stable sort by id.  Every number
that runs across a book (chapter index, page number, element sequence) is an
exclusive running sum over *chapter* rows (``scan.running_sums``), so element rows
never pass through a per-book window; each chapter emits its own elements in one
pass (array of structs, then ``inline``), so the chapter table is read once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as T
from .chunking import CHAPTER_KEY
from .scan import null_safe_join, running_sums

ORDER = ["id", "ordinal"]


def paginate(chapters: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
             max_pages: int | None = None) -> DataFrame:
    """DOCX pagination: ``content[i:i+chars_per_page]`` pages; an empty chapter has no
    page.  With ``max_pages`` the rest of a chapter is dropped (``truncation_audit`` tells
    how much)."""
    pages = T.slices("content", chars_per_page, cap=max_pages, keep_empty=False)
    return chapters.select("book_id", "id", "ordinal",
                           F.posexplode(pages).alias("page_idx", "text"))


def truncation_audit(chapters: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
                     max_pages: int = C.MAX_PAGES_PER_CHAPTER) -> DataFrame:
    n = F.length("content")
    total = T.slice_count("content", chars_per_page, at_least_one=False)
    kept = F.least(total, F.lit(max_pages))
    return chapters.select(
        "book_id", "id", "ordinal",
        n.cast("bigint").alias("n_chars"),
        kept.cast("int").alias("pages_kept"),
        (total - kept).cast("int").alias("pages_dropped"),
        F.greatest(n - F.lit(chars_per_page * max_pages), F.lit(0)).cast("bigint").alias("chars_lost"),
    )


def page_count(length: Column, chars_per_page: int, max_pages: int | None) -> Column:
    n = F.ceil(length / F.lit(chars_per_page))
    return F.coalesce(n if max_pages is None else F.least(n, F.lit(max_pages)), F.lit(0)).cast("int")


#: What XML 1.0 does not allow in a document.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
NO_CONTENT = "chapter has no content"
NOT_UNICODE = "chapter is not valid Unicode text"
BAD_CHARACTER = "chapter has a character that XML does not allow"


def chapter_error(content) -> Column:
    """Why a chapter cannot be laid out, all reasons joined by ``; ``, or null.  Such a chapter is
    marked and keeps its heading; the others go on."""
    c = F.col(content) if isinstance(content, str) else content
    checks = [(c.isNull(), NO_CONTENT), (~F.is_valid_utf8(c), NOT_UNICODE), (c.rlike(NOT_XML), BAD_CHARACTER)]
    return F.nullif(F.concat_ws("; ", *[F.when(when, F.lit(what)) for when, what in checks]), F.lit(""))


def chapter_shape(chapters: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
                  max_pages: int | None = None, *, paragraphs: bool = True) -> DataFrame:
    """Adds ``n_pages`` (DOCX) and, for the PDF layout, ``paras`` (non-blank
    paragraphs with their split position) and ``n_paras``: row-local, no shuffle."""
    base = chapters.withColumn("n_pages", page_count(F.length("content"), chars_per_page, max_pages))
    if not paragraphs:
        return base.withColumn("n_paras", F.lit(0))
    # A faulty chapter keeps its heading elements and gets no paragraph.
    sound = F.when(chapter_error("content").isNull(), F.col("content"))
    nonblank = F.filter(F.transform(T.split_paragraphs(sound),
                                    lambda p, i: F.struct(i.alias("i"), p.alias("p"))),
                        lambda s: ~T.is_blank(s["p"]))
    nonblank = F.coalesce(nonblank, F.array().cast("array<struct<i:int,p:string>>"))
    # Counted on its own (no structs), so the slim scan input never builds ``paras``.
    n_paras = F.size(F.coalesce(F.filter(T.split_paragraphs(sound), lambda p: ~T.is_blank(p)),
                                F.array().cast("array<string>")))
    return base.withColumns({"paras": nonblank, "n_paras": n_paras})


POSITION_COLUMNS = ["n_chapters", "ch_idx", "pages_before", "docx_before", "pdf_before"]


def scan_positions(slim: DataFrame, *, bounded: bool = False, blocks: int | None = None) -> DataFrame:
    """Running positions from slim chapter rows (chapter key, ``n_pages``, ``n_paras``):
    no text involved.  Adds ``n_chapters`` and ``POSITION_COLUMNS``.  With a ``failed``
    column, books with any failed chapter are dropped here, from the scan's own group
    totals: no join on the book key (a hot book never meets in one task)."""
    weights = {"ch_idx": F.lit(1),
               "pages_before": F.col("n_pages"),
               "docx_before": 1 + 3 * F.col("n_pages") + F.when(F.col("n_pages") > 0, 1).otherwise(0),
               "_pdf_w": 2 + 2 * F.col("n_paras")}
    totals = {"n_chapters": "ch_idx"}
    if "failed" in slim.columns:
        weights["_bad"] = F.when(F.col("failed"), 1).otherwise(0)
        totals["_n_bad"] = "_bad"
    scanned = running_sums(slim, ["book_id"], ORDER, weights, bounded=bounded, blocks=blocks,
                           totals=totals)
    if "failed" in slim.columns:
        scanned = scanned.where(F.col("_n_bad") == 0)
    return scanned.select(
        *CHAPTER_KEY, "n_pages", "n_paras", "n_chapters",
        F.col("ch_idx").cast("int").alias("ch_idx"),
        "pages_before", "docx_before",
        (F.col("_pdf_w") + F.greatest(F.col("ch_idx") - 1, F.lit(0))).alias("pdf_before"))


def chapter_positions(chapters: DataFrame, *, bounded: bool = False,
                      drop_failed_books: bool = False, paragraphs: bool = False,
                      chars_per_page: int = C.CHARS_PER_PAGE,
                      max_pages: int | None = None,
                      blocks: int | None = None) -> DataFrame:
    """Per chapter: ``ch_idx`` (0-based, in id order, stable), ``n_chapters`` of its book,
    ``n_pages``, ``pages_before`` (DOCX pages in earlier chapters), ``docx_before`` and
    ``pdf_before`` (elements of earlier chapters), ``n_paras`` (non-blank paragraphs;
    only with ``paragraphs=True``, which the PDF layout needs).

    The running sums are computed on a slim projection (keys and counts, no text) and
    joined back on the chapter key, so the text crosses at most one shuffle here.
    ``drop_failed_books`` (needs a ``failed`` column) drops every book with a failed
    chapter on the slim side; the inner join drops their text."""
    shaped = chapter_shape(chapters, chars_per_page, max_pages, paragraphs=paragraphs)
    slim = shaped.select(*CHAPTER_KEY, "n_pages", "n_paras",
                         *(["failed"] if drop_failed_books else []))
    pos = scan_positions(slim, bounded=bounded, blocks=blocks).drop("n_pages", "n_paras")
    return null_safe_join(shaped, pos, CHAPTER_KEY)


def slim_positions(chapters: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
                   max_pages: int | None = None, *, bounded: bool = False) -> DataFrame:
    """As ``chapter_positions`` for numbers only: no text beyond its length, no join back."""
    slim = chapters.select(*CHAPTER_KEY, page_count(F.length("content"), chars_per_page, max_pages).alias("n_pages"),
                           F.lit(0).alias("n_paras"))
    return scan_positions(slim, bounded=bounded)


def page_numbers(positions: DataFrame) -> DataFrame:
    """Page number, alignment and page-break flag of every page, from slim positions."""
    p = positions.where(F.col("n_pages") > 0).select(
        "book_id", "id", "ordinal", "ch_idx", "n_chapters", "n_pages", "pages_before",
        F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_idx"))
    return _numbered(p)


def page_rows(positioned: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
              max_pages: int | None = None) -> DataFrame:
    """DOCX pages with running page number, alignment and page-break flag."""
    pages = T.slices("content", chars_per_page, cap=max_pages, keep_empty=False)
    return _numbered(positioned.select(
        "book_id", "id", "ordinal", "ch_idx", "n_chapters", "n_pages", "pages_before",
        F.posexplode(pages).alias("page_idx", "text")))


def _numbered(p: DataFrame) -> DataFrame:
    page_no = F.col("pages_before") + F.col("page_idx") + 1
    return p.withColumns({
        "page_no": page_no.cast("bigint"),
        "align": T.parity_alignment(page_no),
        "has_break": (F.col("page_idx") < F.col("n_pages") - 1)
                     | (F.col("ch_idx") < F.col("n_chapters") - 1),
    })


def _el(pos, kind, part_idx=None, text=None, page_no=None, align=None,
        height=None, keep=True, error=None) -> Column:
    def v(x, t):
        return x if isinstance(x, Column) else F.lit(x).cast(t)
    return F.struct(v(pos, "int").cast("int").alias("pos"), F.lit(kind).alias("kind"),
                    v(part_idx, "int").cast("int").alias("part_idx"),
                    v(text, "string").alias("text"),
                    v(page_no, "bigint").cast("bigint").alias("page_no"),
                    v(align, "string").alias("align"),
                    v(height, "double").alias("height_in"), v(keep, "boolean").alias("keep"),
                    v(error, "string").alias("element_error"))


def docx_elements(positioned: DataFrame, chars_per_page: int = C.CHARS_PER_PAGE,
                  max_pages: int | None = None) -> DataFrame:
    """Title, then per page: body (on the chapter's first page after a drop cap, an element
    of its own), page number (aligned by parity), page break (except after the book's
    last page)."""
    pages = T.slices("content", chars_per_page, cap=max_pages, keep_empty=False)
    last_ch = F.col("ch_idx") >= F.col("n_chapters") - 1

    def per_page(p, j):
        no = F.col("pages_before") + j + 1
        first = j == 0
        body = F.when(first, T.rest_after_first(p)).otherwise(p)
        brk = (j < F.col("n_pages") - 1) | ~last_ch
        return F.array(
            _el(F.lit(2), "dropcap", j, T.first_char(p), keep=first),
            _el(3 + 3 * j, "body", j, body),
            _el(4 + 3 * j, "number", j, no.cast("string"), page_no=no,
                align=T.parity_alignment(no)),
            _el(5 + 3 * j, "break", j, keep=brk),
        )

    title = F.array(_el(1, "title", text=T.chapter_title("id"), align="RIGHT"))
    pages = F.coalesce(pages, F.array().cast("array<string>"))
    els = F.concat(title, F.flatten(F.transform(pages, per_page)))
    els = F.filter(els, lambda e: e["keep"])
    rows = positioned.select("book_id", F.col("id").alias("chapter_id"), "docx_before",
                             F.inline(els))
    return rows.select("book_id", (F.col("docx_before") + F.col("pos")).alias("seq"),
                       "kind", "chapter_id", "part_idx", "text", "page_no", "align", "height_in")


def pdf_elements(positioned: DataFrame) -> DataFrame:
    """Per chapter: page break (not before the first), title, 0.2 in spacer; per non-blank
    paragraph (split on a blank line): escaped body, 0.1 in gap.  No drop cap, no page
    numbers.  A faulty chapter (``chapter_error``) keeps its heading, whose title carries
    ``element_error``; the rest of the book is unaffected."""
    b = F.when(F.col("ch_idx") > 0, 1).otherwise(0)

    def per_para(s, k):
        return F.array(
            _el(3 + b + 2 * k, "body", s["i"], T.xml_escape(s["p"])),
            _el(4 + b + 2 * k, "gap", s["i"], height=C.PARAGRAPH_SPACER_IN),
        )

    head = F.array(
        _el(1, "break", keep=F.col("ch_idx") > 0),
        _el(1 + b, "title", text=T.chapter_title("id"), align="RIGHT",
            error=chapter_error("content")),
        _el(2 + b, "spacer", height=C.TITLE_SPACER_IN),
    )
    els = F.filter(F.concat(head, F.flatten(F.transform("paras", per_para))),
                   lambda e: e["keep"])
    rows = positioned.select("book_id", F.col("id").alias("chapter_id"), "pdf_before",
                             F.inline(els))
    return rows.select("book_id", (F.col("pdf_before") + F.col("pos")).alias("seq"),
                       "kind", "chapter_id", "part_idx", "text", "page_no", "align", "height_in",
                       "element_error")


def split_paragraphs(chapters: DataFrame) -> DataFrame:
    """PDF paragraphs: split on a blank line, blank pieces dropped, XML-escaped, not
    trimmed; ``para_idx`` is the position in the split (gaps where blanks were)."""
    parts = chapters.select("book_id", "id", "ordinal",
                            F.posexplode(T.split_paragraphs("content")).alias("para_idx", "p"))
    return (parts.where(~T.is_blank("p"))
                 .select("book_id", "id", "ordinal", "para_idx",
                         T.xml_escape("p").alias("text")))


def shown_text() -> Column:
    """An element as it reads back: a page break is a form feed, a spacer or gap an empty line,
    a drop cap is glued to its body."""
    return (F.when(F.col("kind") == "break", F.lit("\f\n"))
             .when(F.col("kind").isin("spacer", "gap"), F.lit("\n"))
             .when(F.col("kind") == "dropcap", F.col("text"))
             .otherwise(F.concat("text", F.lit("\n"))))


def render_text(elements: DataFrame) -> DataFrame:
    """Book read back as text, elements in ``seq`` order joined by newlines (``shown_text``).  One
    string per book: the row is as large as the book (``book_segments`` is not)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq"), shown_text().alias("t"))))
    whole = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    return elements.groupBy("book_id").agg(
        F.substring(whole, F.lit(1), F.length(whole) - 1).alias("text"), F.count("*").alias("n_elements"))


def book_segments(elements: DataFrame, key: str = "book_id") -> DataFrame:
    """The same text in pieces: (book_id, seq, start, n_bytes, text), ``start`` the byte offset of
    the piece in its book.  Offsets are running sums over lengths (``scan``), so a book of any
    size is spread over many tasks; the pieces in order of ``start`` are the text and a newline."""
    parts = elements.select(key, "seq", shown_text().alias("text"))
    slim = parts.select(key, "seq", F.octet_length("text").cast("bigint").alias("n_bytes"))
    placed = running_sums(slim, [key], ["seq"], {"start": F.col("n_bytes")})
    return null_safe_join(parts, placed, [key, "seq"]).select(key, "seq", "start", "n_bytes", "text")


def write_segments(segments: DataFrame, path: str, key: str = "book_id") -> None:
    """In files that each hold one stretch of (book, offset): a range is read from those files
    alone, by their statistics."""
    segments.repartitionByRange(key, "start").sortWithinPartitions(key, "start").write.parquet(path)


def read_range(segments: DataFrame, book, start: int, end: int, key: str = "book_id") -> DataFrame:
    """Bytes ``start`` to ``end`` (exclusive) of a book, as pieces (start, bytes) to be joined in
    order; only segments that meet the range are read."""
    first = F.greatest(F.col("start"), F.lit(start))
    last = F.least(F.col("start") + F.col("n_bytes"), F.lit(end))
    mine = segments.where((F.col(key) == book) & (F.col("start") < end) & (F.col("start") + F.col("n_bytes") > start))
    piece = F.substring(F.col("text").cast("binary"), (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    return mine.select(first.alias("start"), piece.alias("bytes"))


def styled(elements: DataFrame, styles: DataFrame, fmt: str) -> DataFrame:
    """Attach the style of each (format, kind); the style table has a fixed 10 rows."""
    s = styles.where(F.col("format") == fmt).drop("format")
    out = elements.join(F.broadcast(s), "kind", "left")
    return out.withColumn("align", F.when(F.col("style_align") == "PARITY", F.col("align"))
                          .otherwise(F.coalesce(F.col("style_align"), F.col("align"))))
