"""Scalar Column helpers (all JVM-side, whole-stage-codegen friendly).

Lengths and offsets are in code points, as in Python string indexing."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text) -> Column:
    """Python ``str.strip()``: removes the 29 Unicode white-space code points at both ends."""
    return F.trim(_c(text), F.lit(C.WHITESPACE))


def is_blank(text) -> Column:
    """Python ``not text.strip()``; NULL stays NULL."""
    return F.length(strip(text)) == 0


def slice_count(text, width: int, *, at_least_one: bool) -> Column:
    """Number of fixed-width slices ``text[i:i+width]``; empty text gives 0, or 1 if asked."""
    n = F.ceil(F.length(_c(text)) / F.lit(width)).cast("int")
    return F.greatest(n, F.lit(1)) if at_least_one else n


def slices(text, width: int, *, cap: int | None = None, keep_empty: bool) -> Column:
    """Array of ``text[i:i+width]`` for i = 0, width, ...; at most ``cap`` of them.

    ``keep_empty`` gives ``[""]`` for an empty text (chunking: one blank call), else ``[]``
    (pagination: no page).  Slices past the cap are never produced."""
    t = _c(text)
    if cap is not None:
        t = F.substring(t, 1, cap * width)
    # One linear pass; a substring per slice would count from the start each time.
    arr = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    return F.when(F.length(t) == 0, F.array(F.lit(""))).otherwise(arr) if keep_empty else arr


def first_char(text) -> Column:
    return F.substring(_c(text), 1, 1)


def rest_after_first(text) -> Column:
    """``text[1:]``."""
    t = _c(text)
    return F.substring(t, F.lit(2), F.greatest(F.length(t), F.lit(0)))


def split_paragraphs(text) -> Column:
    """``text.split('\\n\\n')``: every piece kept, empty ones included."""
    return F.split(_c(text), C.PARAGRAPH_SEPARATOR, -1)


def xml_escape(text) -> Column:
    t = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    t = F.replace(t, F.lit("<"), F.lit("&lt;"))
    return F.replace(t, F.lit(">"), F.lit("&gt;"))


def chapter_title(chapter_id) -> Column:
    return F.concat(F.lit(C.TITLE_PREFIX), _c(chapter_id).cast("string"))


def parity_alignment(page_number) -> Column:
    """Even page numbers are left aligned, odd ones right aligned."""
    return F.when(_c(page_number) % 2 == 0, F.lit("LEFT")).otherwise(F.lit("RIGHT"))


def _idiv(a: Column, b: int) -> Column:
    """Exact division of a non-negative BIGINT by a positive constant."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def fixed_decimal(numerator, denominator: int, decimals: int) -> Column:
    """Text of ``numerator / denominator`` with ``decimals`` places, rounded half to even on
    the exact quotient (Python's ``f"{x:.{d}f}"`` on an exactly representable value).
    Integer arithmetic only, so every engine prints the same digits.  Needs a
    non-negative numerator."""
    scale = 10 ** decimals
    n = _c(numerator).cast("bigint")
    # Whole part and fraction apart: the product with ``scale`` stays small.
    part = F.pmod(n, F.lit(denominator)) * F.lit(scale)
    low, r = _idiv(part, denominator), F.pmod(part, F.lit(denominator))
    odd = F.pmod(low + _idiv(n, denominator) * F.lit(scale % 2), F.lit(2)) == 1
    low = low + F.when((r * 2 > denominator) | ((r * 2 == denominator) & odd), 1).otherwise(0)
    whole = (_idiv(n, denominator) + F.when(low == scale, 1).otherwise(0)).cast("string")
    if decimals == 0:
        return whole
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(low, F.lit(scale)).cast("string"), decimals, "0"))


def size_kb_text(nbytes) -> Column:
    return fixed_decimal(nbytes, 1024, 2)


def size_mb_text(nbytes, decimals: int = 1) -> Column:
    return fixed_decimal(nbytes, 1024 * 1024, decimals)


def file_extension(path) -> Column:
    """``path.split('.')[-1]``."""
    return F.element_at(F.split(_c(path), "[.]", -1), -1)


def download_name(path) -> Column:
    return F.concat(F.lit(C.DOWNLOAD_BASENAME + "."), file_extension(path))


def parent_dir(path) -> Column:
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def output_path(job_id, fmt) -> Column:
    return F.concat(F.lit(C.OUTPUT_DIR + "/"), _c(job_id).cast("string"), F.lit("."), _c(fmt))


def status_url(job_id) -> Column:
    return F.concat(F.lit(C.STATUS_URL_PREFIX), _c(job_id).cast("string"))


def mask_secret(key) -> Column:
    """First 4 + '...' + last 4 when longer than 8 characters, else first 4 + '...'."""
    k = _c(key)
    tail = F.when(F.length(k) > 8, F.substring(k, -4, 4)).otherwise(F.lit(""))
    return F.concat(F.substring(k, 1, 4), F.lit("..."), tail)


def normalise_format(fmt) -> Column:
    """Exactly 'pdf' gives pdf; anything else (NULL too) gives docx."""
    return F.when(_c(fmt) == "pdf", F.lit("pdf")).otherwise(F.lit("docx"))


def mock_translate_text(text, language) -> Column:
    t = _c(text)
    body = F.concat(F.lit(C.MOCK_TEXT_PREFIX), _c(language), F.lit(": "),
                    F.substring(t, 1, C.MOCK_TEXT_PREVIEW), F.lit("..."))
    return F.when(F.length(t) == 0, F.lit("")).otherwise(body)


def mock_translate_chapter(text, language) -> Column:
    return F.concat(F.lit(C.MOCK_CHAPTER_PREFIX), _c(language), F.lit(": "),
                    F.substring(_c(text), 1, C.MOCK_CHAPTER_PREVIEW), F.lit("..."))


def mock_translate_batch(chapter_id, language) -> Column:
    return F.concat(F.lit("Chapter "), _c(chapter_id).cast("string"), F.lit(" translated to "),
                    _c(language))


def job_id_hash(*parts) -> Column:
    """Reproducible job id (a random uuid() would change on recomputation).  Every part is
    written with its length, a NULL as ``n``, so different parts never give one text."""
    def coded(p):
        s = _c(p).cast("string")
        return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))
    return F.md5(F.concat(*[coded(p) for p in parts]))


def chapter_message(chapter_id, total) -> Column:
    return F.concat(F.lit(C.MSG_CHAPTER_PREFIX), _c(chapter_id).cast("string"), F.lit("/"),
                    _c(total).cast("string"), F.lit("..."))
