"""The end-to-end job: chapters -> chunks -> translation -> reassembly -> layout."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as T
from ..operators import chunking, jobs, layout, translate, validate
from ..operators.scan import null_safe_join
from ..session import materialize as _materialize
from ..sinks import artifact_index, artifact_rows
from ..store import RunStore


@dataclass
class Translated:
    chunks: DataFrame       # every chunk with translated / attempts / wait_s / error
    all_chapters: DataFrame  # every reassembled chapter with failed / error (written once)
    outcomes: DataFrame     # one row per book: failed, error, n_chunks, n_calls
    ok_books: DataFrame     # book_id of the books that succeeded

    @property
    def chapters(self) -> DataFrame:
        """Reassembled chapters of the books that succeeded (no partial book)."""
        return self.all_chapters.join(self.ok_books, "book_id", "left_semi")


def translate_books(chapters: DataFrame, model=None, opts: C.PipelineOptions = C.PipelineOptions(),
                    *, key_col: str | None = None, jvm: bool = False, materialize: bool | None = None,
                    carry: list[str] | None = None, sleep=None, language: Column | None = None,
                    parallelism: int | None = None) -> Translated:
    """Chunk, translate, reassemble; a book with any failed chunk yields no chapters.

    The reassembled chapter table (with per-chapter failure) is written once to the
    shared folder (``materialize``, on by default for a Python model): outcomes,
    the filtered chapters and the layout all read it, so each chunk reaches the model
    once even though several branches consume the result.  ``language`` is a column of the
    chapters (named in ``carry``) where every book has its own."""
    carry = list(carry or [])
    if key_col and key_col not in carry:
        carry.append(key_col)
    chunks = chunking.chunk_chapters(chapters, opts.chunk_size, carry=carry)
    tr = translate.translate_chunks(chunks, model, target_language=opts.target_language if language is None else language,
                                    max_retries=opts.max_retries, key_col=key_col, jvm=jvm,
                                    sleep=sleep, parallelism=parallelism, dedupe=opts.dedupe)
    keep = [c for c in carry if c != key_col]
    all_ch = chunking.reassemble(tr, carry=keep)
    if materialize is None:
        materialize = not (jvm and hasattr(model, "column"))
    if materialize:
        all_ch = _materialize(all_ch)
    outcomes = translate.book_outcomes(all_ch)
    return Translated(tr, all_ch, outcomes, translate.ok_books(outcomes))


def numbered_pages(t: Translated, opts: C.PipelineOptions = C.PipelineOptions(),
                   *, bounded: bool = False) -> DataFrame:
    pos = layout.chapter_positions(t.all_chapters, bounded=bounded, drop_failed_books=True,
                                   chars_per_page=opts.chars_per_page, max_pages=opts.max_pages)
    pages = layout.page_rows(pos, opts.chars_per_page, opts.max_pages)
    return pages.select("book_id", "id", "page_idx", "page_no", "align", "has_break", "text")


def flagship(chapters: DataFrame, model=None,
             opts: C.PipelineOptions = C.PipelineOptions(), *, bounded: bool = False,
             key_col: str | None = None, sleep=None) -> DataFrame:
    """The numbered pages of every translated book (DOCX pagination).

    Shuffles of text: source chunks once (spread over the model tasks), translated
    chunks once (reassembly).  The translated chunks are written once; page positions
    come from a slim aggregate of their lengths (a chapter's length is the sum of its
    translated chunks plus the newlines between them) and are joined to the chunks
    before the reassembly exchange, which then carries them at no extra shuffle."""
    chunks = chunking.chunk_chapters(chapters, opts.chunk_size, carry=[key_col] if key_col else None)
    tr = translate.translate_chunks(chunks, model, target_language=opts.target_language,
                                    max_retries=opts.max_retries, key_col=key_col, sleep=sleep,
                                    dedupe=opts.dedupe)
    # Only what the layout reads is written: not the source slice, not the language
    # (at scale the source text would otherwise be written a second time).
    tr = _materialize(tr.drop("chunk", "target_language"))
    per_ch = tr.groupBy(*chunking.CHAPTER_KEY).agg(
        (F.sum(F.length("translated")) + F.count("*") - 1).alias("n_out"),
        F.bool_or(F.col("error").isNotNull()).alias("failed"))
    slim = per_ch.select(
        *chunking.CHAPTER_KEY, layout.page_count(F.col("n_out"), opts.chars_per_page, opts.max_pages).alias("n_pages"),
        F.lit(0).alias("n_paras"), "failed")
    pos = layout.scan_positions(slim, bounded=bounded)      # also drops books with a failed chunk
    joined = null_safe_join(tr, pos.drop("failed"), chunking.CHAPTER_KEY)
    if key_col:
        joined = joined.drop(key_col)
    chapters_out = chunking.reassemble(joined, carry=["n_pages", *layout.POSITION_COLUMNS])
    out = layout.page_rows(chapters_out, opts.chars_per_page, opts.max_pages)
    return out.select("book_id", "id", "page_idx", "page_no", "align", "has_break", "text")


@dataclass
class JobRun:
    jobs: DataFrame          # one row per accepted submission
    events: DataFrame        # lifecycle of every job, chapter by chapter
    elements: DataFrame      # layout of the books that succeeded, with job_id
    rejects: DataFrame       # refused books with their reason


#: Books of up to so many chapters take plain windows: one shuffle, a bounded group.
SMALL_BOOK = 10_000
_SUBMISSION = ["book_id", "target_language", "output_format", "submission"]


def run_jobs(chapters: DataFrame, model=None, opts: C.PipelineOptions = C.PipelineOptions(),
             *, key_col: str | None = None, sleep=None, submission: str = "0") -> JobRun:
    """Intake to artifact rows: every submission either becomes a job, with its events and,
    when all its chapters succeed, its elements, or a reject row with the reason.

    ``target_language``, ``output_format`` and ``submission`` are taken from the chapters' columns
    of these names, and from the arguments where there is none (or a null): a book asked for
    in two languages is two jobs, each in its own.  From here on a job is the group
    that everything is keyed by (``<job id>:<book id>``), and both ids are cut out of the key
    again: no join brings them to the elements.  With a chapter limit up to SMALL_BOOK no book
    is large, and positions come from plain windows; beyond it from the skew-safe scan."""
    given = {"target_language": opts.target_language, "output_format": opts.output_format, "submission": submission}
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in chapters.columns else F.lit(v)
             for c, v in given.items()}
    if "output_format" in chapters.columns:
        value["output_format"] = T.normalise_format(value["output_format"])
    asked = chapters.withColumns(value)
    # A row per submission, written once: jobs, events, artifacts and rejects would each count the
    # chapters again.
    books = _materialize(validate.book_reject_reason(asked, opts.limits.max_chapters, _SUBMISSION))
    ok, bad = validate.split_rejects(books)
    job_rows = jobs.submit_jobs(ok, "chapters", F.col("target_language"), F.col("output_format"), F.col("submission"))
    job_id = T.job_id_hash(F.lit("chapters"), *_SUBMISSION)
    book_type = chapters.schema["book_id"].dataType
    accepted = asked.withColumn("_job", job_id).join(job_rows.select(F.col("job_id").alias("_job")), "_job", "left_semi")
    accepted = accepted.withColumn("book_id", F.concat("_job", F.lit(":"), F.col("book_id").cast("string")))
    t = translate_books(accepted, model, opts, key_col=key_col, sleep=sleep, language=F.col("target_language"),
                        carry=["target_language", "output_format"])
    job, small = F.substring("book_id", 1, 32), opts.limits.max_chapters <= SMALL_BOOK
    events = jobs.lifecycle_events(job_rows, t.outcomes.withColumn("job_id", job),
                                   t.all_chapters.withColumn("job_id", job), bounded=small)
    formats = ["docx", "pdf"] if "output_format" in chapters.columns else [opts.output_format]
    els = None
    for fmt in formats:
        mine = t.all_chapters.where(F.col("output_format") == fmt) if len(formats) > 1 else t.all_chapters
        pos = layout.chapter_positions(mine, drop_failed_books=True, paragraphs=fmt == "pdf", bounded=small,
                                       chars_per_page=opts.chars_per_page, max_pages=opts.max_pages)
        part = layout.pdf_elements(pos) if fmt == "pdf" else layout.docx_elements(pos, opts.chars_per_page, opts.max_pages)
        els = part if els is None else els.unionByName(part, allowMissingColumns=True)
    els = els.withColumns({"job_id": job, "book_id": F.expr("substring(book_id, 34)").cast(book_type)})
    return JobRun(job_rows, events, els, bad.select("book_id", "n_chapters", "reject_reason"))


def publish(job: JobRun, location: str, run: str) -> RunStore:
    """Writes the artifacts of a run, then what follows from them, then the run itself.

    Elements go under an attempt folder; the index of artifacts and ``completed`` come from what
    was written there; one manifest row publishes all tables at once.  Before that nobody sees
    any of it, so ``completed`` never stands without its artifact; a run done again replaces
    all that it had published."""
    store = RunStore(job.jobs.sparkSession, location)
    attempt = store.begin()
    rows = store.write(attempt, "jobs", job.jobs)
    written = store.write(attempt, "elements", artifact_rows(job.elements))
    index = store.write(attempt, "artifacts", artifact_index(written, rows))
    store.write(attempt, "events", jobs.settled(job.events, index))
    store.write(attempt, "rejects", job.rejects)
    store.publish(run, attempt)
    return store
