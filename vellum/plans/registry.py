"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) ->
DataFrame`` over the driver tables (whole tables, whole texts).  Column names and types
match the DuckDB statements in ``oracle.py``.

Perturbations (applied identically in ``oracle.py``) make rules fire that the raw
tables never trigger: blank and missing chapters, blank lines, repeated ids, failing model
calls.  They add rows or text to the tables' own and take none away.
"""
from __future__ import annotations

from typing import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import text as T
from ..operators import chunking, edits, jobs, layout, metrics, translate, validate
from ..operators.edit_log import apply_log
from ..operators.ledger import SubmissionLedger
from ..operators.runlog import RunLog
from ..operators.scan import running_sums
from ..sinks import list_artifacts, read_artifacts, read_rejects, write_artifacts, write_rejects
from ..sources import files as FS, options as O, requests as RQ, tables as TB
from ..session import materialize, scratch_path
from ..store import RunStore
from . import faults, pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LANG = C.DEFAULT_TARGET_LANGUAGE
NL = "\n"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- perturbations ---------------------------------------------------------------

EXTRA = 1_000_000_000        # ids of added chapters start here


def blanked(ch: DataFrame, every: int = 7, blank: str | None = "  ") -> DataFrame:
    """An extra chapter with the content ``blank`` for every ``every``-th one (by id)."""
    extra = ch.where(F.col("id") % every == 0).withColumns({
        "id": F.col("id") + EXTRA, "ordinal": F.col("ordinal") + EXTRA,
        "content": F.lit(blank).cast("string")})
    return ch.unionByName(extra)


def paragraphed(ch: DataFrame) -> DataFrame:
    """Lines become paragraphs; every 5th chapter (by id) ends with a blank paragraph."""
    doubled = F.replace(F.col("content"), F.lit(NL), F.lit(NL + NL))
    return ch.withColumn("content", F.concat(doubled, F.when(F.col("id") % 5 == 0,
                                                             F.lit(NL + NL + " ")).otherwise(F.lit(""))))


def docs(spark, sf):
    return TB.document_chapters(spark, sf)


def convs(spark, sf):
    return TB.conversation_chapters(spark, sf)


# --- A: sources --------------------------------------------------------------------

OTHER_LANG, OTHER_FORMAT = "Francês", "pdf"


def landed_books(spark, sf, part_size: int | None = None) -> DataFrame:
    """Request lines of the conversation books: each in parts (or whole); every 4th also whole
    in another language and format; every 3rd book's lines landed a second time."""
    ch = convs(spark, sf)
    own = RQ.requests_from_chapters(ch, LANG, part_size).withColumn("output_format", F.lit(None).cast("string"))
    other = (RQ.requests_from_chapters(ch.where(F.col("book_id") % 4 == 0), OTHER_LANG, None)
             .withColumn("output_format", F.lit(OTHER_FORMAT)))
    req = own.unionByName(other)
    return req.unionByName(req.where(F.col("book_id").cast("bigint") % 3 == 0))


@query
def scan_book_requests(spark, sf):
    """A1: requests landed as JSON lines, read back with an explicit schema, flattened; a line
    landed twice counts once, a book in two languages twice."""
    path = scratch_path(spark, "requests")
    landed_books(spark, sf, 3).write.json(path)                                # parts of 3
    req = RQ.schema_reject_reason(RQ.read_requests(spark, path))
    ok = req.where(F.col("schema_error").isNull())
    return RQ.request_chapters(ok).select("book_id", "id", "ordinal", "content", "target_language", "output_format")


def request_lines(requests: DataFrame) -> DataFrame:
    return requests.select(F.to_json(F.struct("book_id", "part", "chapters", "target_language", "output_format")).alias("value"))


def faulty_lines(spark, sf) -> DataFrame:
    """For every 9th book a request without chapters, for the next one without a language, for
    the next one with word ids."""
    own = RQ.requests_from_chapters(convs(spark, sf), LANG, None).withColumn("output_format", F.lit(None).cast("string"))
    k = F.col("book_id").cast("bigint") % 9
    named = lambda name, df: df.withColumn("book_id", F.concat(F.lit(f"{name}-"), "book_id"))     # noqa: E731
    empty = named("empty", own.where(k == 0)).withColumn("chapters", F.array().cast(own.schema["chapters"].dataType))
    silent = named("silent", own.where(k == 1)).withColumn("target_language", F.lit(None).cast("string"))
    typed = request_lines(named("typed", own.where(k == 2))).select(
        F.regexp_replace("value", '"id":([0-9]+)', '"id":"n$1"').alias("value"))
    return request_lines(empty.unionByName(silent)).unionByName(typed)


def _landed_requests(spark, sf):
    """The landed books and faulty requests besides."""
    path = scratch_path(spark, "requests")
    request_lines(landed_books(spark, sf, 3)).unionByName(faulty_lines(spark, sf)).write.text(path)
    return RQ.read_requests(spark, path)


@query
def schema_check(spark, sf):
    """Required fields present and typed (missing field vs wrongly typed value)."""
    r = RQ.schema_reject_reason(_landed_requests(spark, sf))
    return r.select("book_id", "part", "schema_error")


@query
def empty_request(spark, sf):
    """C6 (+ C5 on the chapter route): a well-formed request without chapters is refused, and
    so is one whose parts have more than five together; what was landed again or in another
    language does not add up."""
    r = RQ.schema_reject_reason(_landed_requests(spark, sf)).where(F.col("schema_error").isNull())
    r = validate.request_reject_reason(r, 5)
    return r.select("book_id", "part", "target_language", "n_chapters", "reject_reason")


def _page_files_on_disk(spark, sf):
    path = scratch_path(spark, "files")
    FS.land_files(TB.read(spark, sf, "pages"), path, "page_id", "html")
    return FS.scan_files(spark, path, glob="*.txt")


@query
def extract_errors(spark, sf):
    """A4: a decoder that only reads ASCII fails on accented pages; the error stays with
    its file (one row, no pages) and the other files go on."""
    files = _page_files_on_disk(spark, sf)
    pages = FS.extract_with(files, FS.ascii_line_extractor)
    per = FS.file_summary(files.select("path"), pages)
    return per.select(FS.landed_key("page_id").alias("file"),
                      F.coalesce("n_pages", F.lit(0)).cast("bigint").alias("n_pages"),
                      F.col("extract_error").isNotNull().alias("failed"))


@query
def scan_files(spark, sf):
    """A2: pages landed as one file each, listed by binaryFile (content not read)."""
    f = _page_files_on_disk(spark, sf)
    return f.select(FS.landed_key("page_id").alias("file"), "length",
                    validate.size_ok("length", 4000).alias("within_limit"))


@query
def extract_pages(spark, sf):
    """A3: documents as files whose lines are pages (blank lines give id gaps)."""
    files = paragraphed(docs(spark, sf)).select(F.col("id").alias("file"), F.col("content").alias("text"))
    return FS.extract_pages(files, "text", NL)


@query
def job_events(spark, sf):
    """A5: the job-event table."""
    e = TB.job_events(spark, sf)
    return e.select("job_id", "event_id", "status", "progress", "message", "file_path",
                    "total_chapters",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"))


LIMIT_OVERRIDES = [("src0", None, 50, None), ("src1", 1048576, None, None), ("src2", None, None, False)]


def limit_overrides(spark) -> DataFrame:
    return spark.createDataFrame(LIMIT_OVERRIDES, "tenant string, max_file_size bigint, "
                                                  "max_chapters int, use_background_tasks boolean")


@query
def limits_resolved(spark, sf):
    """Default limits unless a tenant overrides them."""
    tenants = TB.read(spark, sf, "documents").select(F.col("source").alias("tenant")).distinct()
    return O.resolve_limits(tenants, limit_overrides(spark))


# --- B: sinks ----------------------------------------------------------------------

@query
def artifact_roundtrip(spark, sf):
    """B1: element rows written by job and read back.  The first run holds all jobs; a second
    one held stale rows of all jobs, was done again with a third of them, and replaces those; an
    attempt of a third run was never published."""
    pos = layout.chapter_positions(convs(spark, sf))
    els = layout.docx_elements(pos).withColumn("job_id", _conv_job_id())
    els = els.select("book_id", "job_id", "seq", "kind", "text")
    path = scratch_path(spark, "artifacts")
    write_artifacts(els.drop("book_id"), path, "0001")
    stale = els.withColumn("text", F.concat(F.lit("stale "), "text"))
    write_artifacts(stale.drop("book_id"), path, "0002")
    again = els.where(F.col("book_id") % 3 == 0).withColumn("text", F.concat(F.lit("v2 "), "text"))
    write_artifacts(again.drop("book_id"), path, "0002")
    store = RunStore(spark, path)
    store.write(store.begin(), "elements", stale.drop("book_id"))
    return read_artifacts(spark, path).select("job_id", "seq", "kind", "text")


@query
def published_downloads(spark, sf):
    """From landed requests to the download gate on what was written.  Books
    in two languages, landed again, are claimed from the ledger, run (some fail) and published;
    the run is then done again without every 5th book and replaces itself.  Probes are all jobs
    that the first attempt had, and each with a letter changed."""
    landing, at = scratch_path(spark, "requests"), scratch_path(spark, "published")
    landed_books(spark, sf).write.json(landing)
    lines = RQ.distinct_requests(RQ.read_requests(spark, landing))
    ledger = SubmissionLedger(spark, f"{at}-ledger")
    mine = lines.join(ledger.claim(lines, "run-1"), "submission", "left_semi").drop("submission", "_content")
    ch = _fault_key(RQ.request_chapters(mine).withColumn("book_id", F.col("book_id").cast("bigint")))
    tr = faults.FlakyModel(faults.fail_first_by_key(6))

    def attempt(chapters):
        return pipeline.run_jobs(chapters, tr, JOB_OPTIONS, key_col="fault_key", sleep=translate.no_sleep)

    first = pipeline.publish(attempt(ch), at, "run-1").read("jobs").select("job_id")
    probes = materialize(first.unionByName(first.select(F.translate("job_id", "0", "x").alias("job_id"))).distinct())
    store = pipeline.publish(attempt(ch.where(F.col("book_id") % 5 != 0)), at, "run-1")
    return jobs.download_gate(probes, jobs.run_state(store.read("events")), list_artifacts(spark, at))


def _conv_job_id():
    return T.job_id_hash(F.lit("chapters"), "book_id", F.lit(LANG), F.lit("docx"), F.lit("0"))


def _jobs_both_intakes(spark, sf):
    books = docs(spark, sf).groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    pages = FS.extract_pages(TB.page_files(spark, sf), "text", NL)
    files = pages.groupBy(F.col("file").cast("string").alias("book_id")).agg(
        F.count("*").alias("n_chapters"))
    return (jobs.submit_jobs(books, "chapters", LANG, "docx")
            .unionByName(jobs.submit_jobs(files, "files", LANG, "docx")))


@query
def submission_response(spark, sf):
    """Response body per accepted submission."""
    return jobs.submission_response(_jobs_both_intakes(spark, sf))


FILE_LIMITS = C.Limits(max_file_size=8000, max_chapters=2)


def _file_checks(spark, sf):
    """Files of 20 tenants, judged by the limits of each (D7: some override the default)."""
    f = FS.page_stats(TB.page_files(spark, sf), "text", NL).withColumn(
        "tenant", F.concat(F.lit("src"), (F.col("file") % 20).cast("string")))
    # Every fifth file with a character outside ASCII stands for one that does not decode.
    bad = (F.col("file") % 5 == 0) & (F.octet_length("text") != F.length("text"))
    f = f.withColumn("extract_error", F.when(bad, F.lit("not ASCII")))
    limits = O.resolve_limits(f.select("tenant").distinct(), limit_overrides(spark), FILE_LIMITS)
    return validate.tenant_file_reject_reason(f, limits)


@query
def rejects(spark, sf):
    """Refused files with their reason, written to the reject sink (twice, as a run that is
    done again would) and read back."""
    _, rej = validate.split_rejects(_file_checks(spark, sf))
    path = scratch_path(spark, "rejects")
    rej = rej.select("file", "name", "reject_reason")
    write_rejects(rej.limit(0), path, "0002")
    for _ in range(2):                                      # the run done again adds nothing
        write_rejects(rej, path, "0001")
    return read_rejects(spark, path).select("file", "reject_reason")


# --- C: projections / predicates ---------------------------------------------------

@query
def chapters_projected(spark, sf):
    return docs(spark, sf).select("book_id", "id", "content")


@query
def file_type_filter(spark, sf):
    f = TB.page_files(spark, sf)
    return f.select("file", "content_type", validate.is_pdf("content_type").alias("accepted"))


@query
def size_filter(spark, sf):
    f = TB.page_files(spark, sf)
    ok = validate.size_ok("length", 4000)
    return f.select("file", "length", ok.alias("accepted"),
                    F.when(~ok, validate.too_large_message(F.lit(4000))).alias("reject_reason"))


@query
def empty_extraction(spark, sf):
    """C4: files whose pages are all blank extract nothing and are refused."""
    files = blanked(docs(spark, sf)).select(F.col("id").alias("file"), F.col("content").alias("text"))
    j = FS.page_stats(files, "text", NL).select("file", "n_pages")
    empty = F.col("n_pages") == 0
    return j.select("file", "n_pages", empty.alias("empty"),
                    F.when(empty, F.lit(C.REJECT_NO_TEXT)).alias("reject_reason"))


@query
def max_chapters_guard(spark, sf):
    return validate.max_chapters_guard(convs(spark, sf), 5)


@query
def blank_chapter_guard(spark, sf):
    return validate.blank_chapter_guard(blanked(convs(spark, sf).withColumn("id", F.col("book_id") + F.col("ordinal")), 7, " \t"))


@query
def progress_domain(spark, sf):
    e = TB.job_events(spark, sf).select("event_id", (F.col("value") / 100.0).alias("progress"))
    return e.select("event_id", "progress", validate.progress_in_domain("progress").alias("in_domain"))


def _requested_format(col):
    return (F.when(col == "purchase", "pdf").when(col == "click", "PDF")
            .when(col == "view", "docx").when(col == "error", "txt"))


@query
def format_normalise(spark, sf):
    e = TB.read(spark, sf, "events")
    req = _requested_format(F.col("event_type"))
    return e.select("event_id", req.alias("requested"), T.normalise_format(req).alias("normalised"))


@query
def validation_first_failure(spark, sf):
    f = _file_checks(spark, sf)
    return f.select("file", "content_type", "length", "n_pages", "reject_reason")


def _state(spark, sf):
    return jobs.latest_state(TB.job_events(spark, sf))


@query
def download_gate(spark, sf):
    return jobs.download_gate(TB.job_probes(spark, sf), _state(spark, sf),
                              TB.artifact_listing(spark, sf))


# --- D: joins ----------------------------------------------------------------------

@query
def job_lookup(spark, sf):
    return jobs.lookup(TB.job_probes(spark, sf), _state(spark, sf))


@query
def job_lookup_missing(spark, sf):
    return jobs.lookup_missing(TB.job_probes(spark, sf), _state(spark, sf))


LANG_NAMES = {"en": "Inglês", "fr": "Francês", "de": "Alemão", "es": "Espanhol"}


@query
def language_semi(spark, sf):
    """D3: documents whose language (as a UI name) is in the UI list: semi and anti."""
    d = TB.read(spark, sf, "documents")
    name = TB.case_map(F.col("lang"), LANG_NAMES)
    req = d.select("doc_id", name.alias("language"))
    dim = F.broadcast(O.languages(spark).select("language", F.lit(True).alias("_in")))      # fixed 8 rows
    j = req.join(dim, "language", "left")
    return j.select("doc_id", "language", F.coalesce("_in", F.lit(False)).alias("supported"))


@query
def status_with_default(spark, sf):
    return jobs.status_with_default(TB.job_probes(spark, sf), _state(spark, sf))


def _edits(ch: DataFrame) -> DataFrame:
    first = ch.where(F.col("id") % 4 == 0).select(
        "book_id", "id", F.lit(1).alias("edit_seq"),
        F.concat(F.lit("[rev 1] "), F.col("content")).alias("content"))
    second = ch.where(F.col("id") % 8 == 0).select(
        "book_id", "id", F.lit(2).alias("edit_seq"),
        F.concat(F.lit("[rev 2] "), F.col("content")).alias("content"))
    return first.unionByName(second)


@query
def edit_update(spark, sf):
    ch = docs(spark, sf)
    return edits.update_chapters(ch, _edits(ch)).select("book_id", "id", "edited", "content")


@query
def styled_elements(spark, sf):
    """Both layouts of the conversation books with their styles attached."""
    pos = layout.chapter_positions(convs(spark, sf), paragraphs=True)
    st = O.styles(spark)
    d = layout.styled(layout.docx_elements(pos), st, "docx").withColumn("format", F.lit("docx"))
    p = layout.styled(layout.pdf_elements(pos), st, "pdf").withColumn("format", F.lit("pdf"))
    cols = ["format", "book_id", "seq", "kind", "font", "size", "align", "leading", "indent",
            "space_after", "height_in"]
    return d.select(*cols).unionByName(p.select(*cols))


@query
def page_geometry(spark, sf):
    """Page size, margins and the room for text with every DOCX book."""
    return docs(spark, sf).select("book_id").distinct().select("book_id", *O.page_geometry())


# --- E: aggregations ---------------------------------------------------------------

@query
def reassemble_chapters(spark, sf):
    """Identity translation shows the seams: every chunk stripped, joined by '\\n'."""
    t = pipeline.translate_books(docs(spark, sf), translate.IdentityModel())
    return t.chapters.select("book_id", "id", "content")


@query
def chapter_counts(spark, sf):
    return metrics.chapter_counts(docs(spark, sf))


@query
def chapter_length_lists(spark, sf):
    m = metrics.chapter_lists(convs(spark, sf))
    return m.select("book_id",
                    F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"),
                    F.array_join(F.transform("lengths", lambda x: x.cast("string")), ",")
                    .alias("lengths"))


@query
def next_chapter_id(spark, sf):
    """Over the customers' books (book = conversation), most of which have no chapter."""
    books = TB.read(spark, sf, "customer").select(F.col("c_custkey").cast("bigint").alias("book_id"))
    return edits.next_chapter_id(convs(spark, sf), books).select("book_id", "next_id")


@query
def layout_counts(spark, sf):
    """E5; extra empty chapters, so some books end in a chapter without pages."""
    return metrics.layout_counts(layout.chapter_shape(blanked(paragraphed(docs(spark, sf)), 7, "")))


@query
def extraction_summary(spark, sf):
    files = paragraphed(docs(spark, sf)).select(F.col("id").alias("file"), F.col("content").alias("text"))
    return metrics.extraction_summary(files, "text", NL)


@query
def char_volume(spark, sf):
    ch = docs(spark, sf).withColumn("source_chars", F.length("content"))
    t = pipeline.translate_books(ch, translate.LetterModel(), carry=["lang", "source_chars"])
    return t.chapters.groupBy("lang").agg(
        F.count("*").alias("n_chapters"),
        F.sum("source_chars").cast("bigint").alias("chars_in"),
        F.sum(F.length("content")).cast("bigint").alias("chars_out"))


@query
def chunk_plan(spark, sf):
    return chunking.chunk_plan(docs(spark, sf)).drop("ordinal")


# --- F: running numbers ------------------------------------------------------------

@query
def chapter_index(spark, sf):
    pos = layout.slim_positions(docs(spark, sf))
    return pos.select("book_id", "id", "ch_idx", "n_chapters")


@query
def page_numbers(spark, sf):
    pos = layout.slim_positions(docs(spark, sf))
    return layout.page_numbers(pos).select("book_id", "id", "page_idx", "page_no", "align")


@query
def page_breaks(spark, sf):
    ch = blanked(docs(spark, sf), 7, "")
    return layout.page_numbers(layout.slim_positions(ch)).select(
        "book_id", "id", "page_idx", "has_break")


@query
def translate_progress(spark, sf):
    return jobs.translate_progress(layout.slim_positions(convs(spark, sf))).drop("ordinal")


@query
def latest_job_state(spark, sf):
    return _state(spark, sf)


@query
def stage_durations(spark, sf):
    return jobs.stage_durations(TB.job_events(spark, sf))


# --- G: sorts / caps ---------------------------------------------------------------

@query
def ordered_chapters(spark, sf):
    """G1: stable sort on repeated ids (id = doc_id % 10, submission order = doc_id)."""
    ch = docs(spark, sf).select("book_id", (F.col("id") % 10).alias("id"), "ordinal")
    r = running_sums(ch, ["book_id"], ["id", "ordinal"], {"pos": F.lit(1)})
    return r.select("book_id", "id", "ordinal", (F.col("pos") + 1).alias("pos"))


@query
def paginate_docx(spark, sf):
    ch = docs(spark, sf)
    a = layout.paginate(ch, max_pages=C.MAX_PAGES_PER_CHAPTER).withColumn("layout", F.lit("default"))
    b = layout.paginate(ch, 500, 3).withColumn("layout", F.lit("small"))
    return a.unionByName(b).select("layout", "book_id", "id", "page_idx", "text")


@query
def truncation_audit(spark, sf):
    ch = docs(spark, sf)
    a = layout.truncation_audit(ch)
    b = layout.truncation_audit(ch, 500, 3)
    return (a.withColumn("layout", F.lit("default")).unionByName(b.withColumn("layout", F.lit("small")))
             .drop("ordinal"))


# --- H: set operations -------------------------------------------------------------

@query
def intake_union(spark, sf):
    typed = convs(spark, sf).select(F.concat(F.lit("conv-"), F.col("book_id").cast("string"))
                                    .alias("book_id"), "id", "content")
    pages = FS.extract_pages(TB.page_files(spark, sf), "text", NL).select(
        F.concat(F.lit("file-"), F.col("file").cast("string")).alias("book_id"), "id", "content")
    u = (typed.withColumn("intake", F.lit("chapters"))
         .unionByName(pages.withColumn("intake", F.lit("files")), allowMissingColumns=True))
    return u.select("book_id", "id", "intake", F.length("content").cast("bigint").alias("n_chars"))


@query
def edit_append(spark, sf):
    return edits.append_chapter(convs(spark, sf))


@query
def edit_remove(spark, sf):
    """H3: removals in order; those of every third book name all its chapters, so the last
    one is refused."""
    ch = convs(spark, sf)
    removals = ch.where((F.col("id") == 1) | (F.col("book_id") % 3 == 0)).select(
        "book_id", "id", F.col("id").alias("removal_seq"))
    return edits.remove_chapters(ch, removals).select("book_id", "id", "ordinal")


def interleaved_edits(ch: DataFrame) -> DataFrame:
    """A log of edits from the chapters themselves: appends (not in every third book), removals
    (in every 6th book of all its chapters), updates of old and of appended chapters, in one
    order per book."""
    n = ch.groupBy("book_id").agg(F.count("*").alias("n"))
    c, t = F.col("book_id"), F.col("ordinal")
    none, kind = F.lit(None), (c + t) % 5
    op = lambda when, seq, name, id_, content=none: F.struct(       # noqa: E731
        when.alias("when"), seq.alias("seq"), F.lit(name).alias("op"), id_.cast("bigint").alias("id"),
        content.cast("string").alias("content"))
    ops = F.array(
        op((kind <= 1) & (c % 3 != 0), 5 * t, "append", none), op(kind == 2, 5 * t, "remove", F.col("id")),
        op(kind == 3, 5 * t, "update", F.col("id"), F.concat(F.lit("[log] "), "content")),
        op(kind == 4, 5 * t, "remove", F.col("n") + 1),
        op((c * 7 + t) % 3 == 0, 5 * t + 1, "update", F.col("n") + 1 + t % 2, F.concat(F.lit("new "), t.cast("string"))),
        op(c % 6 == 0, 5 * t + 2, "remove", F.col("id")),
        op(((c + t) % 2 == 0) & (c % 3 != 0), 5 * t + 3, "append", none),
        op((c + t) % 4 == 0, 5 * t + 4, "update", F.col("n") + t, F.concat(F.lit("last "), "content")))
    rows = ch.join(n, "book_id").select("book_id", F.inline(F.filter(ops, lambda o: o["when"])))
    return rows.drop("when")


@query
def edit_log(spark, sf):
    """H2 / H3 / D6 / E4 in one order: what every edit did, and the chapters after the last."""
    ch = convs(spark, sf).drop("role")
    run = apply_log(ch, interleaved_edits(ch))
    edits_ = run.outcomes.select("book_id", "seq", "op", "id", "status", F.lit(None).cast("bigint").alias("ordinal"),
                                 F.lit(None).cast("string").alias("content"))
    return edits_.unionByName(run.chapters.select(
        "book_id", F.lit(None).cast("bigint").alias("seq"), F.lit("chapter").alias("op"), "id",
        F.lit("live").alias("status"), "ordinal", "content"))


# --- I: scalar functions -----------------------------------------------------------

@query
def blank_flags(spark, sf):
    ch = blanked(docs(spark, sf))
    return ch.select(F.col("id").alias("doc_id"), T.is_blank("content").alias("is_blank"))


@query
def strip_text(spark, sf):
    d = TB.read(spark, sf, "documents")
    padded = F.concat(F.lit(" "), F.col("text"), F.lit(NL))
    return d.select("doc_id", T.strip(padded).alias("stripped"))


@query
def chunk_chapters(spark, sf):
    return chunking.chunk_chapters(docs(spark, sf)).select("book_id", "id", "chunk_idx", "chunk")


@query
def drop_caps(spark, sf):
    p = layout.paginate(convs(spark, sf)).where(F.col("page_idx") == 0)
    return p.select("book_id", "id", T.first_char("text").alias("cap"),
                    T.rest_after_first("text").alias("rest"))


@query
def split_paragraphs(spark, sf):
    return layout.split_paragraphs(paragraphed(docs(spark, sf))).drop("ordinal")


@query
def xml_escape(spark, sf):
    p = TB.read(spark, sf, "pages")
    return p.select("page_id", T.xml_escape("html").alias("escaped"))


@query
def chapter_titles(spark, sf):
    return docs(spark, sf).select("book_id", "id", T.chapter_title("id").alias("title"))


@query
def size_text(spark, sf):
    f = TB.page_files(spark, sf)
    return f.select("file", "length", T.size_kb_text("length").alias("kb"),
                    T.size_mb_text("length", 1).alias("mb1"), T.size_mb_text("length", 2).alias("mb2"))


@query
def download_names(spark, sf):
    e = TB.job_events(spark, sf).where(F.col("file_path").isNotNull())
    return e.select("event_id", "file_path", T.file_extension("file_path").alias("ext"),
                    T.download_name("file_path").alias("filename"),
                    T.parent_dir("file_path").alias("parent"))


@query
def submit_jobs(spark, sf):
    return _jobs_both_intakes(spark, sf)


@query
def job_messages(spark, sf):
    pr = jobs.translate_progress(layout.slim_positions(convs(spark, sf)))
    return pr.select("book_id", "id", "message", (F.col("progress") * 100).alias("percent"))


@query
def mask_secret(spark, sf):
    """Whole names as keys, and besides them short keys around the length that shows both ends."""
    c = TB.read(spark, sf, "customer")
    short = c.select("c_custkey", F.substring("c_name", 1, (F.col("c_custkey") % 13).cast("int")).alias("key"))
    keys = c.select("c_custkey", F.col("c_name").alias("key")).unionByName(short)
    return keys.select("c_custkey", "key", T.mask_secret("key").alias("masked"))


@query
def build_prompts(spark, sf):
    ch = chunking.chunk_chapters(docs(spark, sf))
    p = translate.build_prompts(ch, LANG)
    return p.select("book_id", "id", "chunk_idx",
                    F.col("messages")[0]["role"].alias("system_role"),
                    F.col("messages")[0]["content"].alias("system_content"),
                    F.col("messages")[1]["role"].alias("user_role"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    "model", "temperature", "max_tokens")


@query
def parse_completion(spark, sf):
    d = TB.read(spark, sf, "documents")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message")))
        .alias("choices")))
    return translate.parse_completion(d.select("doc_id", body.alias("response"))).select(
        "doc_id", "content")


@query
def translate_mock(spark, sf):
    d = docs(spark, sf)
    return d.select(F.col("id").alias("doc_id"),
                    T.mock_translate_text("content", F.lit(LANG)).alias("text_mock"),
                    T.mock_translate_chapter("content", F.lit(LANG)).alias("chapter_mock"),
                    T.mock_translate_batch("id", F.lit(LANG)).alias("batch_mock"))


# --- J: translation ----------------------------------------------------------------

def _chunk_result(df: DataFrame) -> DataFrame:
    return df.select("book_id", "id", "chunk_idx", "translated", "attempts", "wait_s",
                     F.col("error").isNotNull().alias("failed"))


@query
def translate_chunks(spark, sf):
    ch = chunking.chunk_chapters(docs(spark, sf))
    return _chunk_result(translate.translate_chunks(ch, translate.LetterModel()))


@query
def translate_blank_skip(spark, sf):
    ch = chunking.chunk_chapters(blanked(docs(spark, sf)))
    return _chunk_result(translate.translate_chunks(ch, translate.LetterModel()))


@query
def translate_retry(spark, sf):
    ch = chunking.chunk_chapters(docs(spark, sf))
    tr = faults.FlakyModel(faults.fail_first_by_key(6))
    out = translate.translate_chunks(ch, tr, key_col="id", sleep=translate.no_sleep)
    return out.select("book_id", "id", "chunk_idx", "translated", "attempts", "wait_s", "error")


def _fault_key(ch: DataFrame) -> DataFrame:
    return ch.withColumn("fault_key", F.col("book_id") + F.col("ordinal"))


@query
def translate_books(spark, sf):
    """A book fails as a whole when any chunk still fails after the retries."""
    tr = faults.FlakyModel(faults.fail_first_by_key(6))
    t = pipeline.translate_books(_fault_key(convs(spark, sf)), tr, key_col="fault_key",
                                 sleep=translate.no_sleep)
    return t.outcomes.select("book_id", "failed", "error", "n_chunks", "n_calls")


@query
def translation_memory(spark, sf):
    """Two runs on one memory.  The second has new chapters besides; what the first has
    translated is not sent to the model again (no attempt)."""
    memory = translate.TranslationMemory(spark, scratch_path(spark, "memory"))
    ch = docs(spark, sf)
    first = translate.translate_chunks(chunking.chunk_chapters(ch), translate.LetterModel(), memory=memory)
    first = materialize(first.withColumn("run", F.lit(1)))
    new = ch.where(F.col("id") % 7 == 0).withColumns({
        "id": F.col("id") + EXTRA, "ordinal": F.col("ordinal") + EXTRA,
        "content": F.concat(F.lit("new "), F.col("content"))})
    second = translate.translate_chunks(chunking.chunk_chapters(ch.unionByName(new)), translate.LetterModel(), memory=memory)
    both = first.unionByName(second.withColumn("run", F.lit(2)))
    return both.select("run", "book_id", "id", "chunk_idx", "translated", "attempts", F.col("error").isNotNull().alias("failed"))


WAVE = 4


@query
def translate_waves(spark, sf):
    """Chunks of 200 characters in waves of 4, 8, ...; books stop after the wave in which a
    chunk failed for good (a tenth of the chunks of every third book do)."""
    ch = chunking.chunk_chapters(_fault_key(convs(spark, sf)), 200, carry=["fault_key"])
    ch = ch.withColumn("fault_key", F.when((F.col("book_id") % 3 == 0) & ((F.col("fault_key") + F.col("chunk_idx")) % 10 == 9), 5)
                       .otherwise(F.col("chunk_idx") % 3))
    store = RunStore(spark, scratch_path(spark, "waves"))
    out = translate.translate_in_waves(ch, faults.FlakyModel(faults.fail_first_by_key(6)), store=store, run="r", first=WAVE,
                                       key_col="fault_key", sleep=translate.no_sleep)
    return out.groupBy("book_id").agg(
        F.bool_or(F.col("error").isNotNull()).alias("failed"), F.max("wave").alias("last_wave"),
        F.count("*").alias("n_sent"), F.sum("attempts").cast("bigint").alias("n_calls"))


# --- K: jobs -----------------------------------------------------------------------

#: Books of more than six chapters are refused, so that the reject rows are not empty.
JOB_OPTIONS = C.PipelineOptions(limits=C.Limits(max_chapters=6))


@query
def job_lifecycle(spark, sf):
    """K2 / K3: the events of every job, chapter by chapter while it translates."""
    tr = faults.FlakyModel(faults.fail_first_by_key(6))
    run = pipeline.run_jobs(_fault_key(convs(spark, sf)), tr, JOB_OPTIONS, key_col="fault_key",
                            sleep=translate.no_sleep)
    return run.events.select("job_id", "seq", "step", "status", "progress", "message", "file_path", "current_chapter")


@query
def job_elements(spark, sf):
    """K7: the artifact rows of the same run, for books that succeeded."""
    tr = faults.FlakyModel(faults.fail_first_by_key(6))
    run = pipeline.run_jobs(_fault_key(convs(spark, sf)), tr, JOB_OPTIONS, key_col="fault_key",
                            sleep=translate.no_sleep)
    return run.elements.select("job_id", "seq", "kind", "chapter_id", "text", "page_no")


@query
def job_rejects(spark, sf):
    """K7: books over the chapter limit leave a row with the reason."""
    run = pipeline.run_jobs(convs(spark, sf), opts=JOB_OPTIONS)
    return run.rejects


@query
def job_errors(spark, sf):
    return jobs.job_errors(_state(spark, sf))


@query
def job_status(spark, sf):
    return jobs.status_view(_state(spark, sf))


@query
def open_jobs(spark, sf):
    return jobs.open_jobs(_state(spark, sf))


@query
def flagship_translate_books(spark, sf):
    """K7: the numbered pages of every translated book (documents, book = source)."""
    return pipeline.flagship(docs(spark, sf), translate.LetterModel())


# --- L: layout ---------------------------------------------------------------------

@query
def docx_elements(spark, sf):
    ch = blanked(docs(spark, sf), 7, "")
    els = layout.docx_elements(layout.chapter_positions(ch))
    return els.select("book_id", "seq", "kind", "chapter_id", "part_idx", "text", "page_no", "align")


@query
def pdf_elements(spark, sf):
    els = layout.pdf_elements(layout.chapter_positions(paragraphed(docs(spark, sf)), paragraphs=True))
    return els.select("book_id", "seq", "kind", "chapter_id", "part_idx", "text", "height_in")


@query
def layout_errors(spark, sf):
    """Extra chapters without content, and others with a character that XML does not allow,
    keep their heading, whose title carries the errors; display ids repeat (id = doc_id % 10),
    and only the faulty chapters are marked."""
    ch = docs(spark, sf)
    bad = ch.where(F.col("id") % 13 == 0).withColumns({
        "id": F.col("id") + 2 * EXTRA, "ordinal": F.col("ordinal") + 2 * EXTRA,
        "content": F.concat(F.lit("bad \x01"), "content")})
    ch = blanked(ch, 11, None).unionByName(bad).withColumn("id", F.col("id") % 10)
    els = layout.pdf_elements(layout.chapter_positions(ch, paragraphs=True))
    return els.select("book_id", "seq", "kind", "chapter_id", "element_error")


@query
def book_segments(spark, sf):
    """Book text as ordered segments with byte offsets; no book is gathered."""
    els = materialize(layout.docx_elements(layout.chapter_positions(docs(spark, sf))))
    return layout.book_segments(els)


@query
def render_book_text(spark, sf):
    els = layout.docx_elements(layout.chapter_positions(convs(spark, sf)))
    return layout.render_text(els)


# --- M: observability --------------------------------------------------------------

@query
def run_log_durations(spark, sf):
    return metrics.run_log(TB.job_events(spark, sf))


@query
def pipeline_metrics(spark, sf):
    ch = layout.chapter_shape(docs(spark, sf), paragraphs=False)
    per = ch.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"),
        F.sum(T.slice_count("content", C.CHUNK_SIZE, at_least_one=True)).alias("n_chunks"),
        F.sum("n_pages").alias("n_pages"),
        F.sum(F.length("content")).alias("n_chars"))
    return metrics.metrics_long(per, ["n_chapters", "n_chunks", "n_pages", "n_chars"])


@query
def run_log_stages(spark, sf):
    """M1 / M2: the engine's own log.  One stage writes the chapter shapes, its counts taken in
    the same pass; the next one fails on a chapter and leaves its failure row."""
    store = RunStore(spark, scratch_path(spark, "run-log"))
    log = RunLog(store, "run-1")
    ch = layout.chapter_shape(docs(spark, sf), paragraphs=False)
    with log.stage("layout", "documents") as stage:
        stage.watch(ch, n_chapters=F.count("*"), n_pages=F.sum("n_pages"), n_chars=F.sum(F.length("content")),
                    n_chunks=F.sum(T.slice_count("content", C.CHUNK_SIZE, at_least_one=True))
                    ).select("book_id", "id", "n_pages").write.parquet(scratch_path(spark, "shapes"))
    try:
        with log.stage("check", "documents") as stage:
            ch.select(F.assert_true(F.length("content") < 0, "chapter too long")).write.parquet(scratch_path(spark, "never"))
    except PySparkException:
        pass
    rows = log.read().select("stage", "subject", "status", (F.col("seconds") >= 0).alias("timed"),
                             F.col("error").contains("chapter too long").alias("told"),
                             F.explode_outer("metrics").alias("metric", "value"))
    return rows


# --- N: streaming ------------------------------------------------------------------

@query
def stream_intake(spark, sf):
    """Requests arriving as files are accepted or refused at once; one landed again, in this
    batch or an earlier one, is neither."""
    from ..streaming import queue
    root = scratch_path(spark, "queue")
    lines = request_lines(landed_books(spark, sf)).unionByName(faulty_lines(spark, sf))
    queue.drain_intake(lines, root, JOB_OPTIONS)
    jobs_, refused = queue.accepted(spark, root), queue.refused(spark, root)
    none = F.lit(None).cast("string")
    return jobs_.select("book_id", F.lit("accepted").alias("outcome"), "target_language", "output_format", "status",
                        F.col("total_chapters").cast("bigint").alias("n_chapters")).unionByName(refused.select(
                            "book_id", F.col("reject_reason").alias("outcome"), "target_language",
                            none.alias("output_format"), none.alias("status"), "n_chapters"))


@query
def stream_queue(spark, sf):
    """Accepted jobs wait in the job log until a run takes them.  The first run dies after
    it has claimed its jobs; taken up again, it and the next run do each job once."""
    from ..streaming import queue
    root = scratch_path(spark, "queue")
    queue.drain_intake(request_lines(landed_books(spark, sf)), root, JOB_OPTIONS)
    some = queue.waiting(spark, root).where(F.substring("job_id", 1, 1) < "8")
    queue.claims(spark, root).claim(some.select(F.col("job_id").alias("submission")), "run-1")     # and no more
    queue.run_waiting(spark, root, "run-2", opts=JOB_OPTIONS)
    queue.run_waiting(spark, root, "run-3", opts=JOB_OPTIONS)                                       # nothing left
    store = queue.runs(spark, root)
    n = store.read("jobs").groupBy("job_id").agg(F.count("*").alias("n_runs"), F.min("run").alias("run"))
    state = jobs.run_state(store.read("events")).select("job_id", "status", "file_path")
    return queue.accepted(spark, root).select("job_id", "book_id").join(n, "job_id", "left").join(state, "job_id", "left")


@query
def stream_translate(spark, sf):
    """Requests in two languages and formats, some landed again, run batch by batch."""
    from ..streaming import stream
    return stream.translate_query(spark, landed_books(spark, sf), JOB_OPTIONS)


@query
def stream_job_state(spark, sf):
    from ..streaming import stream
    return stream.job_state_query(spark, sf)


@query
def stream_job_timers(spark, sf):
    """Job state with timers: replayed events count once, stuck jobs end in an error row,
    closed jobs stay closed."""
    from ..streaming import stream
    return stream.timed_jobs_query(spark, sf)
