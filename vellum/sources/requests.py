"""Book requests as JSON lines: one request per line with a nested chapter list.

A submission is what was asked for: the book, the chapters, the language and the format.  It
is named by a digest of these, so a line that is landed twice is one submission, and a book
asked for in two languages, or with other text, is two."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import text as X
from ..operators.scan import running_sums

CHAPTER = T.StructType([T.StructField("id", T.LongType()), T.StructField("content", T.StringType())])
REQUEST_SCHEMA = T.StructType([
    T.StructField("book_id", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("chapters", T.ArrayType(CHAPTER)),
    T.StructField("target_language", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("submission_key", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Explicit schema, no inference; malformed lines and wrongly typed values keep the
    raw text in ``_corrupt_record``."""
    return (spark.read.schema(REQUEST_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


IN_PARTS = "a stream takes whole books, not parts"


def schema_reject_reason(requests: DataFrame, whole: bool = False) -> DataFrame:
    """Required fields present and typed.  A wrongly typed value sets the corrupt column;
    a missing field does not, hence both tests.  ``whole``: parts of books are refused, since
    on a stream nothing says when the last one has come."""
    bad_chapter = F.exists(F.coalesce("chapters", F.array()),
                           lambda c: c["id"].isNull() | c["content"].isNull())
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed request"))
               .when(F.col("chapters").isNull(), F.lit("field required: chapters"))
               .when(F.col("target_language").isNull(), F.lit("field required: target_language"))
               .when(bad_chapter, F.lit("chapter needs an integer id and a content")))
    if whole and "part" in requests.columns:
        reason = reason.when(F.col("part").isNotNull(), F.lit(IN_PARTS))
    return requests.withColumn("schema_error", reason)


def _coded(c) -> Column:
    """Length and value, so that two lists of fields never give one text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("n"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """The request lines with ``submission``, each once however often it was landed.

    A line without ``part`` is a whole book: its submission is the digest of book, language,
    format, ``submission_key`` (the sender's own, optional) and chapters.  Lines with ``part``
    make up one submission per book, language, format and ``submission_key``; a line that
    repeats part and chapters is a replay."""
    opt = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")      # noqa: E731
    part = opt("part").cast("bigint")
    texts = F.transform(F.coalesce("chapters", F.array()), lambda c: F.concat(_coded(c["id"]), _coded(c["content"])))
    content = F.sha2(F.array_join(texts, ""), 256)
    named = F.concat(*[_coded(c) for c in (F.col("book_id"), opt("target_language"),
                                           X.normalise_format(opt("output_format")), opt("submission_key"))])
    r = requests.withColumn("_content", content).withColumn(
        "submission", F.sha2(F.concat(named, F.when(part.isNull(), F.col("_content")).otherwise(F.lit("parts"))), 256))
    return r.dropDuplicates(["submission", *(["part"] if "part" in requests.columns else []), "_content"])


def request_chapters(requests: DataFrame) -> DataFrame:
    """One row per chapter of every submission; the position in the list is kept as
    ``ordinal`` (it makes the later sort by id stable).  In a submission of several parts the
    ordinals go on from part to part, whatever their sizes, in the order of ``part`` and, for
    equal parts, of a digest of the chapters."""
    r = distinct_requests(requests)
    part = F.coalesce(F.col("part"), F.lit(0)) if "part" in r.columns else F.lit(0)
    r = r.withColumn("_part", part.cast("bigint"))
    key = ["submission", "_part", "_content"]
    sizes = r.select(*key, F.coalesce(F.size("chapters"), F.lit(0)).alias("_n"))
    before = running_sums(sizes, ["submission"], ["_part", "_content"], {"_before": F.col("_n")}).drop("_n")
    fmt = "output_format" if "output_format" in r.columns else F.lit(None).cast("string").alias("output_format")
    return r.select(*key, "book_id", "target_language", fmt, "chapters").join(before, key).select(
        "book_id", "submission", "target_language", "output_format", "_before",
        F.posexplode("chapters").alias("pos", "ch"),
    ).select("book_id", "submission", F.col("ch.id").alias("id"),
             (F.col("_before") + F.col("pos")).cast("bigint").alias("ordinal"),
             F.col("ch.content").alias("content"), "target_language", "output_format")


def requests_from_chapters(chapters: DataFrame, target_language: str,
                           part_size: int | None = 100) -> DataFrame:
    """Request rows from chapter rows (dense ordinals per book): parts of ``part_size``
    chapters, or with ``None`` one request per book (no part)."""
    ch = F.array_sort(F.collect_list(F.struct("ordinal", "id", "content")))
    part = F.floor(F.col("ordinal") / F.lit(part_size)) if part_size else F.lit(None)
    return chapters.groupBy("book_id", part.cast("bigint").alias("part")).agg(ch.alias("_c")).select(
        F.col("book_id").cast("string").alias("book_id"), "part",
        F.transform("_c", lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content")))
        .alias("chapters"),
        F.lit(target_language).alias("target_language"))
