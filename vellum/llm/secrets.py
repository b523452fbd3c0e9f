"""Secret scan with an incremental blob ledger, in DataFrame functions only.

Every text is a blob named by its SHA-256.  The ledger (blob, rule_version, spans) is a
Parquet table bucketed and sorted by blob.  A scan looks only at the (blob, rule version)
pairs that the ledger lacks, once per blob however many documents hold it, appends what it
found (an empty list too, so that clean blobs count as seen) and joins the findings back
to all documents.

Positions of all matches of a pattern come from two built-ins: ``regexp_extract_all``
gives the matches and ``split`` by the same pattern the text between them, so starts are
running sums of lengths in code points.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..store import BucketedTable
from .common import documents, land, scratch

# Kind, pattern, group whose length counts, least length.  The first three
# are the base kinds in their listed order; "hex" and "access" state the least length in
# the pattern, which is the same because both match maximal runs.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
BASE = ("assign", "access", "hex")
VERSION = "2"
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
SCHEMA = f"blob BINARY, rule_version STRING, spans ARRAY<STRUCT<start: BIGINT, rank: INT, end: BIGINT, kind: STRING>>"


#: Matches whose lengths are added up together (see ``_spans``).
RUN = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of one rule in ``text``, as an array of spans in text order.

    A start is the length of all that comes before: whole runs of RUN matches, whose sums are
    added up once per run, and what precedes in its own run.  So the work grows with the
    matches and not with their square."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    none = F.array().cast(f"array<{SPAN}>")
    # The last gap has no hit behind it.
    matches = F.transform(F.filter(zipped, lambda x: x["hit"].isNotNull()), lambda x: F.struct(
        F.length(x["gap"]).cast("bigint").alias("gap"), F.length(x["hit"]).cast("bigint").alias("hit"),
        (F.length(x["part"]) >= least).alias("ok")))

    def located(m: Column) -> Column:
        both = F.transform(m, lambda x: x["gap"] + x["hit"])
        runs = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int"))
        return _let(both, lambda n: _let(F.transform(runs, lambda r: _total(F.slice(n, r * RUN + 1, RUN))), lambda sums: _let(
            F.transform(runs, lambda r: _total(F.slice(sums, F.lit(1), r))), lambda before: F.transform(m, lambda x, i: _span(
                x, F.get(before, F.floor(i / RUN).cast("int"))
                + _total(F.slice(n, F.floor(i / RUN).cast("int") * RUN + 1, i % RUN)) + x["gap"])))))

    def _span(x: Column, start: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["hit"]).alias("end"),
                        F.lit(kind).alias("kind"), x["ok"].alias("ok"))

    found = _let(matches, lambda m: F.transform(F.filter(located(m), lambda s: s["ok"]), lambda s: F.struct(
        s["start"], s["rank"], s["end"], s["kind"])))
    return F.when(text.rlike(pattern), found.cast(f"array<{SPAN}>")).otherwise(none)


def scan(blobs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """Adds ``spans``: all findings, by start, then kind as listed."""
    found = [_spans(F.col(text_col), i, *r) for i, r in enumerate(rules)]
    return blobs.withColumn("spans", F.array_sort(F.concat(*found)))


class BlobLedger:
    """``BlobLedger(spark, location).scan(docs)`` scans what is new and reports all."""

    def __init__(self, spark: SparkSession, location: str | None = None, rules=RULES,
                 rule_version: str = VERSION, buckets: int | None = None):
        self.spark, self.rules, self.version = spark, rules, rule_version
        self.table = BucketedTable(spark, location or scratch(spark, "blobs"), SCHEMA, "blob", buckets)

    def seen(self) -> DataFrame:
        return self.table.read().where(F.col("rule_version") == self.version)

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: doc_id, blob, spans (array of start, rank, end, kind).

        Null text is the empty text; empty texts have no spans.  Rows that repeat a
        doc_id or a text are each reported.  Other columns are not read.  A second scan
        of the same documents finds every pair in the ledger: texts are hashed, none is scanned."""
        d = documents(docs, id_col, text_col)
        blob = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob")
        paths = land(d.select("doc_id", blob), "paths")
        fresh = (paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
                      .join(self.seen().select("blob").hint("merge"), "blob", "left_anti"))
        # One document's text per unseen blob.  Documents without an id, or ids that repeat
        # with other texts, are told apart by the blob, which is compared as well.
        key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"),
                              F.hex("blob")), 256).alias("__key")
        texts = (d.select("doc_id", blob, "text").select(key, "blob", "text")
                  .join(fresh.select(key), "__key", "left_semi"))
        found = (scan(texts, "text", self.rules).select("blob", F.lit(self.version).alias("rule_version"), "spans")
                 .dropDuplicates(["blob"]))
        self.table.append(found)
        # Only blobs with findings travel to the documents; both sides of this join come
        # by a shuffle, which AQE splits where one blob has very many paths.
        hits = land(self.seen().where(F.size("spans") > 0).select("blob", "spans"), "findings")
        none = F.array().cast(f"array<{SPAN}>")
        return paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from (doc_id, spans)."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE],
                        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
