"""Driver tables mapped onto the pipeline's inputs.

| input                | table          | rule                                                     |
| chapters (long)      | documents      | book = source, id = ordinal = doc_id, content = text     |
| chapters (small)     | conversations  | book = conv_id, id = turn + 1, ordinal = turn            |
| files                | pages          | file = page_id, name = url, size = UTF-8 bytes of html,  |
|                      |                | type = pdf unless page_id % 3 = 0                        |
| job events           | events         | job = user_id; signup/view/click/purchase/error ->       |
|                      |                | queued/translating/formatting/completed/error            |
| job probes           | customer       | job id = c_custkey                                       |
| artifacts on disk    | orders         | output/{o_custkey}.{pdf if o_orderstatus = 'O' else docx}|
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..session import table_path


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def document_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("book_id"), F.col("doc_id").alias("id"),
                    F.col("doc_id").alias("ordinal"), F.col("text").alias("content"), "lang")


def conversation_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).alias("id"),
                    F.col("turn").alias("ordinal"), F.col("text").alias("content"), "role")


STATUS_OF_EVENT = {
    "signup": C.STATUS_QUEUED,
    "view": C.STATUS_TRANSLATING,
    "click": C.STATUS_FORMATTING,
    "purchase": C.STATUS_COMPLETED,
    "error": C.STATUS_ERROR,
}
MESSAGE_OF_STATUS = {
    C.STATUS_QUEUED: C.MSG_QUEUED,
    C.STATUS_TRANSLATING: C.MSG_TRANSLATING,
    C.STATUS_FORMATTING: C.MSG_FORMATTING,
    C.STATUS_COMPLETED: C.MSG_COMPLETED,
}


def case_map(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def event_format(value) -> F.Column:
    return F.when(value > 50, F.lit("pdf")).otherwise(F.lit("docx"))


def job_event_columns() -> list:
    """Projection of an ``events`` row onto a job event (batch and stream alike)."""
    status = case_map(F.col("event_type"), STATUS_OF_EVENT)
    return [
        F.col("user_id").alias("job_id"), F.col("event_id"), F.col("ts"),
        status.alias("status"),
        case_map(status, dict(C.PROGRESS)).cast("double").alias("progress"),
        F.when(status == C.STATUS_ERROR, F.concat(F.lit(C.MSG_ERROR_PREFIX), F.col("props")))
         .otherwise(case_map(status, MESSAGE_OF_STATUS)).alias("message"),
        F.when(status == C.STATUS_COMPLETED,
               F.concat(F.lit(C.OUTPUT_DIR + "/"), F.col("user_id").cast("string"), F.lit("."),
                        event_format(F.col("value")))).alias("file_path"),
        F.when(status == C.STATUS_TRANSLATING,
               F.get_json_object("props", "$.k").cast("int")).alias("current_chapter"),
        F.when(status == C.STATUS_QUEUED,
               F.get_json_object("props", "$.k").cast("int")).alias("total_chapters"),
    ]


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(*job_event_columns(), "value", "event_type")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("file"), F.col("url").alias("name"),
        F.when(F.col("page_id") % 3 != 0, F.lit(C.PDF_CONTENT_TYPE))
         .otherwise(F.lit("text/html")).alias("content_type"),
        F.octet_length("html").cast("bigint").alias("length"),
        F.col("html").alias("text"))


def job_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))


def artifact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    ext = F.when(F.col("o_orderstatus") == "O", F.lit("pdf")).otherwise(F.lit("docx"))
    return o.select(F.concat(F.lit(C.OUTPUT_DIR + "/"), F.col("o_custkey").cast("string"),
                             F.lit("."), ext).alias("path")).distinct()
