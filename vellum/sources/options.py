"""Options and small fixed dimensions as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as C

STYLE_SCHEMA = ("format string, kind string, font string, size double, style_align string, "
                "leading double, indent double, space_after double, style_height double")


def languages(spark: SparkSession) -> DataFrame:
    """The 8 UI languages, in UI order (a fixed 8-row table: safe to broadcast)."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(C.LANGUAGES)],
                                 "language string, position int")


def styles(spark: SparkSession) -> DataFrame:
    """Style per (format, kind): a fixed 10-row table."""
    return spark.createDataFrame(C.STYLES, STYLE_SCHEMA)


def page_geometry() -> list[Column]:
    """Page size and margins in inches, and the room they leave for text, as columns."""
    values = {"page_width_in": C.PAGE_WIDTH_IN, "page_height_in": C.PAGE_HEIGHT_IN,
              "margin_left_in": C.MARGIN_LEFT_IN, "margin_right_in": C.MARGIN_RIGHT_IN,
              "margin_top_in": C.MARGIN_TOP_IN, "margin_bottom_in": C.MARGIN_BOTTOM_IN,
              "text_width_in": C.PAGE_WIDTH_IN - C.MARGIN_LEFT_IN - C.MARGIN_RIGHT_IN,
              "text_height_in": C.PAGE_HEIGHT_IN - C.MARGIN_TOP_IN - C.MARGIN_BOTTOM_IN}
    return [F.lit(v).alias(k) for k, v in values.items()]


def resolve_limits(tenants: DataFrame, overrides: DataFrame, limits: C.Limits = C.Limits()) -> DataFrame:
    """Default limits unless a tenant overrides them (NULL = keep the default)."""
    j = tenants.join(overrides, "tenant", "left")
    return j.select(
        "tenant",
        F.coalesce("max_file_size", F.lit(limits.max_file_size)).cast("bigint").alias("max_file_size"),
        F.coalesce("max_chapters", F.lit(limits.max_chapters)).cast("int").alias("max_chapters"),
        F.coalesce("use_background_tasks", F.lit(limits.use_background_tasks))
        .alias("use_background_tasks"))
