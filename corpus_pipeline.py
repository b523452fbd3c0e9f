"""From raw documents to packed training sequences.

``STAGES`` in order: documents predicted toxic go; of exact copies one stays; of near
duplicates one stays; documents with a benchmark passage go; what is left is packed.  Each
stage but the last returns the columns of ``documents``; its result is written as Parquet
and reread as the next stage's input, so a stage that fails is run again from there.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import decontaminate, exact_dedup, near_dup, packing, toxicity
from vellum.llm.common import land
from vellum.llm.queries import VOCABULARY, read


#: Jaccard index, in percent, from which two documents are near duplicates here.
NEAR_DUP_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_representatives(docs, percent=NEAR_DUP_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, VOCABULARY, seq_len=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dup", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("packing", pack)]

#: No stage but the second is expressible in SQL; tests/llm/test_pipeline.py checks run() against
#: brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
