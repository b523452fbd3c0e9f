"""The registered queries: each operator over its whole table, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_code, table_path
from . import (conversations, decontaminate, exact_dedup, language_id, licenses, merkle, near_dup, packing,
               secrets, substring, token_count, toxicity, url_filter)

#: The byte-level vocabulary of 50,257 ids, as ranks (see tokenizer.encoder).
VOCABULARY = "public:byte_bpe_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), VOCABULARY, limit=512)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), VOCABULARY, seq_len=2048, end_id=0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.DigestIndex(spark).add(read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_regions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.BlobLedger(spark).scan(read(spark, sf_dir, "documents"))
    return secrets.digest_columns(found)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(read(spark, sf_dir, "conversations"))
    return conversations.repair(damaged, present=F.col("present"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"), tampered=merkle.stripped_newlines())


QUERIES = {f.__name__: f for f in (
    op1_near_dup, op2_license_scan, op3_substring_dedup, op4_token_counts, op5_best_fit_packing,
    op6_exact_dedup, op7_url_filter, op8_decontaminate, op9_toxicity, op10_secret_scan, op11_language_id,
    op12_conversation_repair, op13_merkle_manifest)}
