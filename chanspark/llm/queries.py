"""The registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chanspark.llm import audit, chunks, linededup, middle, pieces, ppm, sharding, simhash, substrings, suffix_dedup, templates, tokenfiles, warc

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.summary(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summary(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edits(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.summary(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(documents(spark, sf_dir))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), with_text=False)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.summary(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.fill_in_middle(documents(spark, sf_dir), with_text=False)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_warc, op4_document_fingerprints, op5_decontamination, op6_token_files, op7_line_dedup, op8_simhash_near_dedup, op9_substring_dedup, op10_sharding, op11_filter_audit, op12_fill_in_middle, op13_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": templates.ORACLE_MATCHES, "op7_line_dedup": linededup.ORACLE_SUMMARY, "op10_sharding": sharding.ORACLE_SUMMARY, "op11_filter_audit": audit.ORACLE_AUDIT, "op12_fill_in_middle": middle.ORACLE_SUMMARY}
