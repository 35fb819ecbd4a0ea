"""The registered queries of the operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (chat, decontaminate, filter_audit, katz, licenses, line_dedup, mixing, near_dedup, quality, repetition, secrets, toxicity,
               whitening)
from .staging import table_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_digest(_docs(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(spark, _docs(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_docs(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")))


def op4_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_digest(spark.read.parquet(table_path(sf_dir, "conversations")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(_docs(spark, sf_dir))


def op6_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_digest(_docs(spark, sf_dir))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_docs(spark, sf_dir))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_docs(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "benchmark")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_blocks(_docs(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_docs(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_digest(spark.read.parquet(table_path(sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_digest(_docs(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")))


def op13_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_digest(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_preference_formatting": op4_preference_formatting,
    "op5_secret_scan": op5_secret_scan,
    "op6_repetition_rules": op6_repetition_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_katz_scoring": op13_katz_scoring,
}
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_preference_formatting": chat.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
