"""The corpus pipeline: five operators in a row, each working on all that its predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; the last returns the mix itself: a row per taken stretch of a document, in
schedule order (``slot, at``), with the stretch as ``text`` and the words ``begin`` to ``until`` it covers; a document taken
twice is there twice, so the words of each source are its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, line_dedup, mixing, near_dedup, quality
from tallyspark.llm.staging import Staging, table_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Classifier, suffix arrays and hashing are not expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(table_path(sf_dir, "labels")))
    return quality.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines that a later document keeps; ``n_chars`` follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents free of benchmark passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(table_path(sf_dir, "benchmark"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches that the mix takes, in its order; ``n_chars`` follows the stretch."""
    mixed = mixing.mixed_texts(docs, keep=("lang",)).withColumn("n_chars", F.char_length("text").cast("long"))
    return mixed.select(*COLUMNS, "slot", "at", "begin", "until")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a table in the shared folder."""
    staging = Staging(spark, "pipeline")
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES:
        docs = staging.table(name, stage(spark, docs, sf_dir))
    return docs
