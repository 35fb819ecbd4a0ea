"""The benchmark workload (S5): row i -> status, amount, bucket.

``seed_columns`` derives the workload from any BIGINT row-index column, so it can be laid
over an existing table; ``seed_rows`` generates ``n`` rows with ``spark.range`` for the
benchmark.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def seed_columns(i: Column, tenant: str = "tenant-bench") -> list[Column]:
    # Status is "paid" for even i and "pending" for odd i; amount i%1000+1;
    # bucket "b" followed by i%10.
    return [
        F.lit(tenant).alias("tenant_id"),
        F.when(i % 2 == 0, F.lit("paid")).otherwise(F.lit("pending")).alias("status"),
        (i % 1000 + 1).cast("long").alias("amount"),
        F.concat(F.lit("b"), (i % 10).cast("string")).alias("bucket"),
    ]


def seed_from(df: DataFrame, index_col: str, tenant: str = "tenant-bench") -> DataFrame:
    """S5 over an existing index column (``_id`` = the index)."""
    i = F.col(index_col)
    return df.select(i.alias("_id"), *seed_columns(i, tenant))


def seed_rows(spark: SparkSession, n: int, tenant: str = "tenant-bench", partitions: int | None = None) -> DataFrame:
    """``n`` synthetic rows, generated in parallel (``createdAt`` fixed for repeatability)."""
    base = spark.range(0, n, numPartitions=partitions) if partitions else spark.range(0, n)
    i = F.col("id")
    created = F.lit(_dt.datetime(2024, 1, 1))
    return base.select(i.alias("_id"), *seed_columns(i, tenant), created.alias("createdAt"))
