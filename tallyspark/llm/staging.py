"""Intermediate tables in the shared checkpoint folder.

A stage that several jobs read is written once as Parquet under ``spark.checkpoint.dir`` and read
back: that cuts lineage, and a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Staging:
    """A fresh folder for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.named: list[str] = []

    def table(self, name: str, frame: DataFrame, *partitions: str, **options) -> DataFrame:
        """Write ``frame`` (in folders by the columns ``partitions``) and return what reads it back."""
        frame.write.mode("error").options(**options).partitionBy(*partitions).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.path}/{name}")

    def bucketed(self, name: str, frame: DataFrame, column: str, buckets: int, **options) -> DataFrame:
        """``table``, dealt by ``column``: joins on it need no shuffle of this side.  ``forget`` drops its entry in the catalog."""
        self.named.append(f"{name}_{uuid.uuid4().hex}")
        frame.write.bucketBy(buckets, column).sortBy(column).options(**options).option("path", f"{self.path}/{name}").saveAsTable(self.named[-1])
        return self.spark.table(self.named[-1])

    def forget(self) -> None:
        """Drop the catalog entries of bucketed tables (their files stay until ``remove``)."""
        while self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop()}")

    def settle(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps: it does when the driver drops their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def remove(self, *names: str) -> None:
        """Delete tables that no later job reads (the whole folder when none is named)."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
            path.getFileSystem(hadoop).delete(path, True)

    def keep(self, *names: str) -> None:
        """Delete all tables but these."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        if gone := {f.getPath().getName() for f in found} - set(names):
            self.remove(*gone)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; ``lower`` serves the all-ASCII strings, where both agree."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Rows reach Python in batches of at most about ``limit`` bytes, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not str(now).isdigit() or int(now) <= 0 or int(now) > limit:
        spark.conf.set(key, str(limit))
