"""Retention by file statistics (L1): whole files are kept or dropped, only those that straddle the bound are rewritten.

A Parquet file's footer says the least and the largest time in it.  Files all of whose rows are young stay as they are,
files all of whose rows are old leave the list, and only the rest is read and written again.  The result is a *manifest*: a written list of
files, named by a pointer once it is whole; ``read_retained`` reads the files of the current one.  Footers are read in tasks, a row per file; no
data row is read for a file that is kept or dropped whole.  Files without statistics of the column (or with nulls in it, which no
window keeps) count as straddling, so the rows are always those of ``retained``.

The source's own files are never changed or deleted; a file that the manifest dropped may be deleted once no reader uses an older one.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.workbook import _open_store
from ..streaming.incremental import point_to
from ..streaming.keyed import versions
from .batch import retained

_EPOCH = _dt.datetime(1970, 1, 1, tzinfo=_dt.timezone.utc)


def _micros(value) -> int | None:
    """A footer's bound as microseconds since 1970 (a date is its midnight, UTC)."""
    if isinstance(value, _dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=_dt.timezone.utc)
        return (at - _EPOCH) // _dt.timedelta(microseconds=1)
    if isinstance(value, _dt.date):
        return (value - _EPOCH.date()).days * 86_400_000_000
    return None


def file_bounds(files: DataFrame, ts_col: str) -> DataFrame:
    """``(path, rows, low, high, nulls)`` per file of ``(path)``, from the footers; bounds are null where a row group has none."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _open_store("file://" + path[len("file:"):] if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_file(inner) as f:
                    meta = pq.ParquetFile(f).metadata
                low, high, nulls, sure = [], [], 0, True
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    column = next((c for c in map(group.column, range(group.num_columns)) if c.path_in_schema == ts_col), None)
                    stats = column.statistics if column is not None else None
                    if stats is None or not stats.has_null_count:
                        sure = False
                        continue
                    nulls += stats.null_count
                    if stats.has_min_max:
                        low.append(_micros(stats.min))
                        high.append(_micros(stats.max))
                    elif stats.null_count < group.num_rows:
                        sure = False
                sure = sure and None not in low
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([meta.num_rows], pa.int64()), pa.array([min(low) if sure and low else None], pa.int64()),
                                                  pa.array([max(high) if sure and high else None], pa.int64()), pa.array([nulls if sure else None], pa.int64())], names=["path", "rows", "low", "high", "nulls"])

    return files.select("path").mapInArrow(work, "path string, rows long, low long, high long, nulls long")


def retain_files(spark: SparkSession, source: str, ts_col: str, days: int, as_of: _dt.datetime, home: str) -> dict:
    """A new manifest under ``home`` of what ``retained`` keeps of ``source`` (a folder of Parquet files, or this ``home`` again).

    Returns how many files were kept, dropped and rewritten, and how many rows the kept and rewritten files hold."""
    epochs = versions(spark, home)
    version = epochs[-1] + 1 if epochs else 0
    if source.rstrip("/") == home.rstrip("/") and epochs:
        files = spark.read.parquet(f"{home}/manifest-{epochs[-1]}").select("path")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path")
    cut = _micros(as_of - _dt.timedelta(days=days))
    known = F.col("nulls").isNotNull()
    young = known & (F.col("nulls") == 0) & F.col("low").isNotNull() & (F.col("low") > cut)
    old = known & ((F.col("rows") == F.col("nulls")) | (F.col("high") <= cut))
    fate = F.when(F.coalesce(young, F.lit(False)), "kept").when(F.coalesce(old, F.lit(False)), "dropped").otherwise("rewritten")
    staged = f"{home}/_bounds-{version}-{uuid.uuid4().hex}"
    judged = file_bounds(files.repartition(max(1, min(files.count(), 4096)), "path"), ts_col).withColumn("fate", fate)
    judged.write.parquet(staged)
    judged = spark.read.parquet(staged)
    mixed = [r.path for r in judged.where("fate = 'rewritten'").select("path").toLocalIterator()]
    listed = judged.where("fate = 'kept'").select("path", "rows")
    if mixed:  # the files around the bound: names only
        part = f"{home}/rows-{version}"
        retained(spark.read.parquet(*mixed), ts_col, days, as_of).write.mode("overwrite").parquet(part)
        fresh = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(part).select("path")
        listed = listed.unionByName(file_bounds(fresh, ts_col).where("rows > 0").select("path", "rows"))
    listed.write.mode("overwrite").parquet(f"{home}/manifest-{version}")
    point_to(spark, home, version)
    counts = {r.fate: r["n"] for r in judged.groupBy("fate").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = spark.read.parquet(f"{home}/manifest-{version}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    from ..session import remove_path

    remove_path(spark, staged)
    return {"kept_files": counts.get("kept", 0), "dropped_files": counts.get("dropped", 0), "rewritten_files": counts.get("rewritten", 0), "rows": int(rows)}


def read_retained(spark: SparkSession, home: str, like: DataFrame) -> DataFrame:
    """The rows of the current manifest; ``like`` gives the schema (an empty manifest has no file to take it from)."""
    epochs = versions(spark, home)
    paths = [r.path for r in spark.read.parquet(f"{home}/manifest-{epochs[-1]}").select("path").toLocalIterator()] if epochs else []
    return spark.read.schema(like.schema).parquet(*paths) if paths else spark.createDataFrame([], like.schema)
