"""A streaming reduce kept as a keyed, versioned table (T1, update mode).

Each trigger writes only the groups it changed, as one delta; a version is the list of folders (a base and its
deltas) that hold it, written whole before a pointer names it.  Readers take the version that the pointer names and, per group,
the row of the latest epoch.  After ``compact_every`` deltas they are merged into a new base, so a reader never meets more folders
than that, and what a group costs follows how often it changes.  Every name is fixed by the epoch: a trigger that is run
again after a failure writes the same folders again.  Folders that neither the current version nor the one before names are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.render import qcol
from ..operators.reduce import output_columns, reduce_frame, report_view
from ..session import remove_path
from ..spec import ReduceSpec
from .incremental import point_to

EPOCH = "__epoch"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, home: str) -> list[int]:
    """Epochs of the versions that the pointer folder names (the last is the current one)."""
    folder, fs = _fs(spark, f"{home}/_current")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def folders_of(spark: SparkSession, home: str, epoch: int) -> list[str]:
    """The folders of a version, oldest first (a few names)."""
    path, fs = _fs(spark, f"{home}/_versions/{epoch:019d}.json")
    stream = fs.open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_version(spark: SparkSession, home: str, epoch: int, folders: list[str]) -> None:
    path, fs = _fs(spark, f"{home}/_versions/{epoch:019d}.json")
    stream = fs.create(path, True)
    stream.write(bytearray(json.dumps(folders).encode()))
    stream.close()


def _latest(rows: DataFrame, spec: ReduceSpec) -> DataFrame:
    """Per group the row of its latest epoch."""
    rest = [c for c in output_columns(spec) if c not in spec.keys]
    newest = F.max_by(F.struct(*[qcol(c) for c in rest]), F.col(EPOCH)).alias("__last")
    merged = rows.groupBy(*[qcol(k) for k in spec.keys]).agg(newest, F.max(EPOCH).alias(EPOCH))
    return merged.select(*[qcol(k) for k in spec.keys], *[F.col("__last").getField(c).alias(c) for c in rest], EPOCH)


def read_keyed(spark: SparkSession, home: str, spec: ReduceSpec) -> DataFrame | None:
    """The current version of a keyed stream; None before the first."""
    epochs = versions(spark, home)
    if not epochs:
        return None
    rows = spark.read.parquet(*[f"{home}/{f}" for f in folders_of(spark, home, epochs[-1])])
    return _latest(rows, spec).drop(EPOCH)


def start_keyed_stream(
    stream: DataFrame,
    spec: ReduceSpec,
    home: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    compact_every: int = 8,
) -> StreamingQuery:
    """Keep the reduce of ``stream`` current under ``home``; ``read_keyed`` reads it at any time."""
    result = report_view(reduce_frame(prepare(stream) if prepare else stream, spec), spec)

    def publish(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [e for e in versions(spark, home) if e < epoch]
        held = folders_of(spark, home, before[-1]) if before else []
        batch.withColumn(EPOCH, F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{home}/delta-{epoch}")
        folders = [*held, f"delta-{epoch}"]
        if len(folders) > compact_every:
            _latest(spark.read.parquet(*[f"{home}/{f}" for f in folders]), spec).write.mode("overwrite").parquet(f"{home}/base-{epoch}")
            folders = [f"base-{epoch}"]
        write_version(spark, home, epoch, folders)
        point_to(spark, home, epoch)
        clean(spark, home, {*held, *folders, f"delta-{epoch}"}, {epoch, *before[-1:]})

    writer = result.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()


def clean(spark: SparkSession, home: str, keep: set[str], epochs: set[int]) -> None:
    """Delete folders and lists that neither the current version nor the one before needs."""
    root, fs = _fs(spark, home)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(("delta-", "base-", "run-")) and name not in keep:
            remove_path(spark, f"{home}/{name}")
    lists, _ = _fs(spark, f"{home}/_versions")
    for status in fs.listStatus(lists):
        name = status.getPath().getName()
        if name.endswith(".json") and int(name[: -len(".json")]) not in epochs:
            fs.delete(status.getPath(), False)
