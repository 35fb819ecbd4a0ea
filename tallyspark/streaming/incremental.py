"""A reduce report kept current as rows arrive (T1, the streaming form of A11).

The source folder is read as a file stream; the reduce is a streaming ``groupBy().agg()``
whose state store holds one partial row per group (count, sums, counts, min, max), so state
grows with the number of groups, not rows.  Groups are not time-based, so there is no
watermark; output mode is ``complete`` and each micro-batch replaces the result table.

The result table is written by ``foreachBatch`` into a folder (a shared filesystem on a
cluster), never collected to the driver.  Checkpoint and table folders default to the
session's ``spark.checkpoint.dir``.  ``trigger(availableNow=True)`` processes what is there
and stops -- the scheduled re-run of the reference; a processing-time trigger keeps it live.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.reduce import reduce_frame, report_view
from ..session import checkpoint_dir, remove_path
from ..spec import ReduceSpec


def stream_path(path: str) -> str:
    """A file stream watches a folder or a glob; a single local file becomes a one-file glob."""
    if os.path.isfile(path):
        return f"{path[:-1]}[{path[-1]}]"
    return path


def stream_source(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None,
    options: dict | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).options(**(options or {}))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(stream_path(path))


def start_reduce_stream(
    stream: DataFrame,
    spec: ReduceSpec,
    table_path: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the continuously maintained reduce; the latest result is at ``table_path``."""
    src = prepare(stream) if prepare else stream
    result = report_view(reduce_frame(src, spec), spec)

    def publish(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    writer = result.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()


def reduce_stream_once(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    spec: ReduceSpec,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    work_dir: str | None = None,
) -> DataFrame:
    """Run the stream over what is in ``source_path`` now, then read the result table."""
    base = (work_dir or checkpoint_dir(spark)).rstrip("/") + f"/reduce-stream-{uuid.uuid4().hex}"
    query = start_reduce_stream(
        stream_source(spark, source_path, schema), spec, f"{base}/table", f"{base}/checkpoint", prepare=prepare
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(f"{base}/table")


def point_to(spark: SparkSession, home: str, epoch: int) -> None:
    """Name ``epoch`` as the current one: an empty marker file, created whole or not at all."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{home}/_current/{epoch:019d}")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(marker.getParent())
    fs.create(marker, True).close()
    for old in fs.listStatus(marker.getParent()):
        if old.getPath().getName().isdigit() and int(old.getPath().getName()) < epoch:
            fs.delete(old.getPath(), False)


def current_report(spark: SparkSession, base: str, spec) -> str | None:
    """Folder of the latest whole report of a report stream; None before the first."""
    from ..sinks.text import report_path

    home = report_path(base, spec.tenant, spec.report_id)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/_current")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    epochs = [int(s.getPath().getName()) for s in fs.listStatus(marker) if s.getPath().getName().isdigit()] if fs.exists(marker) else []
    return f"{home}/epoch-{max(epochs)}/{spec.entries[0]}" if epochs else None


def start_report_stream(
    spark: SparkSession,
    spec,
    registry,
    base: str,
    *,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files: int | None = None,
    max_groups: int | None = None,
    listing_max_rows: int | None = None,
) -> StreamingQuery:
    """T1 end to end: a reduce report over a growing source folder, re-rendered on each
    trigger (csv, json or pdf listing); ``current_report`` gives the latest one's folder.

    The tenant and filter scope is applied to the stream before the aggregate, so state holds
    only that tenant's groups.  Every micro-batch writes the full, ordered result (complete mode)
    to ``<base>/<tenant>/<report_id>/epoch-<n>/report.<ext>`` and then names that epoch in a
    pointer table, so a reader finds a whole report at any time; the epoch before the last is
    deleted.  The limits (groups, listing rows) hold only where passed and end the query."""
    from ..operators.filters import equality_filter
    from ..operators.reduce import enforce_group_cap, group_order
    from ..sinks.text import csv_lines, json_array_lines, listing_lines, report_path, write_lines
    from ..sources.registry import scan_tenant

    if spec.reduce is None or spec.format not in ("csv", "json", "pdf"):
        raise ValueError("a report stream needs a reduce spec and a csv, json or pdf format")
    source = registry.resolve(spec.source)
    schema = source.load(spark).schema
    stream = stream_source(spark, source.path, schema, source.format, max_files, dict(source.options))
    scoped = scan_tenant(stream, source, spec.tenant, equality_filter(stream, spec.filters, forbid=(source.tenant_col,)))
    result = report_view(reduce_frame(scoped, spec.reduce), spec.reduce)
    home = report_path(base, spec.tenant, spec.report_id)
    order = group_order(spec.reduce, schema=result.schema)
    render = {"csv": lambda b: csv_lines(b, order), "json": lambda b: json_array_lines(b, order),
              "pdf": lambda b: listing_lines(b, order, listing_max_rows)}[spec.format]

    def publish(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()  # the header probe, the range sample and the write read one result
        try:
            target = f"{home}/epoch-{epoch}/{spec.entries[0]}"
            write_lines(render(enforce_group_cap(batch, max_groups)), target, spec.compression)
            point_to(batch.sparkSession, home, epoch)
        finally:
            batch.unpersist()
        remove_path(batch.sparkSession, f"{home}/epoch-{epoch - 2}")

    ckpt = checkpoint or (checkpoint_dir(spark).rstrip("/") + f"/report-stream-{spec.report_id}-{uuid.uuid4().hex}")
    writer = result.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(publish)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()
