"""Text reports of many groups, one folder per group (L2), in any number of folders.

The sorted lines stay where the sort left them; each task streams its stretch into the folders of
the groups that it holds, one open file at a time, through ``pyarrow.fs`` (as the workbooks are
written).  Spark's own partitioned writer asks Hadoop's local file system for a folder, a file and
its checksum file per group, and without Hadoop's native library each of the three starts a
``chmod`` process: with tens of thousands of groups these processes are most of the work.

Folders are named as Spark names partitions, so ``spark.read.text(path)`` finds the group column.
That read lists every file on the driver; ``read_text_folders`` goes by the list of files that the
write leaves in ``<path>/_files`` (a name that Spark's readers skip) and keeps nothing per file there.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import qcol
from ..session import remove_path
from .workbook import _open_store, qualified

BLOCK = 4 << 20  # bytes of a file held at once when it is read
TASK_BYTES, FILE_BYTES = 8 << 20, 16 << 10  # what a reading task takes, and what opening a file counts as
FILES = "file string, length long"
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"  # Spark's name for null and for the empty string
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 0x20), 0x7F, *map(ord, "\"#%'*/:=?\\{[]^")]}


def folder_name(column: str, value: str) -> str:
    """``column=value`` with the characters escaped that Spark escapes in partition folders."""
    return f"{column.translate(_ESCAPED)}={value.translate(_ESCAPED)}"


def folder_value(name: str) -> str | None:
    """The value that a folder's name stands for, as text."""
    value = name.partition("=")[2]
    return None if value == NULL_FOLDER else re.sub("%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), value)


def _runs(names: pa.Array) -> list[int]:
    """Where each stretch of equal names begins, and the end."""
    changes = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changes) + 1).tolist(), len(names)]


def _listed(made: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["file", "length"])


def write_text_folders(lines: DataFrame, column: str, path: str) -> None:
    """Write ``value`` of the rows of each ``column`` value to ``<path>/<column>=<value>/part-<task>-*.txt``, replacing ``path``.

    Each stretch of equal values in a partition is one file, so ``lines`` should come sorted by ``column``.
    Names are fixed by task and stretch: a retried task overwrites its own files.  ``_SUCCESS`` is written
    last; a failed write is deleted.  ``<path>/_files`` lists ``file`` (below ``path``) and ``length``.  A store that Arrow
    cannot open is written by Spark's own writer, without the list."""
    spark = lines.sparkSession
    uri, run = qualified(spark, path), uuid.uuid4().hex
    try:
        store, base = _open_store(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        lines.write.mode("overwrite").partitionBy(column).text(path)
        return

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_store(uri)
        root, task = root.rstrip("/"), TaskContext.get().partitionId()
        stream, here, file, length, files = None, None, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, made = batch.column(0), []
            ended = pc.binary_join_element_wise(pc.fill_null(batch.column(1), ""), "", "\n")
            ends = np.frombuffer(ended.buffers()[1], np.int32)[ended.offset : ended.offset + len(ended) + 1].tolist()
            runs = _runs(names)
            for first, until in zip(runs[:-1], runs[1:]):
                name = names[first].as_py()
                if name != here:
                    if stream is not None:
                        stream.close()
                        made.append((file, length))
                    folder = folder_name(column, name)
                    fs.create_dir(f"{root}/{folder}", recursive=True)
                    file = f"{folder}/part-{task:05d}-{run}.c{files:06d}.txt"
                    stream = fs.open_output_stream(f"{root}/{file}")
                    here, length, files = name, 0, files + 1
                stream.write(ended.buffers()[2].slice(ends[first], ends[until] - ends[first]))
                length += ends[until] - ends[first]
            yield _listed(made)
        if stream is not None:
            stream.close()
            yield _listed([(file, length)])

    name = F.coalesce(F.nullif(qcol(column).cast("string"), F.lit("")), F.lit(NULL_FOLDER))
    remove_path(spark, path)
    try:
        lines.select(name.alias("name"), "value").mapInArrow(work, FILES).write.parquet(f"{path.rstrip('/')}/_files")
        store.create_dir(base, recursive=True)
        store.open_output_stream(f"{base.rstrip('/')}/_SUCCESS").close()
    except BaseException:
        remove_path(spark, path)
        raise


def read_text_folders(spark: SparkSession, path: str, column: str) -> DataFrame:
    """``(column as text, value)``: every line (as ``spark.read.text`` cuts lines) of what ``write_text_folders`` wrote to ``path``."""
    uri = qualified(spark, path)
    try:
        _open_store(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return spark.read.schema(f"value string, `{column}` string").text(path).select(qcol(column), "value")
    files = spark.read.schema(FILES).parquet(f"{path.rstrip('/')}/_files")
    weight = files.agg(F.coalesce(F.sum(F.col("length") + FILE_BYTES), F.lit(0))).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_store(uri)
        values, lines, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], names=["name", "value"])

        for some in batches:
            for file in some.column(0).to_pylist():
                value, rest = folder_value(file.partition("/")[0]), b""
                with fs.open_input_stream(f"{root.rstrip('/')}/{file}") as stream:
                    while block := stream.read(BLOCK):
                        whole, end, rest = (rest + block).rpartition(b"\n")
                        got = (whole + end).splitlines()
                        values += [value] * len(got)
                        lines += got
                        held += len(block)
                        if held >= BLOCK:
                            yield batch()
                            values, lines, held = [], [], 0
        yield batch()

    read = files.repartition(1 + weight // TASK_BYTES, "file").mapInArrow(work, "name string, value string")
    return read.select(F.col("name").alias(column), "value")
