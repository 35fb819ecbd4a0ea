"""NDJSON snapshots (K3 write side, S4 read side).

A snapshot is the rendered rows of a report as JSON lines in a shared folder, written once
and read by every later pass.  A byte limit, if the caller sets one, is checked before anything is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.render import normalize
from ..sinks.text import check_snapshot_size, ndjson_lines, write_lines


def write_snapshot(df: DataFrame, path: str, max_bytes: int | None = None) -> tuple[T.StructType, int, int]:
    """K3: normalise (dates -> ISO text), check the byte limit if there is one, write NDJSON.

    Returns the normalised schema (to read the snapshot back), its size in bytes and its
    row count.  The check is a plain aggregate that stores nothing, so an input far over the
    cap fails without being cached or written; only a passing snapshot is rendered again."""
    rows = normalize(df)
    lines = ndjson_lines(rows)
    size, n = check_snapshot_size(lines, max_bytes)
    write_lines(lines, path)
    return rows.schema, size, n


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read NDJSON with a fixed schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
