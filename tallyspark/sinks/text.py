"""Text report sinks (K1, K2, K3, K5, K8, K9).

Each report is one sorted frame of text lines written with ``write.text``.  The sort is a
range exchange, so part files in partition-number order (``part-<n>``) concatenate to the report; the
header / bracket lines ride in the same sorted frame under a leading sort key, so no driver
step ever touches the rows.  Output goes to ``<base>/<tenant>/<report_id>/report.<ext>/``,
overwritten on a retry (K9).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.render import csv_header, csv_line, json_line, qcol, utf8_bytes
from ..operators.ordering import RowCapExceeded, guard_row_cap, number_rows
from ..spec import MSG_ROW_CAP, MSG_SNAPSHOT_CAP


class SnapshotTooLarge(RuntimeError):
    pass


def _keyed(df: DataFrame, order: Sequence[Column], cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with a leading line kind ``__k`` (0 header, 1 data, 2 footer) and sort keys."""
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.select(F.lit(1).alias("__k"), *[c.alias(n) for c, n in zip(order, names)], *[qcol(c) for c in cols])
    return keyed, names


def _affix(keyed: DataFrame, key: int, probe: bool = False) -> DataFrame:
    """A framing row shaped like the keyed data (nulls everywhere but ``__k``).  With
    ``probe`` it exists only when a data row does (``limit(1)`` reads one row per split at
    most); otherwise it always exists."""
    cols = [F.lit(key).alias("__k")] + [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema.fields[1:]]
    return keyed.limit(1).select(*cols) if probe else keyed.sparkSession.range(1).select(*cols)


def _observed(frame: DataFrame, obs: Observation | None, kinds: Column) -> DataFrame:
    """Rows out, measured inside the write job (M1).  Placed after the sort: the range
    exchange samples its input in a separate job, which would count rows twice."""
    if obs is None:
        return frame
    return frame.observe(obs, F.coalesce(F.sum(F.when(kinds, 1)), F.lit(0)).alias("rows"))


def _render_sorted(frame: DataFrame, names: list[str], value: Column, obs: Observation | None, data: tuple[int, ...] = (1,)) -> DataFrame:
    """Sort the raw rows, then render: the range exchange samples and shuffles plain columns
    and every line is rendered once, after the shuffle."""
    return _observed(frame.sort("__k", *names), obs, F.col("__k").isin(*data)).select(value.alias("value"))


def csv_frame(
    df: DataFrame, order: Sequence[Column], columns: list[str] | None = None, probe: bool = True
) -> tuple[DataFrame, list[str], Column]:
    """K1 rows with their sort keys and the line expression (unsorted).

    ``probe=False`` emits the header unconditionally (no ``limit(1)`` branch, which runs one
    short task per input split); the caller then owns the empty case (see ``clear_if_empty``)."""
    cols = list(columns or df.columns)
    keyed, names = _keyed(df, order, cols)
    header = _affix(keyed, 0, probe=probe)
    framed = header.unionByName(keyed)
    value = F.when(F.col("__k") == 0, F.lit(csv_header(cols))).otherwise(csv_line(keyed, cols))
    return framed, names, value


def csv_lines(
    df: DataFrame, order: Sequence[Column], columns: list[str] | None = None, obs: Observation | None = None,
    probe: bool = True,
) -> DataFrame:
    """K1: header plus one escaped record per row, in total order; no rows -> no lines
    (with ``probe=False``: a header-only frame, to be cleared by the caller)."""
    framed, names, value = csv_frame(df, order, columns, probe)
    return _render_sorted(framed, names, value, obs)


def clear_if_empty(path: str, data_rows: int, spark) -> None:
    """Empty report -> zero bytes: replace a header-only output with an empty one."""
    if data_rows == 0:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def json_array_frame(
    df: DataFrame, order: Sequence[Column], columns: list[str] | None = None, unique: bool = True
) -> tuple[DataFrame, list[str], Column]:
    """K2 rows with their sort keys and the line expression (unsorted).

    The rows that share the smallest order key are counted first (two passes over the keys only).
    One row, as a total order has: it gets the ``[``.  Several, whatever ``unique`` declared: these
    rows alone are numbered, the first of them gets the ``[`` and stands at the head."""
    cols = list(columns or df.columns)
    keyed, names = _keyed(df, order, cols)
    key = F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)])
    smallest = keyed.sort(*names).limit(1).select(key).scalar()
    at_head = key.eqNullSafe(smallest)
    heads = keyed.where(at_head).count()
    if heads > 1:
        # any order will do among them; a random one spreads equal rows over the sort's partitions
        tied = number_rows(keyed.where(at_head).withColumn("__r", F.rand(17)), ["__r"], "__rn").drop("__r")
        keyed = keyed.where(~at_head).withColumn("__rn", F.lit(0).cast(tied.schema["__rn"].dataType)).unionByName(tied)
        keyed = keyed.withColumn("__k", F.when(F.col("__rn") == 1, F.lit(0)).otherwise(F.col("__k")))
    else:
        keyed = keyed.withColumn("__k", F.when(at_head, F.lit(0)).otherwise(F.col("__k")))
    line = json_line(keyed, cols)
    value = (
        F.when(F.col("__k") == 2, F.lit("]") if heads else F.lit("[]"))
        .when(F.col("__k") == 0, F.concat(F.lit("["), line))
        .otherwise(F.concat(F.lit(","), line))
    )
    return keyed.unionByName(_affix(keyed, 2)), names, value


def json_array_lines(
    df: DataFrame, order: Sequence[Column], columns: list[str] | None = None, obs: Observation | None = None,
    unique: bool = True,
) -> DataFrame:
    """K2: a JSON array, one element per line: ``[e1`` / ``,e2`` ... / ``]``; no rows -> ``[]``."""
    framed, names, value = json_array_frame(df, order, columns, unique)
    return _render_sorted(framed, names, value, obs, data=(0, 1))


def ndjson_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """K3 rows: one ``JSON.stringify`` line per row."""
    return df.select(json_line(df, columns).alias("value"))


def listing_lines(
    df: DataFrame, order: Sequence[Column], max_rows: int | None = None, columns: list[str] | None = None, obs: Observation | None = None
) -> DataFrame:
    """K5: ``"{i}. {json}"`` with i from 1 in report order; with a limit, row ``max_rows + 1`` is an error.

    The limit is checked first with ``limit(max_rows + 1)`` (tasks stop reading once enough
    rows are found), so an oversized report fails before anything is sorted or stored; the
    in-job guard stays as a second line."""
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise RowCapExceeded(MSG_ROW_CAP.format(max_rows, max_rows))
    cols = list(columns or df.columns)
    keyed = df.select(*[c.alias(f"__o{i}") for i, c in enumerate(order)], *[qcol(c) for c in cols])
    numbered = number_rows(keyed, [F.col(f"__o{i}") for i in range(len(order))])
    if max_rows is not None:
        numbered = guard_row_cap(numbered, max_rows)
    if obs is not None:
        numbered = numbered.observe(obs, F.count(F.lit(1)).alias("rows"))
    # number_rows leaves the rows range-partitioned and sorted; rendering after it keeps that order.
    line = json_line(numbered, cols)
    return numbered.select(F.concat(F.col("rn").cast("string"), F.lit(". "), line).alias("value"))


def snapshot_bytes(lines: DataFrame) -> Column:
    """K3 cap measure: UTF-8 bytes of every line plus its newline."""
    return F.coalesce(F.sum(utf8_bytes(F.col("value")) + F.lit(1)), F.lit(0)).cast("long")


def check_snapshot_size(lines: DataFrame, max_bytes: int | None = None) -> tuple[int, int]:
    """K3: fail before writing when the snapshot would pass ``max_bytes`` (None: no limit); returns
    ``(bytes, rows)`` from the same aggregate."""
    r = lines.agg(snapshot_bytes(lines).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if max_bytes is not None and r["b"] > max_bytes:
        raise SnapshotTooLarge(MSG_SNAPSHOT_CAP.format(max_bytes))
    return int(r["b"]), int(r["n"])


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> str:
    """K8/K9: write a one-column text frame, overwriting; ``compression='zip'`` -> gzip codec."""
    writer = lines.write.mode("overwrite")
    if compression == "zip":
        writer = writer.option("compression", "gzip")
    writer.text(path)
    return path


def report_path(base: str, tenant: object, report_id: str, *parts: str) -> str:
    """K9: ``<base>/<tenant>/<report_id>/<run id>/<entry>``; each part must be one plain path segment."""
    for part in (str(tenant), report_id, *parts):
        if not part or part in (".", "..") or any(ch in part for ch in "/\\\0"):
            raise ValueError(f"not a single path segment: {part!r}")
    return "/".join([base.rstrip("/"), str(tenant), report_id, *parts])
