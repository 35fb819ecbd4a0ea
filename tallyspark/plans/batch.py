"""Many reports in one pass (L1, L2, L3).

* L2 -- every tenant's reduce in one job: the tenant becomes the leading group key, and a
  write partitions the output by tenant.  A tenant holding a third of all rows costs one
  partial row per map task (map-side combine), never one task holding its rows.  Raw reports
  (CSV / JSON) and workbooks of every tenant also come out of one sorted pass, one folder
  per tenant (``all_tenant_lines``, ``all_tenant_workbooks``).
* L3 -- a table of saved specs, all due ones from one scan: see ``plans/saved.py``.
* L1 -- retention: rows younger than ``days`` at ``as_of``, as a pushed-down range filter,
  and a rewrite of the retained rows to a new location (``apply_retention``).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.render import csv_header, csv_line, json_line, qcol
from ..operators.reduce import reduce_frame, report_view
from ..sinks.folders import write_text_folders
from ..spec import ReduceSpec
from .saved import due_specs, run_specs, run_status, write_specs  # noqa: F401


def reduce_all_tenants(df: DataFrame, tenant_col: str, spec: ReduceSpec) -> DataFrame:
    """L2: the reduce of every tenant at once, tenant first."""
    return report_view(reduce_frame(df, spec, extra_keys=(tenant_col,)), spec, extra_keys=(tenant_col,))


def write_per_tenant(df: DataFrame, tenant_col: str, path: str, fmt: str = "parquet") -> None:
    """L2 sink: one folder per tenant (``tenant=<value>/``), overwritten as a whole."""
    df.write.mode("overwrite").partitionBy(tenant_col).format(fmt).save(path)


def _bound(df: DataFrame, ts_col: str, days: int, as_of: _dt.datetime):
    """The cut-off as a literal of the column's own type (no cast on the column side)."""
    return F.lit(as_of - _dt.timedelta(days=days)).cast(df.schema[ts_col].dataType)


def retained(df: DataFrame, ts_col: str, days: int, as_of: _dt.datetime) -> DataFrame:
    """L1: rows with ``ts + days > as_of``, written as ``ts > as_of - days`` so the bound is
    a literal the Parquet scan can prune row groups with."""
    return df.filter(F.col(ts_col) > _bound(df, ts_col, days, as_of))


def expired(df: DataFrame, ts_col: str, days: int, as_of: _dt.datetime) -> DataFrame:
    """L1 complement: what a retention rewrite drops."""
    return df.filter(F.col(ts_col) <= _bound(df, ts_col, days, as_of))


def specs_frame(spark, rows: Sequence[tuple]) -> DataFrame:
    """Helper for a small saved-spec table ``spec_id, tenant, request, enabled, next_run_at``."""
    schema = "spec_id int, tenant bigint, request string, enabled boolean, next_run_at timestamp_ntz"
    return spark.createDataFrame(list(rows), schema)


def all_tenant_lines(
    df: DataFrame, tenant_col: str, order: Sequence, fmt: str = "csv", columns: Sequence[str] | None = None,
) -> DataFrame:
    """L2 for raw reports: every tenant's CSV (or JSON array) in one sorted frame.

    One global sort on ``(tenant, line kind, order)``: a tenant holding a third of all rows
    spans many sort partitions, and a write with ``partitionBy(tenant)`` needs no further
    sort, so each tenant folder's part files, in partition-number order, hold that tenant's report.
    Header rows come from the distinct tenants (an aggregate, one row per tenant)."""
    cols = list(columns or [c for c in df.columns if c != tenant_col])
    names = [f"__o{i}" for i in range(len(order))]
    keyed = df.select(qcol(tenant_col), F.lit(1).alias("__k"), *[c.alias(n) for c, n in zip(order, names)],
                      *[qcol(c).alias(f"__c_{i}") for i, c in enumerate(cols)])
    tenants = df.select(tenant_col).distinct()
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in keyed.schema.fields[2:]]
    data = keyed.select(qcol(tenant_col), "__k", *names, *[F.col(f"__c_{i}").alias(c) for i, c in enumerate(cols)])
    if fmt == "csv":
        framed = tenants.select(tenant_col, F.lit(0).alias("__k"), *nulls).toDF(*data.columns).unionByName(data)
        value = F.when(F.col("__k") == 0, F.lit(csv_header(cols))).otherwise(csv_line(data, cols))
    elif fmt == "json":
        key = F.struct(*names)
        firsts = data.groupBy(qcol(tenant_col).alias("__tenant")).agg(F.min(key).alias("__first"))
        joined = data.join(firsts, qcol(tenant_col).eqNullSafe(F.col("__tenant"))).drop("__tenant")
        opens = key.eqNullSafe(F.col("__first"))
        # Never by declaration: where a tenant's first key ties, rows are numbered and row 1 opens the array.
        if joined.where(opens).groupBy(tenant_col).count().where("count > 1").limit(1).count():
            from ..operators.ordering import number_rows_within

            numbered = number_rows_within(data, [tenant_col], [F.col(n) for n in names], "__rn")
            opened = numbered.withColumn("__k", F.when(F.col("__rn") == 1, F.lit(0)).otherwise(F.lit(1))).drop("__rn")
        else:
            opened = joined.withColumn("__k", F.when(opens, F.lit(0)).otherwise(F.lit(1))).drop("__first")
        framed = opened.unionByName(tenants.select(tenant_col, F.lit(2).alias("__k"), *nulls).toDF(*data.columns))
        line = json_line(data, cols)
        value = (F.when(F.col("__k") == 2, F.lit("]"))  # tenants come from the rows, so each has a first element
                 .when(F.col("__k") == 0, F.concat(F.lit("["), line))
                 .otherwise(F.concat(F.lit(","), line)))
    elif fmt == "pdf":
        from ..operators.ordering import number_rows_within

        framed = number_rows_within(data, [tenant_col], [F.col(n) for n in names], "__rn")
        value = F.concat(F.col("__rn").cast("string"), F.lit(". "), json_line(data, cols))
    else:
        raise ValueError(f"unsupported format for all-tenant lines: {fmt}")
    return framed.sort(tenant_col, "__k", *names).select(tenant_col, value.alias("value"))


def write_all_tenants(lines: DataFrame, tenant_col: str, path: str) -> None:
    """L2 sink: ``<path>/<tenant_col>=<tenant>/part-*`` holds each tenant's report."""
    write_text_folders(lines, tenant_col, path)


def apply_retention(
    df: DataFrame, ts_col: str, days: int, as_of: _dt.datetime, target: str,
    partition_by: Sequence[str] = (), fmt: str = "parquet",
) -> dict:
    """L1 rewrite: write the rows still inside the retention window to ``target`` (a new
    location -- a table is never overwritten while it is being read) and report what was
    kept and dropped, counted in the same job by an ``Observation``."""
    from pyspark.sql import Observation

    bound = _bound(df, ts_col, days, as_of)
    obs = Observation("retention")
    measured = df.observe(
        obs,
        F.count(F.lit(1)).alias("rows_in"),
        F.coalesce(F.sum(F.when(F.col(ts_col) > bound, 1)), F.lit(0)).alias("kept"),
    )
    writer = measured.filter(F.col(ts_col) > bound).write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(target)
    got = obs.get
    return {"rows_in": int(got["rows_in"]), "kept": int(got["kept"]), "dropped": int(got["rows_in"] - got["kept"])}


def all_tenant_workbook_files(df: DataFrame, tenant_col: str, order: Sequence, path: str, part_rows: int | None = None) -> DataFrame:
    """L2 + K4: every tenant's workbook(s) in one pass, ``<path>/<tenant_col>=<t>/report-part<k>.xlsx``.

    Returns the lazy manifest, a row per file (``file, n_rows, length, sha256``); running it writes the files."""
    from ..sinks.workbook import EXCEL_MAX_DATA_ROWS, write_workbooks

    return write_workbooks(df, path, [tenant_col], order, part_rows=part_rows or EXCEL_MAX_DATA_ROWS, folder_per_group=True)


def all_tenant_workbooks(df: DataFrame, tenant_col: str, order: Sequence, path: str, part_rows: int | None = None) -> list[dict]:
    """``all_tenant_workbook_files``, written, with its manifest as a list (one entry a file: for few tenants)."""
    return [r.asDict() for r in all_tenant_workbook_files(df, tenant_col, order, path, part_rows).toLocalIterator()]
