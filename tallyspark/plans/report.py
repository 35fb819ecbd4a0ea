"""From a ReportSpec to a lazy DataFrame (the query lifecycle of SURVEY section 3).

``plan_report`` resolves the source (S1), scopes it to the tenant and the equality filters
(S2, F1-F7), and either keeps whole rows in id order (raw: P1, O1) or reduces them (A1-A13)
in group order (O3).  Nothing runs until a sink acts on the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.render import qcol
from ..operators.filters import equality_filter
from ..operators.reduce import group_order, reduce_frame, report_view
from ..session import prepare
from ..sources.registry import Source, SourceRegistry, scan_tenant
from ..spec import ReportSpec


@dataclass
class ReportPlan:
    spec: ReportSpec
    source: Source
    scoped: DataFrame  # tenant + filter scope of the source, whole rows
    rows: DataFrame  # output rows (unordered)
    order: list[Column]  # report order over ``rows``
    mode: str  # "raw" | "reduce"
    reduced: DataFrame | None = None  # reduce result with the hidden __input_count

    def ordered(self) -> DataFrame:
        return self.rows.sort(*self.order)


def raw_order(df: DataFrame, source: Source) -> list[Column]:
    """O1: id order; with repeating ids the declared tiebreak columns, or else a hash of the
    whole row, break ties."""
    order = [F.col(source.id_col)]
    if not source.unique_id:
        if source.tiebreak:
            order.extend(qcol(c) for c in source.tiebreak)
        else:
            order.append(F.xxhash64(*[qcol(c) for c in df.columns]))
    return order


def scope(df: DataFrame, source: Source, spec: ReportSpec) -> DataFrame:
    """S2 + F1: tenant AND every filter, one predicate for the Parquet scan."""
    cond = equality_filter(df, spec.filters, forbid=(source.tenant_col,))
    return scan_tenant(df, source, spec.tenant, cond)


def plan_report(spark: SparkSession, spec: ReportSpec, registry: SourceRegistry) -> ReportPlan:
    prepare(spark)
    source, df = registry.load(spark, spec.source)
    scoped = scope(df, source, spec)
    if spec.reduce is None:
        return ReportPlan(spec, source, scoped, scoped, raw_order(scoped, source), "raw")
    reduced = reduce_frame(scoped, spec.reduce, id_col=source.id_col)
    rows = report_view(reduced, spec.reduce)
    return ReportPlan(spec, source, scoped, rows, group_order(spec.reduce, schema=rows.schema), "reduce", reduced)


def run(spark: SparkSession, spec: ReportSpec, registry: SourceRegistry) -> DataFrame:
    """The report's rows in report order (lazy)."""
    return plan_report(spark, spec, registry).ordered()
