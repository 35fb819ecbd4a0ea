"""Run statistics.

``stats_frame`` is the lazy, data-derived part: rows in, rows out and id-range count, as one
row computed by aggregates (no driver loop).  ``RunStats`` adds the wall-clock part measured
around a write (duration, throughput on rows out and on rows in -- D16 reports both).
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import id_number, range_size, range_total
from ..operators.reduce import MAX_ID, MIN_ID
from ..spec import DEFAULT_CHUNKS, INPUT_COUNT


def range_count(lo: Column, hi: Column, chunks: int, id_kind: str = "bigint") -> Column:
    """Number of R1 ranges over ids ``[lo, hi]``: ``ceil(span / ceil(span / chunks))``, 0 when there
    are no ids."""
    lo, hi = id_number(lo, id_kind), id_number(hi, id_kind)
    total = range_total(lo, hi, range_size(lo, hi, chunks))
    return F.when(lo.isNull() | (hi < lo), F.lit(0)).otherwise(total).cast("long")


def stats_frame(plan, chunks: int | None = None) -> DataFrame:
    """One row ``rows_in, rows_out, chunks`` for a ReportPlan."""
    if plan.mode == "raw":
        return plan.scoped.agg(F.count(F.lit(1)).alias("rows_in")).select(
            "rows_in", F.col("rows_in").alias("rows_out"), F.lit(1).cast("long").alias("chunks")
        )
    requested = chunks or (plan.spec.partition.chunks if plan.spec.partition else DEFAULT_CHUNKS)
    return plan.reduced.agg(
        F.coalesce(F.sum(INPUT_COUNT), F.lit(0)).cast("long").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_out"),
        F.min(MIN_ID).alias("lo"),
        F.max(MAX_ID).alias("hi"),
    ).select("rows_in", "rows_out", range_count(F.col("lo"), F.col("hi"), requested, plan.source.id_kind).alias("chunks"))


@dataclass
class RunStats:
    rows_in: int = 0
    rows_out: int = 0
    chunks: int = 1
    duration_ms: int = 0
    mode: str = "raw"
    zip_strategy: str | None = None
    throughput_rows_per_second: float = 0.0
    throughput_rows_in_per_second: float = 0.0
    extra: dict = field(default_factory=dict)

    def finish(self, started: float) -> "RunStats":
        self.duration_ms = max(1, int((time.time() - started) * 1000))
        secs = self.duration_ms / 1000
        self.throughput_rows_per_second = round(self.rows_out / secs, 2)
        self.throughput_rows_in_per_second = round(self.rows_in / secs, 2)
        return self

    def as_dict(self) -> dict:
        return asdict(self)
