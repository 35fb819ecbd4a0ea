"""Total order and row numbering (O1, O2, O4, K5 numbering).

``row_number()`` over an un-partitioned window moves every row into one task.  ``number_rows``
numbers a sorted frame without that: the sort's range exchange spreads rows over many
partitions, each partition counts its rows, a running sum over those per-partition counts
(one row per partition -- its size is bounded by the partition count, not the data) gives
each partition its offset, and every row adds its position inside its partition.

Both sides -- the per-partition counts and the rows -- must see the same partitions.  Left
to the planner they would not: column pruning gives the count side its own, narrower sort
exchange, and adaptive execution may coalesce the two shuffles differently.  So the sorted
rows, with their partition-position ids, are checkpointed once to the shared checkpoint
folder (``spark.checkpoint.dir``) and both sides read those files; that also cuts lineage, so
a lost executor cannot renumber anything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.render import qcol

_POS_BITS = 33  # monotonically_increasing_id: partition index above bit 33, position below
_POS_MASK = (1 << _POS_BITS) - 1


class RowCapExceeded(RuntimeError):
    pass


def sort_by_id(df: DataFrame, id_col: str) -> DataFrame:
    """O1: the raw report order (range exchange + sort)."""
    return df.sort(F.col(id_col))  # ascending puts nulls first


def id_bounds(df: DataFrame, id_col: str) -> DataFrame:
    """First and last id in one aggregate (reads only the id column)."""
    return df.agg(F.min(id_col).alias("min_id"), F.max(id_col).alias("max_id"))


def _materialize(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint into the session's shared checkpoint folder."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Add a 1-based ``name`` column numbering rows in ``order``, fully distributed."""
    mid = "__mid"
    sorted_df = _materialize(df.sort(*order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mid), _POS_BITS)
    pos = F.col(mid).bitwiseAND(F.lit(_POS_MASK))
    counts = (
        sorted_df.groupBy(part.alias("__part"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__offset",
            F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("__part", F.coalesce("__offset", F.lit(0)).alias("__offset"))
    )
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions, safe to broadcast.
    joined = sorted_df.join(F.broadcast(counts), part == F.col("__part"))
    out_cols = [qcol(c) for c in df.columns] + [(F.col("__offset") + pos + F.lit(1)).alias(name)]
    return joined.select(*out_cols)


def guard_row_cap(numbered: DataFrame, max_rows: int, rn: str = "rn", message: str | None = None) -> DataFrame:
    """The cap is an error at row ``max_rows + 1``, never a cut.  Raised inside the
    job, so no extra pass is needed and a failing write is aborted, not left half done."""
    from ..spec import MSG_ROW_CAP

    msg = message or MSG_ROW_CAP.format(max_rows, max_rows)
    return numbered.withColumn(rn, F.when(F.col(rn) > F.lit(max_rows), F.raise_error(F.lit(msg))).otherwise(F.col(rn)))


def number_rows_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str = "rn",
) -> DataFrame:
    """1-based row numbers restarting per group, without putting a group into one task.

    The sort on ``(groups, order)`` range-partitions rows, so a group holding a third of all
    rows spans many partitions.  A small table -- one row per (partition, group), at most
    partitions + groups rows -- gets each group's running offset per partition; rows add
    their position relative to their group's first row in the partition.  How that table is
    joined is left to Spark, which knows its bytes.  Both sides read the same checkpointed sort, so
    partition numbers agree."""
    mid = "__mid"
    sorted_df = _materialize(df.sort(*groups, *order).withColumn(mid, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(mid), _POS_BITS).alias("__part")
    firsts = (
        sorted_df.groupBy(part, *groups)
        .agg(F.min(mid).alias("__first"), F.count(F.lit(1)).alias("__n"))
        .withColumn(
            "__offset",
            F.coalesce(
                F.sum("__n").over(
                    Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("__n")
    )
    side = firsts
    keyed = sorted_df.withColumn("__part", F.shiftright(F.col(mid), _POS_BITS))
    cond = [keyed["__part"] == side["__part"]] + [keyed[g].eqNullSafe(side[g]) for g in groups]
    joined = keyed.join(side, cond)
    rn = (F.col("__offset") + keyed[mid] - F.col("__first") + F.lit(1)).alias(name)
    return joined.select(*[keyed[f"`{c}`"] for c in df.columns], rn)
