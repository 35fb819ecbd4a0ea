"""Grouped reduce: count, sum, min, max, avg over 0..n group keys.

The direct path is one ``groupBy().agg()``: Spark plans it as a partial HashAggregate per
input split (map-side combine), a hash exchange on the keys, and a final HashAggregate, so a
key holding a third of all rows still ships only one partial row per map task.

The *partials* path (A9-A11) makes the map side explicit: partial rows per id-range chunk,
stored or streamed, then merged.  Both paths give the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import (
    AVG_COUNT_PREFIX,
    AVG_SUM_PREFIX,
    INPUT_COUNT,
    MSG_GROUP_CAP,
    MSG_NON_NUMERIC,
    Metric,
    ReduceSpec,
    SpecError,
)
from ..sources.registry import require_columns

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
NUMERIC = INTEGRAL + FRACTIONAL + (T.DecimalType,)


class GroupCapExceeded(RuntimeError):
    pass


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def _json_key(c: Column, dtype: T.DataType) -> Column:
    """``c`` such that values are equal exactly when their JSON text is: NaN and infinities are
    null, times are whole milliseconds, and so on inside structs and arrays."""
    if isinstance(dtype, FRACTIONAL):
        return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("millisecond", c).cast(dtype)
    if isinstance(dtype, T.StructType):
        parts = [_json_key(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _json_key(x, dtype.elementType))
    return c


def group_key(df: DataFrame, name: str) -> Column:
    """Keys group as their JSON text would (see ``_json_key``)."""
    return _json_key(F.col(name), _dtype(df, name)).alias(name)


def _finite_guard(total: Column, what: str) -> Column:
    """A non-finite running sum is an error, not a value."""
    bad = F.isnan(total) | (F.abs(total) == F.lit(float("inf")))
    return F.when(bad, F.raise_error(F.lit(MSG_NON_NUMERIC.format(what)))).otherwise(total)


def _minmax_input(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(_dtype(df, name), FRACTIONAL):
        # Spark orders NaN above every number; the reference never lets NaN win.
        c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def _zero_for(dtype: T.DataType) -> Column:
    if isinstance(dtype, T.DecimalType):
        return F.lit(0).cast(T.DecimalType(min(38, dtype.precision + 10), dtype.scale))
    if isinstance(dtype, FRACTIONAL):
        return F.lit(0.0)
    return F.lit(0).cast("long")


def _sum(df: DataFrame, name: str, what: str) -> Column:
    """A2: nulls add nothing, an empty or all-null group sums to 0; non-numeric -> 0."""
    dtype = _dtype(df, name)
    if not isinstance(dtype, NUMERIC):
        return _zero_for(T.LongType())
    total = F.coalesce(F.sum(F.col(name)), _zero_for(dtype))
    if isinstance(dtype, FRACTIONAL):
        total = _finite_guard(total, what)
    return total


def _require_numeric(df: DataFrame, name: str, alias: str) -> None:
    if not isinstance(_dtype(df, name), NUMERIC):
        raise SpecError(f"Metric {alias}: avg needs a numeric field, {name} is {_dtype(df, name).simpleString()}")


def _avg_sum(df: DataFrame, name: str, what: str) -> Column:
    """The sum below an average.  Integers add up as DECIMAL(38,0): the sum is only a step and must
    not overflow where the average itself fits."""
    if isinstance(_dtype(df, name), INTEGRAL):
        return F.coalesce(F.sum(F.col(name).cast("decimal(19,0)")).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return _sum(df, name, what)


def _avg(total: Column, count: Column) -> Column:
    """A5: sum / count-of-non-null as double, null when nothing was counted."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def metric_column(df: DataFrame, m: Metric) -> Column:
    """Final-form aggregate for one metric (A1-A5)."""
    if m.op == "count":
        return F.count(F.lit(1)).alias(m.alias)
    if m.op == "sum":
        return _sum(df, m.field, m.alias).alias(m.alias)
    if m.op == "min":
        return F.min(_minmax_input(df, m.field)).alias(m.alias)
    if m.op == "max":
        return F.max(_minmax_input(df, m.field)).alias(m.alias)
    _require_numeric(df, m.field, m.alias)
    return _avg(_avg_sum(df, m.field, m.alias + ".sum"), F.count(F.col(m.field))).alias(m.alias)


def _check(df: DataFrame, spec: ReduceSpec) -> None:
    require_columns(df, spec.keys, "groupBy field")
    require_columns(df, [m.field for m in spec.metrics if m.op != "count"], "metric field")


def output_columns(spec: ReduceSpec) -> list[str]:
    """Group keys in spec order, then metric aliases; bookkeeping hidden."""
    return spec.keys + [m.alias for m in spec.metrics]


MIN_ID, MAX_ID = "__min_id", "__max_id"


def reduce_frame(df: DataFrame, spec: ReduceSpec, extra_keys: Sequence[str] = (), id_col: str | None = None) -> DataFrame:
    """Direct reduce.  Keeps the hidden ``__input_count`` column (A13) for run statistics;
    ``report_view`` drops it.  ``extra_keys`` are leading keys (tenant for L2, spec id for L3).
    With ``id_col``, hidden per-group id bounds ride along, so the id ranges of the run
    (R1, M1) come from the same pass instead of a second scan."""
    _check(df, spec)
    keys = list(dict.fromkeys([*extra_keys, *spec.keys]))
    aggs = [metric_column(df, m) for m in spec.metrics] + [F.count(F.lit(1)).alias(INPUT_COUNT)]
    if id_col is not None:
        aggs += [F.min(id_col).alias(MIN_ID), F.max(id_col).alias(MAX_ID)]
    if keys:
        return df.groupBy(*[group_key(df, k) for k in keys]).agg(*aggs)
    # A global reduce over no rows gives no row (Spark alone would give one).
    return df.agg(*aggs).filter(F.col(INPUT_COUNT) > 0)


def report_view(reduced: DataFrame, spec: ReduceSpec, extra_keys: Sequence[str] = ()) -> DataFrame:
    cols = list(dict.fromkeys([*extra_keys, *output_columns(spec)]))
    return reduced.select(*cols)


def reduce(df: DataFrame, spec: ReduceSpec) -> DataFrame:
    return report_view(reduce_frame(df, spec), spec)


# ---------------------------------------------------------------- partials


def partial_columns(df: DataFrame, m: Metric) -> list[Column]:
    if m.op == "avg":
        _require_numeric(df, m.field, m.alias)
        return [
            _avg_sum(df, m.field, m.alias + ".sum").alias(AVG_SUM_PREFIX + m.alias),
            F.count(F.col(m.field)).alias(AVG_COUNT_PREFIX + m.alias),
        ]
    return [metric_column(df, m)]


def partials(df: DataFrame, spec: ReduceSpec, chunk: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Partial aggregate rows, one per (chunk, group) when a chunk column is given, and per
    ``extra`` columns (aliased)."""
    _check(df, spec)
    keys = [*extra, *[group_key(df, k) for k in spec.keys]]
    if chunk is not None:
        keys = [chunk.alias("chunk")] + keys
    aggs = [c for m in spec.metrics for c in partial_columns(df, m)] + [F.count(F.lit(1)).alias(INPUT_COUNT)]
    if keys:
        return df.groupBy(*keys).agg(*aggs)
    return df.agg(*aggs).filter(F.col(INPUT_COUNT) > 0)


def _flatten_group(parts: DataFrame, spec: ReduceSpec) -> DataFrame:
    """Accept partial rows that carry the keys in an ``_id`` struct (the reference's shape)."""
    if "_id" in parts.columns and isinstance(parts.schema["_id"].dataType, T.StructType):
        inner = {f.name for f in parts.schema["_id"].dataType.fields}
        keyed = [(F.col("_id").getField(k) if k in inner else F.lit(None)).alias(k) for k in spec.keys]
        rest = [c for c in parts.columns if c != "_id"]
        return parts.select(*keyed, *rest)
    return parts


def merge_partials(parts: DataFrame, spec: ReduceSpec) -> DataFrame:
    """A10: merge partial rows into the final reduce (keeps ``__input_count``)."""
    parts = _flatten_group(parts, spec)
    aggs = []
    for m in spec.metrics:
        if m.op in ("count", "sum"):
            dtype = parts.schema[m.alias].dataType
            total = F.coalesce(F.sum(F.col(m.alias)), _zero_for(dtype))
            if isinstance(dtype, FRACTIONAL):
                total = _finite_guard(total, m.alias)
            aggs.append(total.alias(m.alias))
        elif m.op == "min":
            aggs.append(F.min(m.alias).alias(m.alias))
        elif m.op == "max":
            aggs.append(F.max(m.alias).alias(m.alias))
        else:
            s, n = F.col(AVG_SUM_PREFIX + m.alias), F.col(AVG_COUNT_PREFIX + m.alias)
            aggs.append(_avg(F.sum(s), F.sum(n)).alias(m.alias))
    aggs.append(F.coalesce(F.sum(INPUT_COUNT), F.lit(0).cast("long")).alias(INPUT_COUNT))
    if spec.keys:
        return parts.groupBy(*spec.keys).agg(*aggs)
    return parts.agg(*aggs).filter(F.col(INPUT_COUNT) > 0)


def union_partials(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union of partial frames (by column name)."""
    if not frames:
        raise ValueError("no partial frames")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_incremental(stored: DataFrame | None, new_partials: DataFrame, spec: ReduceSpec) -> DataFrame:
    """Keep a stored partials table current -- merge it with newly arrived partials.

    The result is itself a partials table; store it with ``save_partials`` between rounds so
    each round starts from a written table instead of an ever longer lineage."""
    merged_input = new_partials if stored is None else union_partials([stored, new_partials])
    parts = _flatten_group(merged_input, spec)
    aggs = []
    for m in spec.metrics:
        if m.op in ("count", "sum"):
            aggs.append(F.sum(m.alias).alias(m.alias))
        elif m.op == "min":
            aggs.append(F.min(m.alias).alias(m.alias))
        elif m.op == "max":
            aggs.append(F.max(m.alias).alias(m.alias))
        else:
            kept = parts.schema[AVG_SUM_PREFIX + m.alias].dataType  # a stored table keeps its type from round to round
            total = F.sum(AVG_SUM_PREFIX + m.alias)
            aggs.append((total.cast(kept) if isinstance(kept, T.DecimalType) else total).alias(AVG_SUM_PREFIX + m.alias))
            aggs.append(F.sum(AVG_COUNT_PREFIX + m.alias).alias(AVG_COUNT_PREFIX + m.alias))
    aggs.append(F.sum(INPUT_COUNT).alias(INPUT_COUNT))
    if spec.keys:
        return parts.groupBy(*spec.keys).agg(*aggs)
    return parts.agg(*aggs).filter(F.col(INPUT_COUNT) > 0)


def save_partials(parts: DataFrame, path: str) -> DataFrame:
    """Write a partials table (a shared folder on a cluster) and read it back: the stored
    state of A11, and a cut in the lineage."""
    parts.write.mode("overwrite").parquet(path)
    return parts.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- order and cap


def group_order_key(spec: ReduceSpec, extra_keys: Sequence[str] = (), schema: T.StructType | None = None) -> Column:
    """O3: groups sort by their JSON text under a Unicode collation, as ``localeCompare``
    orders it (``a A b B``, ``10`` before ``9``, ``10.5`` before ``10``, a null key after
    strings).  The text is rendered exactly as the group's JSON would be (JavaScript number
    text, ISO dates) when the key types are known; otherwise by ``to_json``."""
    keys = list(dict.fromkeys([*extra_keys, *spec.keys]))
    if not keys:
        return F.lit("")
    if schema is not None:
        from ..functions.render import json_object

        text = json_object([(k, F.col(k), schema[k].dataType) for k in keys])
    else:
        text = F.to_json(
            F.struct(*[F.col(k) for k in keys]),
            {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
             "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"},
        )
    return F.collate(text, "UNICODE")


def group_order(spec: ReduceSpec, extra_keys: Sequence[str] = (), schema: T.StructType | None = None) -> list[Column]:
    """O3 as a total order: distinct keys that the collation equates follow their plain text."""
    key = group_order_key(spec, extra_keys, schema)
    return [key, F.collate(key, "UTF8_BINARY")]


def ordered(reduced: DataFrame, spec: ReduceSpec, extra_keys: Sequence[str] = ()) -> DataFrame:
    return reduced.orderBy(*group_order(spec, extra_keys, reduced.schema))


def enforce_group_cap(reduced: DataFrame, max_groups: int | None = None) -> DataFrame:
    """Without a limit the frame as it is; with one, fail when the result has more than ``max_groups`` groups.

    The reduced frame is cached so the check and the later write share one computation;
    ``limit(max+1)`` stops the count early on a runaway result."""
    if max_groups is None:
        return reduced
    reduced = reduced.persist()
    n = reduced.limit(max_groups + 1).count()
    if n > max_groups:
        reduced.unpersist()
        raise GroupCapExceeded(MSG_GROUP_CAP.format(max_groups))
    return reduced


def chunk_profile(parts: DataFrame) -> DataFrame:
    """Per chunk, the number of partial rows (groups) and input rows, by index."""
    return (
        parts.groupBy("chunk")
        .agg(F.count(F.lit(1)).alias("groups"), F.sum(INPUT_COUNT).alias("rows_in"))
        .orderBy("chunk")
    )



def partitioned_reduce(df: DataFrame, spec: ReduceSpec, id_col: str, chunks: int, id_kind: str = "bigint"):
    """The explicit, chunked form of a reduce (A9, A10, M2, R1): id bounds, equal-width id
    ranges, partial rows per (range, group), their merge and the per-range profile.

    Returns ``(reduced, partial_rows, profile, ranges)``; ``reduced`` equals ``reduce_frame``.
    The bounds are one aggregate; every row finds its range with a Column expression, so the
    partials are one ``groupBy`` -- no per-range job and no driver loop over rows."""
    from .ranges import chunk_of, id_ranges, read_bounds

    lo, hi = read_bounds(df, id_col)
    ranges = id_ranges(lo, hi, chunks, id_kind)
    parts = partials(df, spec, chunk=chunk_of(ranges, id_col))
    return merge_partials(parts.drop("chunk"), spec), parts, chunk_profile(parts), ranges
