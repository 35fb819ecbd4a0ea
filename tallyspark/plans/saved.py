"""Saved specs (L3): all due reports of a tick from one scan of the source.

Specs are enabled rows whose ``next_run_at`` is due, each with its own tenant, filters, reduce and formats.
Specs that share a reduce and filtered columns are of one *shape*.  A source row meets the shapes of its own tenant
(the tenants stand in a predicate that reaches the scan) and is aggregated once, by shape,
tenant, filter values and group keys, over the union of all shapes' keys and metrics: a key that a shape does not use is null in
its cells.  The specs join those partial cells, never source rows; a hot tenant is combined map-side.
Raw reports (specs without a reduce) share a second pass in the same way, without the aggregate.

One bad definition is that spec's own failure: ``run_status`` has a row per due spec.  Specs are read
``batch`` at a time, which bounds the driver; each batch is a pass over the source.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import json_object, qcol
from ..operators.filters import _same_family, equality_filter, sanitize_filters
from ..operators.reduce import _check, _require_numeric, group_key, group_order, merge_partials, output_columns, partials
from ..spec import Metric, ReduceSpec, ReportSpec, SpecError

BATCH = 10_000
FORMATS = ("csv", "json", "pdf", "xlsx")
LISTED_TENANTS = 1_000  # of a shape; so many are named in the scan's predicate, for more the join to the specs alone decides


def due_specs(specs: DataFrame, now: _dt.datetime) -> DataFrame:
    """Enabled specs whose next run is due."""
    return specs.filter(F.col("enabled") & (F.col("next_run_at") <= F.lit(now)))


@dataclass(frozen=True)
class Shape:
    """What specs share to be answered together: reduce (None: raw rows), filtered columns, and
    filters on nested values (part of the shape, as they are)."""

    reduce: ReduceSpec | None
    columns: tuple[str, ...]
    nested: str = "{}"


@dataclass
class SpecBatch:
    """Due specs read on the driver: valid ones by shape, and why the others are not."""

    shapes: list[Shape] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)  # (number, spec_id, tenant, shape, formats, {column: value})
    failed: list[tuple] = field(default_factory=list)  # (spec_id, message)
    matched: list = field(default_factory=list)  # ids of the valid specs, those that no row can match included


def _typed(value, dtype: T.DataType):
    """``value`` as the column's own Python type; raises where no value of the column equals it."""
    if value is None:
        return None
    if not _same_family(dtype, value):
        raise ValueError(value)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return float(value)
    if isinstance(dtype, T.DecimalType):
        return decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-dtype.scale), context=decimal.Context(prec=38, traps=[decimal.Inexact]))
    if isinstance(dtype, T.IntegralType):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(dtype), 64)
        if int(value) != value or not -(1 << (bits - 1)) <= value < 1 << (bits - 1):
            raise ValueError(value)
        return int(value)
    return value


def _read_spec(source: DataFrame, row, tenant_col: str, formats: tuple[str, ...] | None):
    """One saved spec: its shape, formats and filter values; raises SpecError where it is not valid."""
    types = {f.name: f.dataType for f in source.schema.fields}
    spec = ReportSpec.parse(json.loads(row.request), row.tenant)
    if tenant_col in spec.filters:
        raise SpecError(f"filter on scope column {tenant_col!r} is not allowed")
    clean = sanitize_filters(spec.filters)
    for name in clean:
        if name not in types:
            raise SpecError(f"Unknown filter column: {name}")
    wanted = tuple(spec.include_formats or (spec.format,))
    for fmt in wanted:
        if formats is not None and fmt not in formats:
            raise SpecError(f"Unsupported format for a saved spec: {fmt}")
    if spec.reduce is not None:
        _check(source, spec.reduce)
        for m in spec.reduce.metrics:
            if m.op == "avg":
                _require_numeric(source, m.field, m.alias)
    flat = {c: v for c, v in clean.items() if not isinstance(v, (dict, list)) and isinstance(types[c], T.AtomicType)}
    nested = {c: v for c, v in clean.items() if c not in flat}
    equality_filter(source, nested)
    shape = Shape(spec.reduce, tuple(sorted(flat)), json.dumps(nested, sort_keys=True))
    try:
        return shape, wanted, {c: _typed(v, types[c]) for c, v in flat.items()}
    except (ValueError, ArithmeticError):
        return shape, wanted, None  # no row can match


def read_specs(source: DataFrame, due: DataFrame, tenant_col: str, formats: tuple[str, ...] | None = None, batch: int = BATCH) -> Iterator[SpecBatch]:
    """Due specs, ``batch`` at a time; a spec that is not valid is recorded and passed over."""
    out, numbers = SpecBatch(), {}
    for row in due.select("spec_id", "tenant", "request").toLocalIterator():
        try:
            shape, wanted, values = _read_spec(source, row, tenant_col, formats)
        except (ValueError, TypeError, KeyError, AttributeError) as bad:  # a definition that is no spec; SpecError is a ValueError
            out.failed.append((row.spec_id, f"{type(bad).__name__}: {bad}"))
        else:
            out.matched.append(row.spec_id)
            if values is not None:
                if shape not in numbers:
                    numbers[shape] = len(out.shapes)
                    out.shapes.append(shape)
                out.rows.append((len(out.rows), row.spec_id, row.tenant, numbers[shape], wanted, values))
        if len(out.matched) + len(out.failed) >= batch:
            yield out
            out, numbers = SpecBatch(), {}
    yield out


def _uses(shapes: list[int]) -> Column:
    return F.col("__shape").isin(shapes)


def _filter_key(batch: SpecBatch, columns: dict[str, Column], types: dict[str, T.DataType]) -> Column:
    """The filtered columns' values as one text, per shape; equal exactly where the values are."""
    parts = [F.lit("")]
    for name in sorted({c for s in batch.shapes for c in s.columns}):
        c = columns[name]
        if isinstance(types[name], (T.FloatType, T.DoubleType)):
            c = F.when(c == 0, F.lit(0.0)).otherwise(c)  # -0 equals 0
        text = c.cast("string")
        piece = F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.char_length(text).cast("string"), F.lit(":"), text))
        parts.append(F.when(_uses([i for i, s in enumerate(batch.shapes) if name in s.columns]), piece).otherwise(F.lit("")))
    return F.concat(*parts)


def _wanted(source: DataFrame, batch: SpecBatch, shapes: set[int], tenant_col: str, id_type: T.DataType) -> DataFrame:
    """``(spec_id, __number, __shape, __formats, __tenant, __fkey)`` of the batch's specs of these shapes."""
    types = {f.name: f.dataType for f in source.schema.fields}
    names = sorted({c for s in batch.shapes for c in s.columns})
    schema = T.StructType([T.StructField("spec_id", id_type), T.StructField("__number", T.LongType()), T.StructField("__shape", T.IntegerType()), T.StructField("__formats", T.ArrayType(T.StringType())),
                           T.StructField("__tenant", types[tenant_col]), *[T.StructField(f"__v{i}", types[c]) for i, c in enumerate(names)]])
    rows = [(spec_id, number, shape, list(formats), tenant, *[values.get(c) for c in names]) for number, spec_id, tenant, shape, formats, values in batch.rows if shape in shapes]
    frame = source.sparkSession.createDataFrame(rows, schema)
    key = _filter_key(batch, {c: F.col(f"__v{i}") for i, c in enumerate(names)}, types)
    return frame.select("spec_id", "__number", "__shape", "__formats", "__tenant", key.alias("__fkey"))


def _per_shape(source: DataFrame, batch: SpecBatch, shapes: set[int], tenant_col: str) -> DataFrame:
    """Source rows, once per shape that their own tenant has, with ``__shape`` and ``__fkey``."""
    tenants: dict[int, set] = {i: set() for i in shapes}
    for _, _, tenant, shape, _, _ in batch.rows:
        if shape in shapes:
            tenants[shape].add(tenant)

    def of(names: set) -> Column:
        if len(names) > LISTED_TENANTS:
            return F.lit(True)
        listed = qcol(tenant_col).isin(*[t for t in names if t is not None])
        return F.coalesce(listed, F.lit(False)) | qcol(tenant_col).isNull() if None in names else listed

    every = set().union(*tenants.values())
    rows = source.where(of(every))
    meets = []
    for i in sorted(shapes):
        nested = json.loads(batch.shapes[i].nested)
        fits = of(tenants[i]) if tenants[i] != every else F.lit(True)
        meets.append(F.when(fits & equality_filter(source, nested) if nested else fits, F.lit(i)))
    rows = rows.withColumn("__shape", F.explode(F.array_compact(F.array(*meets))))
    types = {f.name: f.dataType for f in source.schema.fields}
    return rows.withColumn("__fkey", _filter_key(batch, {c: qcol(c) for c in types}, types))


class _Cells:
    """The reduce shapes of a batch over the union of their keys and metrics."""

    def __init__(self, source: DataFrame, batch: SpecBatch):
        self.source, self.batch = source, batch
        self.shapes = {i for i, s in enumerate(batch.shapes) if s.reduce is not None}
        keys = sorted({k for i in self.shapes for k in batch.shapes[i].reduce.keys})
        self.keys = {k: f"__k{i}" for i, k in enumerate(keys)}
        fields = sorted({(m.op, m.field or "") for i in self.shapes for m in batch.shapes[i].reduce.metrics})
        self.metrics = {(op, name): Metric(op, f"__m{i}", name or None) for i, (op, name) in enumerate(fields)}
        self.union = tuple(self.metrics.values())

    def merged(self, tenant_col: str, id_type: T.DataType) -> DataFrame:
        """``spec_id, __number, __shape, __formats``, all keys and all metrics: one row per group of each spec."""
        rows = _per_shape(self.source, self.batch, self.shapes, tenant_col)
        cells = []
        for k, name in self.keys.items():
            users = [i for i in self.shapes if k in self.batch.shapes[i].reduce.keys]
            cells.append(F.when(_uses(users), group_key(self.source, k)).alias(name))
        parts = partials(rows, ReduceSpec(metrics=self.union), extra=[F.col("__shape").alias("__s"), qcol(tenant_col).alias("__t"), F.col("__fkey").alias("__f"), *cells])
        wanted = _wanted(self.source, self.batch, self.shapes, tenant_col, id_type)
        match = (F.col("__s") == F.col("__shape")) & F.col("__t").eqNullSafe(F.col("__tenant")) & (F.col("__f") == F.col("__fkey"))
        joined = parts.join(wanted, match).drop("__s", "__t", "__f", "__tenant", "__fkey")
        return merge_partials(joined, ReduceSpec(self.union, ("spec_id", "__number", "__shape", "__formats", *self.keys.values())))

    def columns(self, shape: int) -> list[tuple[str, str]]:
        """A shape's output columns, and what they are called in the union."""
        spec = self.batch.shapes[shape].reduce
        found = {k: self.keys[k] for k in spec.keys} | {m.alias: self.metrics[m.op, m.field or ""].alias for m in spec.metrics}
        return [(c, found[c]) for c in output_columns(spec)]


def _raw_rows(source: DataFrame, batch: SpecBatch, tenant_col: str, id_type: T.DataType) -> DataFrame | None:
    """``spec_id, __number, __formats`` and the source's columns: the rows of every raw spec."""
    shapes = {i for i, s in enumerate(batch.shapes) if s.reduce is None}
    if not shapes:
        return None
    rows = _per_shape(source, batch, shapes, tenant_col).withColumnRenamed("__shape", "__s").withColumnRenamed("__fkey", "__f")
    wanted = F.broadcast(_wanted(source, batch, shapes, tenant_col, id_type))  # at most a batch of specs
    match = (F.col("__s") == F.col("__shape")) & qcol(tenant_col).eqNullSafe(F.col("__tenant")) & (F.col("__f") == F.col("__fkey"))
    return rows.join(wanted, match).select("spec_id", "__number", "__formats", *[qcol(c) for c in source.columns])


def run_specs(source: DataFrame, specs: DataFrame, now: _dt.datetime, *, tenant_col: str, batch: int = BATCH) -> DataFrame:
    """Every due spec ``(spec_id, tenant, request, enabled, next_run_at)`` with its own filters, reduce and
    formats (``request`` is the JSON request): ``(spec_id, format, row)``, each output row as JSON text.

    A spec that is not valid has no rows here; ``run_status`` says why."""
    id_type = specs.schema["spec_id"].dataType
    schema = T.StructType([T.StructField("spec_id", id_type), T.StructField("format", T.StringType()), T.StructField("row", T.StringType())])
    out = source.sparkSession.createDataFrame([], schema)
    for part in read_specs(source, due_specs(specs, now), tenant_col, batch=batch):
        cells = _Cells(source, part)
        if cells.shapes:
            merged = cells.merged(tenant_col, id_type)
            types = {f.name: f.dataType for f in merged.schema.fields}
            text = F.lit(None).cast("string")
            for i in sorted(cells.shapes):
                fields = [(c, F.col(n), types[n]) for c, n in cells.columns(i)]
                text = F.when(F.col("__shape") == i, json_object(fields)).otherwise(text)
            out = out.unionByName(merged.select("spec_id", F.explode("__formats").alias("format"), text.alias("row")))
        raw = _raw_rows(source, part, tenant_col, id_type)
        if raw is not None:
            text = json_object([(f.name, qcol(f.name), f.dataType) for f in source.schema.fields])
            out = out.unionByName(raw.select("spec_id", F.explode("__formats").alias("format"), text.alias("row")))
    return out


def run_status(source: DataFrame, specs: DataFrame, now: _dt.datetime, *, tenant_col: str, next_run: Column | None = None, formats: tuple[str, ...] | None = None,
               batch: int = BATCH) -> DataFrame:
    """What a tick leaves behind, a row per spec: ``spec_id, status, error, enabled, last_run_at, next_run_at``.

    ``status`` is ``ran``, ``failed`` (with the reason; the spec is disabled, as one whose definition cannot be read would fail each tick)
    or ``waiting``.  ``next_run`` gives the next time of a spec that ran, from the specs' own columns (say ``next_run_at + interval 1 day``);
    without it the time stays null, so that the next tick cannot run the spec a second time."""
    id_type = specs.schema["spec_id"].dataType
    kind = specs.schema["next_run_at"].dataType
    rows = []
    for part in read_specs(source, due_specs(specs, now), tenant_col, formats, batch):
        rows += [(i, "ran", None) for i in part.matched] + [(i, "failed", why) for i, why in part.failed]
    done = source.sparkSession.createDataFrame(rows, T.StructType([T.StructField("__id", id_type), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())]))
    due = F.col("enabled") & (F.col("next_run_at") <= F.lit(now))
    later = (next_run if next_run is not None else F.lit(None)).cast(kind)
    last = F.col("last_run_at") if "last_run_at" in specs.columns else F.lit(None)
    ran = F.col("status") == "ran"
    joined = specs.join(done.dropDuplicates(["__id"]), F.col("spec_id").eqNullSafe(F.col("__id")) & due, "left").withColumn("status", F.coalesce("status", F.lit("waiting")))
    return joined.select("spec_id", "status", "error", (F.col("enabled") & (F.col("status") != "failed")).alias("enabled"),
                         F.when(ran, F.lit(now)).otherwise(last).cast(kind).alias("last_run_at"), F.when(ran, later).otherwise(F.col("next_run_at")).alias("next_run_at"))


def write_specs(source: DataFrame, specs: DataFrame, now: _dt.datetime, path: str, *, tenant_col: str, id_col: str, batch: int = BATCH) -> list[str]:
    """One report per due spec and format, each in its own order: ``<path>/report.<format>/spec_id=<id>/``.

    csv, json and pdf (the numbered listing) are ``part-*`` text files, xlsx workbook parts; a zip is its
    entries.  ``path`` must be new.  Reduced rows of all shapes are staged once, so the source is scanned once
    for them (and once for the raw specs).  A spec whose result is empty has no folder; one that is not valid or asks for another format
    fails alone (``run_status`` with ``formats=FORMATS``)."""
    import uuid

    from ..session import checkpoint_dir, remove_path

    spark, base, written = source.sparkSession, path.rstrip("/"), set()
    id_type = specs.schema["spec_id"].dataType
    for part in read_specs(source, due_specs(specs, now), tenant_col, FORMATS, batch):
        cells, staged = _Cells(source, part), f"{checkpoint_dir(spark).rstrip('/')}/specs-{uuid.uuid4().hex}"
        try:
            frames = []
            if cells.shapes:
                merged = cells.merged(tenant_col, id_type)
                merged.write.parquet(f"{staged}/cells")
                cut = spark.read.schema(merged.schema).parquet(f"{staged}/cells")
                for i in sorted(cells.shapes):
                    frame = cut.where(F.col("__shape") == i).select("spec_id", "__formats", *[F.col(n).alias(c) for c, n in cells.columns(i)])
                    frames.append((frame, group_order(part.shapes[i].reduce, schema=frame.schema), {f for r in part.rows if r[3] == i for f in r[4]}))
            raw = _raw_rows(source, part, tenant_col, id_type)
            if raw is not None:
                formats = {f for r in part.rows if part.shapes[r[3]].reduce is None for f in r[4]}
                frames.append((raw.drop("__number"), [qcol(id_col)], formats))
            for frame, order, formats in frames:
                for fmt in sorted(formats):
                    of = frame.where(F.array_contains("__formats", fmt)).drop("__formats")
                    _write(of, order, fmt, f"{base}/report.{fmt}")
                    written.add(f"{base}/report.{fmt}")
        finally:
            remove_path(spark, staged)
    return sorted(written)


def _write(frame: DataFrame, order: list, fmt: str, path: str) -> None:
    from .batch import all_tenant_lines, all_tenant_workbook_files

    if fmt == "xlsx":
        all_tenant_workbook_files(frame, "spec_id", order, path).write.format("noop").mode("overwrite").save()
    else:
        all_tenant_lines(frame, "spec_id", order, fmt).write.mode("append").partitionBy("spec_id").text(path)
