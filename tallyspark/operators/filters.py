"""Equality filters.

A filter is a map ``{column: value}``; all entries are ANDed.  Equality is *typed*: a value
whose type family differs from the column's never matches (no implicit cast), as a
document store compares values.  Every predicate is a plain Column, so Catalyst pushes
what it can into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
import decimal as _decimal
import logging
import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import SpecError

log = logging.getLogger(__name__)

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def sanitize_filters(obj: Any) -> dict[str, Any]:
    """drop keys that start with ``$`` or contain ``.``, recursively through nested
    maps (not inside lists); anything that is not a map becomes ``{}``."""
    if not isinstance(obj, Mapping):
        return {}
    return {
        str(k): sanitize_filters(v) if isinstance(v, Mapping) else v
        for k, v in obj.items()
        if not (str(k).startswith("$") or "." in str(k))
    }


def _and(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def typed_equals(col: Column, dtype: T.DataType, value: Any) -> Column:
    """Column == value without coercion across type families."""
    if value is None:
        return col.isNull()  # F2
    if isinstance(value, Mapping):  # whole-document equality
        if not isinstance(dtype, T.StructType):
            if not value:
                log.warning("filter value {} (an operator map after sanitising) matches nothing")
            return F.lit(False)
        names = [f.name for f in dtype.fields]
        if list(value.keys()) != names:
            return F.lit(False)
        return col.isNotNull() & _and([typed_equals(col.getField(f.name), f.dataType, value[f.name]) for f in dtype.fields])
    if isinstance(value, (list, tuple)):  # exact array equality
        if not isinstance(dtype, T.ArrayType):
            return F.lit(False)
        parts = [F.size(col) == F.lit(len(value))]
        for i, item in enumerate(value):
            parts.append(typed_equals(F.element_at(col, i + 1), dtype.elementType, item))
        return col.isNotNull() & _and(parts)
    if isinstance(dtype, T.ArrayType):  # scalar against an array -> membership
        if value is None or not _same_family(dtype.elementType, value):
            return F.lit(False)
        return F.coalesce(F.array_contains(col, F.lit(value)), F.lit(False))
    if not _same_family(dtype, value):
        return F.lit(False)
    if isinstance(value, float) and math.isnan(value):
        return F.isnan(col)
    return col == F.lit(value)


def _same_family(dtype: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(dtype, T.BooleanType)
    if isinstance(value, (int, float, _decimal.Decimal)):
        return isinstance(dtype, NUMERIC)
    if isinstance(value, str):
        return isinstance(dtype, T.StringType)
    if isinstance(value, _dt.datetime):
        return isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    if isinstance(value, _dt.date):
        return isinstance(dtype, T.DateType)
    if isinstance(value, (bytes, bytearray)):
        return isinstance(dtype, T.BinaryType)
    return False


def equality_filter(df: DataFrame, filters: Mapping[str, Any], *, forbid: tuple[str, ...] = ()) -> Column:
    """AND of typed equalities over a sanitised filter map.

    ``forbid`` lists columns a filter may not name (the tenant column: D3)."""
    clean = sanitize_filters(filters)
    schema = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for name, value in clean.items():
        if name in forbid:
            raise SpecError(f"filter on scope column {name!r} is not allowed")
        if name not in schema:
            raise SpecError(f"Unknown filter column: {name}")
        parts.append(typed_equals(F.col(name), schema[name], value))
    return _and(parts)


def id_range(id_col: str, start: Any, end: Any | None) -> Column:
    """half-open id range; ``end=None`` leaves the last range open."""
    cond = F.col(id_col) >= F.lit(start)
    if end is not None:
        cond = cond & (F.col(id_col) < F.lit(end))
    return cond
