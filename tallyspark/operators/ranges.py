"""Equal-width id ranges.

Ranges cover ``[min, max]`` with ``size = ceil(span / chunks)``; the last range is open.  The
bounds come from one ``agg(min, max)``; every row then finds its range with a Column
expression, so partial aggregates per range (A9) need no join and no driver loop.

Ids are either BIGINT or 24-digit lowercase hex strings (96-bit object ids).  Equal-length
lowercase hex sorts as the number does, so hex rows compare as strings against hex bounds.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import id_range

HEX_DIGITS = 24


@dataclass(frozen=True)
class IdRange:
    index: int
    start: Any  # inclusive
    end: Any | None  # exclusive; None = open


def objectid_to_int(hex_id: str) -> int:
    """24 hex digits -> 96-bit integer."""
    return int(hex_id, 16)


def int_to_objectid(value: int) -> str:
    """Integer -> 24 lowercase hex digits, zero-padded (low 96 bits)."""
    return format(value & ((1 << (4 * HEX_DIGITS)) - 1), "x").zfill(HEX_DIGITS)


def build_ranges(lo: int, hi: int, chunks: int) -> list[tuple[int, int, int | None]]:
    """R1 over integers: ``(index, start, end_or_None)``; ``[]`` when ``hi < lo``.

    With ``span = hi - lo + 1`` and ``size = ceil(span / chunks)`` there are ``ceil(span / size)``
    ranges (fewer than ``chunks`` when the span is short); range ``i`` starts at
    ``lo + i * size`` and its end is open once the next start would pass ``hi``."""
    if hi < lo:
        return []
    span = hi - lo + 1
    size = -(-span // max(1, chunks))
    count = -(-span // size)
    return [(i, lo + i * size, lo + (i + 1) * size if lo + (i + 1) * size <= hi else None) for i in range(count)]


def id_ranges(min_id: Any, max_id: Any, chunks: int, id_kind: str = "bigint") -> list[IdRange]:
    if min_id is None or max_id is None:
        return []
    if id_kind == "hex":
        raw = build_ranges(objectid_to_int(min_id), objectid_to_int(max_id), chunks)
        return [IdRange(i, int_to_objectid(s), None if e is None else int_to_objectid(e)) for i, s, e in raw]
    return [IdRange(i, s, e) for i, s, e in build_ranges(int(min_id), int(max_id), chunks)]


EXACT = "decimal(38,0)"


def exact(value: int) -> Column:
    """An integer literal of the type all range arithmetic uses (96-bit ids fit)."""
    return F.lit(str(value)).cast(EXACT)


def exact_div(a: Column, b: Column) -> Column:
    """Integer quotient of two non-negative exact columns.  What is divided is a multiple of the
    divisor, so the decimal division cannot round."""
    return ((a - a % b) / b).cast(EXACT)


def id_number(col: Column, id_kind: str = "bigint") -> Column:
    """An id as an exact number: BIGINT as it is, 24 hex digits from their two halves."""
    if id_kind == "hex":
        halves = [F.conv(F.substring(col, at, HEX_DIGITS // 2), 16, 10).cast("decimal(20,0)").cast(EXACT) for at in (1, HEX_DIGITS // 2 + 1)]
        return (halves[0] * F.lit(1 << (2 * HEX_DIGITS)).cast("decimal(18,0)") + halves[1]).cast(EXACT)
    return col.cast(EXACT)


def _kind(ranges: list[IdRange]) -> str:
    return "hex" if isinstance(ranges[0].start, str) else "bigint"


def chunk_of(ranges: list[IdRange], id_col: str) -> Column:
    """Index of the range holding each row's id: ``(id - first start) div size``, at most the last.

    Equal-width ranges need two literals, however many there are.  An id below the first start
    and a null id are in no range (null), for either kind of id."""
    if not ranges:
        return F.lit(None).cast("int")
    kind = _kind(ranges)
    number = objectid_to_int if kind == "hex" else int
    lo = number(ranges[0].start)
    above = id_number(F.col(id_col), kind) - exact(lo)
    if len(ranges) == 1:
        return F.when(above >= 0, F.lit(ranges[0].index))
    index = exact_div(above, exact(number(ranges[1].start) - lo))
    return F.when(above >= 0, F.least(index, exact(len(ranges) - 1)).cast("int") + F.lit(ranges[0].index))


def range_predicate(r: IdRange, id_col: str) -> Column:
    """F6 for one range."""
    return id_range(id_col, r.start, r.end)


def read_bounds(df: DataFrame, id_col: str) -> tuple[Any, Any]:
    """O2: min and max id in one aggregate over the id column only."""
    row = df.agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).first()
    return row["lo"], row["hi"]


def ranges_frame(df: DataFrame, id_col: str, chunks: int) -> DataFrame:
    """R1 for BIGINT ids as a lazy DataFrame: one aggregate, exploded into its ranges (the
    closed form of ``build_ranges``, in exact arithmetic).  Columns ``chunk, start_id, end_id``
    (``end_id`` null on the open last range)."""
    lo, hi = F.col("lo"), F.col("hi")
    bounds = df.agg(id_number(F.min(id_col)).alias("lo"), id_number(F.max(id_col)).alias("hi")).filter(hi >= lo)
    sized = bounds.withColumn("size", range_size(lo, hi, chunks))
    count = range_total(lo, hi, F.col("size")).cast("int")
    exploded = sized.select("lo", "hi", "size", F.explode(F.sequence(F.lit(0), count - F.lit(1))).alias("chunk"))
    start = (lo + F.col("chunk").cast(EXACT) * F.col("size")).cast(EXACT)
    nxt = (start + F.col("size")).cast(EXACT)
    return exploded.select(
        F.col("chunk").cast("int").alias("chunk"), start.cast("long").alias("start_id"), F.when(nxt <= hi, nxt).cast("long").alias("end_id")
    )


def range_size(lo: Column, hi: Column, chunks: int) -> Column:
    """Width of R1's ranges over exact bounds: ``ceil(span / chunks)``."""
    parts = max(1, chunks)
    return exact_div((hi - lo + exact(parts)).cast(EXACT), exact(parts))


def range_total(lo: Column, hi: Column, size: Column) -> Column:
    """How many ranges of ``size`` cover exact bounds."""
    return exact_div((hi - lo + size).cast(EXACT), size)
