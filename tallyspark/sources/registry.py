"""Source registry and tenant scans.

A source is a table of rows with an orderable id column and a tenant column.  Sources are
registered by name; a report picks one by name, checked against an allowlist.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import typed_equals
from ..spec import MSG_SOURCE_NOT_ALLOWED, MSG_SOURCE_PATTERN, SAFE_NAME, SpecError

DEFAULT_SOURCE = "reportSource"


@dataclass(frozen=True)
class Source:
    """A named table.  ``id_kind`` is ``bigint`` or ``hex`` (24 lowercase hex digits).

    ``unique_id=False`` declares that ids repeat; raw reports then break ties by the
    ``tiebreak`` columns when given (e.g. a line number), else by a hash of the whole row, so a
    hot id value is still split over many sort partitions and the order of tied rows is the
    same on every (re)computation."""

    name: str
    path: str
    id_col: str
    tenant_col: str
    format: str = "parquet"
    id_kind: str = "bigint"
    unique_id: bool = True
    schema: str | None = None  # DDL; fixes the schema of text sources (no inference pass)
    options: tuple[tuple[str, str], ...] = ()  # reader options, e.g. (("header", "true"),)
    tiebreak: tuple[str, ...] = ()  # columns ordering rows that share an id

    def load(self, spark: SparkSession) -> DataFrame:
        if self.format == "table":
            return spark.table(self.path)
        reader = spark.read.format(self.format).options(**dict(self.options))
        if self.schema:
            reader = reader.schema(self.schema)
        return reader.load(self.path)


def resolve_source_name(name: str | None, allowed: Iterable[str], fallback: str = DEFAULT_SOURCE) -> str:
    """Trim, blank -> fallback, must be a safe name, must be allowed."""
    resolved = (name or "").strip() or fallback
    if not SAFE_NAME.fullmatch(resolved):
        raise SpecError(MSG_SOURCE_PATTERN)
    if resolved not in list(allowed):
        raise SpecError(MSG_SOURCE_NOT_ALLOWED.format(resolved))
    return resolved


class SourceRegistry:
    """Name -> Source, with an allowlist (defaults to every registered name)."""

    def __init__(self, sources: Iterable[Source], allowed: Iterable[str] | None = None, default: str = DEFAULT_SOURCE):
        self._sources = {s.name: s for s in sources}
        self.allowed = list(allowed) if allowed is not None else list(self._sources)
        self.default = default

    def resolve(self, name: str | None) -> Source:
        resolved = resolve_source_name(name, self.allowed, self.default)
        if resolved not in self._sources:
            raise SpecError(f"sourceCollection '{resolved}' is not registered")
        return self._sources[resolved]

    def load(self, spark: SparkSession, name: str | None) -> tuple[Source, DataFrame]:
        source = self.resolve(name)
        return source, source.load(spark)


def testdata_registry(sf_dir: str, allowed: Iterable[str] | None = None) -> SourceRegistry:
    """Registry over the generated test tables (role mapping in FIXTURES.md section 7)."""
    # Id and tenant column of each test table.
    roles = {
        "events": ("event_id", "user_id"),
        "orders": ("o_orderkey", "o_orderpriority"),
        "lineitem": ("l_orderkey", "l_returnflag"),
        "documents": ("doc_id", "lang"),
        "customer": ("c_custkey", "c_mktsegment"),
        "conversations": ("conv_id", "role"),
    }
    # Ids that repeat across rows, with the column that orders rows sharing an id.
    tiebreaks = {"lineitem": ("l_linenumber",), "conversations": ("turn",)}
    sources = [
        Source(name, f"{sf_dir}/{name}.parquet", id_col, tenant, unique_id=name not in tiebreaks,
               tiebreak=tiebreaks.get(name, ()))
        for name, (id_col, tenant) in roles.items()
    ]
    return SourceRegistry(sources, allowed=allowed, default="events")


def tenant_predicate(df: DataFrame, source: Source, tenant: Any) -> Column:
    """The tenant scope, a typed equality (D6); ``None`` scopes to rows whose tenant is null."""
    return typed_equals(F.col(source.tenant_col), df.schema[source.tenant_col].dataType, tenant)


def scan_tenant(df: DataFrame, source: Source, tenant: Any, extra: Column | None = None) -> DataFrame:
    """S2 + F7: tenant scope ANDed with any other clause; pushed to the Parquet scan."""
    cond = tenant_predicate(df, source, tenant)
    if extra is not None:
        cond = cond & extra
    return df.filter(cond)


def high_water_id(df: DataFrame, source: Source) -> Any:
    """S3: the largest id of an (already scoped) frame, or ``None`` when it is empty.

    One aggregate; Parquet footers answer it when the aggregate is pushed down."""
    return df.agg(F.max(source.id_col).alias("hwm")).first()["hwm"]


class SourceChanged(RuntimeError):
    pass


def file_version(df: DataFrame) -> tuple[int, int] | None:
    """Number and fingerprint of the files behind ``df`` (path, length, modification time), from metadata alone.

    A frame keeps the list of files that it was planned with, so later files are in no pass over it; the fingerprint tells
    whether one of the listed files was replaced meanwhile.  None for a frame that reads no files; a file that is gone is an error."""
    paths = df.inputFiles()
    if not paths:
        return None
    listed = df.sparkSession.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    row = listed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("v")).first()
    return int(row.n), int(row.v or 0)


def bounded(df: DataFrame, source: Source, hwm: Any) -> DataFrame:
    """S3: re-read bounded by a high-water id fixed before the first pass.

    Rows without an id have no place above the bound, so every pass keeps them."""
    id_col = F.col(source.id_col)
    return df.filter(id_col.isNull() if hwm is None else id_col.isNull() | (id_col <= F.lit(hwm)))


def require_columns(df: DataFrame, names: Iterable[str], what: str = "column") -> None:
    """Unknown columns fail at plan time, not as null groups."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise SpecError(f"Unknown {what}: {', '.join(missing)}")


def as_mapping(obj: Any) -> Mapping[str, Any]:
    return obj if isinstance(obj, Mapping) else {}
