"""Report specs: the engine's whole query language.

A report names one source table, one tenant, an equality filter map and optionally a
group-by with metrics.  Specs are frozen dataclasses validated on construction, so an
invalid spec never reaches Spark.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# Names accepted in specs, operations, formats and internal prefixes.
SAFE_NAME = re.compile(r"[A-Za-z0-9_]+")  # always a full match
OPS = ("count", "sum", "min", "max", "avg")
SINGLE_FORMATS = ("csv", "xlsx", "json", "pdf")
FORMATS = SINGLE_FORMATS + ("zip",)
COMPRESSIONS = ("none", "zip")
AVG_SUM_PREFIX = "__avg_sum__"
AVG_COUNT_PREFIX = "__avg_count__"
INPUT_COUNT = "__input_count"
RESERVED_ALIASES = ("_id", INPUT_COUNT)
DEFAULT_CHUNKS = 32
# Limits a deployment may ask for; nothing is limited unless the caller passes a limit.
MAX_GROUPS = 500_000
LISTING_MAX_ROWS = 10_000
SNAPSHOT_MAX_BYTES = 2_147_483_648
DEFAULT_RETENTION_DAYS = 30

# Error texts kept word for word, so callers that match on them keep working.
MSG_NO_METRICS = "reduceSpec.metrics must contain at least one metric"
MSG_INVALID_GROUP = "Invalid groupBy field: {}"
MSG_INVALID_ALIAS = "Invalid metric alias: {}"
MSG_DUPLICATED_ALIAS = "Duplicated metric alias: {}"
MSG_FIELD_REQUIRED = "Metric {} requires a valid field"
MSG_UNSUPPORTED_OP = "Unsupported reduce operation: {}"
MSG_ZIP_NEEDS_FORMATS = "includeFormats is required when format=zip"
MSG_FORMATS_ONLY_ZIP = "includeFormats is allowed only when format=zip"
MSG_ZIP_COMPRESSION = "compression=zip cannot be used with format=zip"
MSG_DUPLICATED_FORMATS = "includeFormats cannot contain duplicates"
MSG_ZIP_REQUIRES_FORMATS = "format=zip requires includeFormats"
MSG_SOURCE_PATTERN = "sourceCollection must match ^[A-Za-z0-9_]+$"
MSG_SOURCE_NOT_ALLOWED = "sourceCollection '{}' is not allowed"
MSG_GROUP_CAP = "Reduce group cardinality exceeded REPORT_REDUCE_MAX_GROUPS ({})"
MSG_ROW_CAP = "PDF row limit exceeded. max={}, received>{}"
MSG_SNAPSHOT_CAP = "Temporary snapshot size exceeded REPORT_TMP_MAX_BYTES ({} bytes)"
MSG_NON_NUMERIC = "Non numeric value found in reduce field: {}"
OPTIONAL_FAILURE = "OPTIONAL_INTEGRATION_FAILURE"


class SpecError(ValueError):
    """Raised for any invalid spec; the message names the offending part."""


def _check_name(value: Any, message: str) -> str:
    if not isinstance(value, str) or not SAFE_NAME.fullmatch(value):
        raise SpecError(message.format(value))
    return value


@dataclass(frozen=True)
class Metric:
    op: str
    alias: str
    field: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise SpecError(MSG_UNSUPPORTED_OP.format(self.op))
        _check_name(self.alias, MSG_INVALID_ALIAS)
        if self.op != "count":
            if self.field is None or not SAFE_NAME.fullmatch(str(self.field)):
                raise SpecError(MSG_FIELD_REQUIRED.format(self.alias))
        elif self.field is not None:
            _check_name(self.field, MSG_FIELD_REQUIRED.format(self.alias) + ": {}")

    @classmethod
    def parse(cls, obj: Mapping[str, Any]) -> "Metric":
        return cls(op=obj.get("op"), alias=obj.get("as"), field=obj.get("field"))


@dataclass(frozen=True)
class ReduceSpec:
    metrics: tuple[Metric, ...]
    group_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "metrics", tuple(self.metrics))
        object.__setattr__(self, "group_by", tuple(self.group_by))
        if not self.metrics:
            raise SpecError(MSG_NO_METRICS)
        for g in self.group_by:
            _check_name(g, MSG_INVALID_GROUP)
        seen: set[str] = set()
        keys = set(self.group_by)
        for m in self.metrics:
            if m.alias in seen:
                raise SpecError(MSG_DUPLICATED_ALIAS.format(m.alias))
            seen.add(m.alias)
            # Aliases that would shadow keys or bookkeeping columns are rejected.
            if m.alias in RESERVED_ALIASES or m.alias.startswith((AVG_SUM_PREFIX, AVG_COUNT_PREFIX)):
                raise SpecError(f"Reserved metric alias: {m.alias}")
            if m.alias in keys:
                raise SpecError(f"Metric alias {m.alias} collides with a groupBy field")

    @property
    def keys(self) -> list[str]:
        """Group keys with repeats collapsed, first occurrence wins."""
        return list(dict.fromkeys(self.group_by))

    @classmethod
    def parse(cls, obj: Mapping[str, Any]) -> "ReduceSpec":
        metrics = obj.get("metrics") or []
        return cls(metrics=tuple(Metric.parse(m) for m in metrics), group_by=tuple(obj.get("groupBy") or ()))


@dataclass(frozen=True)
class PartitionSpec:
    strategy: str = "idRange"
    chunks: int = DEFAULT_CHUNKS

    def __post_init__(self) -> None:
        if self.strategy not in ("idRange", "objectIdRange"):
            raise SpecError(f"Unsupported partition strategy: {self.strategy!r}")
        if not isinstance(self.chunks, int) or self.chunks < 1:
            raise SpecError("partitionSpec.chunks must be a positive integer")


@dataclass(frozen=True)
class ReportSpec:
    """One report run.

    ``format`` is one of csv, json, xlsx, pdf (numbered listing text) or zip (one entry per
    ``include_formats`` item).  ``compression='zip'`` compresses a single-format output.
    """

    tenant: Any
    source: str | None = None
    format: str = "csv"
    filters: Mapping[str, Any] = field(default_factory=dict)
    reduce: ReduceSpec | None = None
    partition: PartitionSpec | None = None
    include_formats: tuple[str, ...] = ()
    compression: str = "none"
    report_id: str = "report"

    def __post_init__(self) -> None:
        object.__setattr__(self, "include_formats", tuple(self.include_formats or ()))
        object.__setattr__(self, "filters", dict(self.filters or {}))
        if self.format not in FORMATS:
            raise SpecError(f"Unsupported format: {self.format!r}")
        if self.compression not in COMPRESSIONS:
            raise SpecError(f"Unsupported compression: {self.compression!r}")
        if self.format == "zip" and not self.include_formats:
            raise SpecError(MSG_ZIP_NEEDS_FORMATS)
        if self.format != "zip" and self.include_formats:
            raise SpecError(MSG_FORMATS_ONLY_ZIP)
        if self.compression == "zip" and self.format == "zip":
            raise SpecError(MSG_ZIP_COMPRESSION)
        if len(set(self.include_formats)) != len(self.include_formats):
            raise SpecError(MSG_DUPLICATED_FORMATS)
        for f in self.include_formats:
            if f not in SINGLE_FORMATS:
                raise SpecError(f"Unsupported include format: {f!r}")
        if not self.report_id:
            raise SpecError("report_id must be non-empty")

    @property
    def entries(self) -> list[str]:
        """Output entry names in the given order (``report.<ext>``)."""
        formats = self.include_formats if self.format == "zip" else (self.format,)
        return [f"report.{f}" for f in formats]

    @classmethod
    def parse(cls, obj: Mapping[str, Any], tenant: Any) -> "ReportSpec":
        """Build from the reference's JSON request shape."""
        for name in ("reportDefinitionId", "format"):
            if not isinstance(obj.get(name), str) or not obj[name]:
                raise SpecError(f"{name} is required")
        reduce = obj.get("reduceSpec")
        part = obj.get("partitionSpec")
        return cls(
            tenant=tenant,
            source=obj.get("sourceCollection"),
            format=obj["format"],
            filters=obj.get("filters") or {},
            reduce=ReduceSpec.parse(reduce) if reduce else None,
            partition=PartitionSpec(part.get("strategy", "idRange"), part.get("chunks", DEFAULT_CHUNKS)) if part else None,
            include_formats=tuple(obj.get("includeFormats") or ()),
            compression=obj.get("compression", "none"),
            report_id=obj["reportDefinitionId"],
        )


def check_formats(format: str, include_formats: Sequence[str] | None) -> list[str]:
    """K13 on the worker side: a zip run needs its formats, others have none."""
    if format != "zip":
        return []
    if not include_formats:
        raise SpecError(MSG_ZIP_REQUIRES_FORMATS)
    return list(include_formats)
