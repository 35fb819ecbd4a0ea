"""Export a report to files (K1-K13, M1): the whole run of one ReportSpec.

Single format: plan -> render -> one ``write.text`` (optionally gzip).  Several formats
(``format='zip'``):

* snapshot (K6) -- the rows are written once as a Parquet table in the shared checkpoint folder
  (after a check of their NDJSON size, if a limit was asked for) and every format is rendered
  from that table, which also cuts the lineage back to the source; the table is deleted after the run;
* multipass (K7, raw reports only) -- the high-water id is fixed first, then each format
  re-reads the source bounded by it; counts come from the first pass.

Reduce reports are cached: the group limit (A12, if asked for), the statistics and the write share
one aggregation.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import id_ranges
from ..operators.reduce import (
    INPUT_COUNT,
    MAX_ID,
    MIN_ID,
    GroupCapExceeded,
    group_order,
    partitioned_reduce,
    report_view,
)
from ..session import checkpoint_dir, remove_path
from ..sinks.manifest import Artifact, manifest_digest, with_policy
from ..sinks.text import (
    check_snapshot_size,
    clear_if_empty,
    csv_lines,
    json_array_lines,
    listing_lines,
    ndjson_lines,
    report_path,
    write_lines,
)
from ..sinks.workbook import write_empty_workbook, write_workbooks
from ..sources.registry import SourceChanged, SourceRegistry, bounded, file_version, high_water_id
from ..functions.render import normalize
from ..spec import (
    DEFAULT_CHUNKS,
    MSG_GROUP_CAP,
    ReportSpec,
)
from .report import plan_report, raw_order
from .stats import RunStats


@dataclass
class ExportResult:
    artifact: Artifact
    stats: RunStats
    paths: dict[str, str] = field(default_factory=dict)


def render(
    rows: DataFrame, order, fmt: str, listing_max_rows: int | None, obs: Observation | None = None, unique: bool = True,
) -> DataFrame:
    """Text lines of one format (csv, json, pdf -> numbered listing).  ``unique=False`` when
    the order key may tie (repeating ids)."""
    if fmt == "csv":
        return csv_lines(rows, order, obs=obs)
    if fmt == "json":
        return json_array_lines(rows, order, obs=obs, unique=unique)
    if fmt == "pdf":
        return listing_lines(rows, order, listing_max_rows, obs=obs)
    raise ValueError(f"not a text format: {fmt}")


def write_format(
    spark: SparkSession, rows: DataFrame, order, fmt: str, path: str, *, compression: str, listing_max_rows: int | None,
    obs: Observation | None = None, data_rows: int | None = None, unique: bool = True,
) -> None:
    """Write one entry.  When the data row count is known (``data_rows``) or measured (``obs``),
    a CSV header needs no probe pass: it is always written and an empty report is cleared."""
    if fmt == "xlsx":
        written = write_workbooks(rows, path, [], order)
        counted = Observation("xlsx_files")
        written = written.observe(counted, F.count(F.lit(1)).alias("files"))
        if obs is not None:
            written = written.observe(obs, F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"))
        written.write.format("noop").mode("overwrite").save()
        if counted.get.get("files", 0) == 0:
            write_empty_workbook(spark, path)
        return
    if fmt == "csv" and (obs is not None or data_rows is not None):
        write_lines(csv_lines(rows, order, obs=obs, probe=False), path, compression)
        clear_if_empty(path, data_rows if data_rows is not None else int(obs.get.get("rows", 0)), spark)
        return
    write_lines(render(rows, order, fmt, listing_max_rows, obs, unique), path, compression)


def export(
    spark: SparkSession,
    spec: ReportSpec,
    registry: SourceRegistry,
    base: str,
    *,
    policy: str = "required",
    noop: bool = False,
    multipass: bool = False,
    max_groups: int | None = None,
    listing_max_rows: int | None = None,
    snapshot_max_bytes: int | None = None,
    run_id: str | None = None,
    checksum: bool = True,
    chunk_profile: bool = False,
) -> ExportResult:
    """Run one report to files, in a folder of its own per run (``run_id``; by default a new one), so no run
    sees another's files.  Limits (groups, listing rows, snapshot bytes) hold only where passed.

    ``checksum=False`` sizes the artifact from file metadata
    instead of reading it back for SHA-256 (worth it for very large raw reports).
    ``chunk_profile=True`` adds, for a reduce, the per-id-range profile (M2: index, groups,
    rows in) to the statistics; it costs one more aggregation over the scoped rows."""
    started = time.time()
    plan = plan_report(spark, spec, registry)
    stats = RunStats(mode=plan.mode)
    rows, order = plan.rows, plan.order
    reduced = None
    if plan.mode == "reduce":
        # One aggregate over the cached result gives the group cap check (A12) and the run
        # statistics (A13, R1) together; the write then reads the same cache.
        reduced = plan.reduced.persist()
        agg = reduced.agg(
            F.coalesce(F.sum(INPUT_COUNT), F.lit(0)).alias("i"), F.count(F.lit(1)).alias("o"),
            F.min(MIN_ID).alias("lo"), F.max(MAX_ID).alias("hi"),
        ).first()
        if max_groups is not None and agg["o"] > max_groups:
            reduced.unpersist()
            raise GroupCapExceeded(MSG_GROUP_CAP.format(max_groups))
        chunks = plan.spec.partition.chunks if plan.spec.partition else DEFAULT_CHUNKS
        stats.rows_in, stats.rows_out = int(agg["i"]), int(agg["o"])
        stats.chunks = len(id_ranges(agg["lo"], agg["hi"], chunks, plan.source.id_kind))
        rows = report_view(reduced, spec.reduce)
        if chunk_profile:
            _, _, profile, _ = partitioned_reduce(plan.scoped, spec.reduce, plan.source.id_col, chunks, plan.source.id_kind)
            stats.extra["chunk_profile"] = [r.asDict() for r in profile.collect()]  # at most `chunks` rows

    entries = spec.entries
    is_bundle = spec.format == "zip"
    unique = plan.mode == "reduce" or plan.source.unique_id
    run_id = run_id or uuid.uuid4().hex
    key = report_path(base, spec.tenant, spec.report_id, run_id, "report.zip" if is_bundle else entries[0])
    shared = checkpoint_dir(spark).rstrip("/")
    # A dry run goes through the same writer into scratch, which is measured and then deleted.
    root = f"{shared}/dry-runs/{run_id}/{key.rsplit('/', 1)[1]}" if noop else key
    paths: dict[str, str] = {}
    snapshot = is_bundle and not (multipass and plan.mode == "raw")
    snap = f"{shared}/snapshots/{run_id}"

    def take_snapshot() -> tuple[DataFrame, list]:
        """The rows once, as a typed table that every format re-reads by column.

        With a limit, their NDJSON size is measured first; without one there is no measuring pass."""
        if snapshot_max_bytes is not None:
            check_snapshot_size(ndjson_lines(normalize(rows)), snapshot_max_bytes)
        counted = Observation("snapshot_rows")
        rows.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(snap)
        stats.zip_strategy, stats.rows_out = "snapshot", int(counted.get.get("rows", 0))
        if plan.mode == "raw":
            stats.rows_in = stats.rows_out
        kept = spark.read.schema(rows.schema).parquet(snap)
        return kept, group_order(spec.reduce, schema=kept.schema) if plan.mode == "reduce" else raw_order(kept, plan.source)

    def do_write() -> Artifact:
        if not is_bundle:
            obs = Observation("rows_out") if plan.mode == "raw" else None
            write_format(spark, rows, order, spec.format, root, compression=spec.compression,
                         listing_max_rows=listing_max_rows, obs=obs,
                         data_rows=stats.rows_out if plan.mode == "reduce" else None, unique=unique)
            paths[entries[0]] = root
            if obs is not None:
                stats.rows_in = stats.rows_out = int(obs.get.get("rows", 0))
        elif not snapshot:
            stats.zip_strategy = "multipass"
            version = file_version(plan.scoped)  # every pass reads the files listed here, and they must be the same at the end
            hwm = high_water_id(plan.scoped, plan.source)
            for i, fmt in enumerate(spec.include_formats):
                obs = Observation(f"pass{i}") if i == 0 else None
                path = f"{root}/report.{fmt}"
                write_format(spark, bounded(plan.scoped, plan.source, hwm), order, fmt, path,
                             compression="none", listing_max_rows=listing_max_rows, obs=obs,
                             data_rows=None if i == 0 else stats.rows_out, unique=unique)
                paths[f"report.{fmt}"] = path
                if obs is not None:
                    stats.rows_in = stats.rows_out = int(obs.get.get("rows", 0))
            if file_version(plan.scoped) != version:
                raise SourceChanged("a file of the source was replaced between two passes")
        else:
            snap_rows, snap_order = taken
            for fmt in spec.include_formats:
                path = f"{root}/report.{fmt}"
                write_format(spark, snap_rows, snap_order, fmt, path, compression="none", listing_max_rows=listing_max_rows,
                             data_rows=stats.rows_out, unique=unique)
                paths[f"report.{fmt}"] = path
        size, digest, _files = manifest_digest(spark, root, checksum)
        if noop:
            return Artifact(mode="noop", available=False, reason="NOOP", size_bytes=size, checksum=digest, key=key)
        return Artifact(mode="filesystem", available=True, size_bytes=size, checksum=digest, key=root,
                        entries=entries if (is_bundle or spec.compression == "zip") else [])

    try:
        # The snapshot comes before the store step: its failures are errors under either policy.
        taken = take_snapshot() if snapshot else None
        artifact = with_policy(policy, do_write, key)
        if noop:
            paths.clear()
    finally:
        if reduced is not None:
            reduced.unpersist()
        if snapshot:
            remove_path(spark, snap)
        if noop:
            remove_path(spark, root.rsplit("/", 1)[0])
    stats.finish(started)
    return ExportResult(artifact, stats, paths)
