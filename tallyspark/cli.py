"""Command line: run one report request (the reference's JSON request shape) as a Spark job.

    python -m tallyspark.cli --request req.json --tenant acme \\
        --source orders=s3a://bucket/orders:_id:tenantId:hex --out s3a://bucket/reports

``--source`` is ``name=path:id_col:tenant_col[:id_kind]`` and may repeat; the first is the
default.  ``--repeating-ids``, ``--tiebreak``, ``--source-format`` and ``--source-schema`` take
``name`` or ``name=value`` and say more about a source.  Limits hold only where given.  Prints the artifact and run statistics as one JSON line.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .plans.export import export
from .session import prepare
from .sources.registry import Source, SourceRegistry
from .spec import ReportSpec


def parse_source(text: str) -> Source:
    """``name=path:id_col:tenant_col[:id_kind]``; the path may itself hold colons (URIs)."""
    name, rest = text.split("=", 1)
    kind = "bigint"
    head, last = rest.rsplit(":", 1)
    if last in ("hex", "bigint"):
        kind, rest = last, head
    path, id_col, tenant_col = rest.rsplit(":", 2)
    return Source(name, path, id_col, tenant_col, id_kind=kind)


def described(sources: list[Source], args) -> list[Source]:
    """The sources with what further flags say about them."""
    def by_name(items: list[str]) -> dict[str, str]:
        return dict(item.split("=", 1) for item in items)

    ties, formats, schemas = by_name(args.tiebreak), by_name(args.source_format), by_name(args.source_schema)
    return [replace(s, unique_id=s.name not in args.repeating_ids and s.name not in ties, tiebreak=tuple(filter(None, ties.get(s.name, "").split(","))),
                    format=formats.get(s.name, s.format), schema=schemas.get(s.name)) for s in sources]


def typed_tenant(text: str, dtype: T.DataType):
    """The command line's tenant as a value of the tenant column: an integer where it reads as one."""
    if isinstance(dtype, T.IntegralType) and re.fullmatch(r"-?(0|[1-9][0-9]*)", text):
        return int(text)
    return text


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="tallyspark")
    ap.add_argument("--request", required=True, help="report request JSON file")
    ap.add_argument("--tenant", required=True)
    ap.add_argument("--source", action="append", required=True)
    ap.add_argument("--allowed", default=None, help="comma-separated allowlist (default: every --source)")
    ap.add_argument("--out", required=True, help="base folder or URI for artifacts")
    ap.add_argument("--policy", default="required", choices=["required", "optional"])
    ap.add_argument("--multipass", action="store_true", help="raw zip reports re-read the source per format")
    ap.add_argument("--noop", action="store_true", help="run everything, store nothing")
    ap.add_argument("--repeating-ids", action="append", default=[], metavar="NAME", help="ids of this source repeat")
    ap.add_argument("--tiebreak", action="append", default=[], metavar="NAME=COL,...", help="columns that order rows sharing an id")
    ap.add_argument("--source-format", action="append", default=[], metavar="NAME=FORMAT", help="file format (default parquet)")
    ap.add_argument("--source-schema", action="append", default=[], metavar="NAME=DDL", help="fixed schema of a text source")
    ap.add_argument("--max-groups", type=int, default=None)
    ap.add_argument("--max-listing-rows", type=int, default=None)
    ap.add_argument("--max-snapshot-bytes", type=int, default=None)
    ap.add_argument("--run-id", default=None, help="folder of this run (default: a new one)")
    ap.add_argument("--chunk-profile", action="store_true", help="add groups and rows per id range to the statistics")
    ap.add_argument("--no-checksum", action="store_true", help="size the artifact without reading it back")
    args = ap.parse_args(argv)

    with open(args.request) as f:
        request = json.load(f)
    sources = described([parse_source(s) for s in args.source], args)
    allowed = args.allowed.split(",") if args.allowed else None
    registry = SourceRegistry(sources, allowed=allowed, default=sources[0].name)
    spark = prepare(SparkSession.builder.appName("tallyspark").getOrCreate())
    source = registry.resolve(request.get("sourceCollection"))
    spec = ReportSpec.parse(request, tenant=typed_tenant(args.tenant, source.load(spark).schema[source.tenant_col].dataType))
    result = export(spark, spec, registry, args.out, policy=args.policy, multipass=args.multipass, noop=args.noop,
                    checksum=not args.no_checksum, max_groups=args.max_groups, listing_max_rows=args.max_listing_rows,
                    snapshot_max_bytes=args.max_snapshot_bytes, run_id=args.run_id, chunk_profile=args.chunk_profile)
    print(json.dumps({"artifact": result.artifact.as_dict(), "stats": result.stats.as_dict(), "paths": result.paths}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
