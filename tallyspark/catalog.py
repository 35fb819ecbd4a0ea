"""Query catalogue: one entry per operator group of SURVEY section 2.14.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame built with the engine's
public operators over the whole test tables; ``ORACLE_SQL`` holds the same query in plain SQL
for DuckDB.  Column names match between the two.  Money is summed as DECIMAL(18,2) and cast
to DOUBLE on both sides so float addition order cannot differ.
"""

from __future__ import annotations

import datetime as _dt
import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.render import json_value, normalize, number_text, sha256_hex, utf8_bytes
from .operators import reduce as R
from .operators.filters import equality_filter
from .operators.ordering import number_rows
from .operators.ranges import chunk_of, id_number, id_ranges, range_predicate, ranges_frame, read_bounds
from .plans.batch import (
    all_tenant_lines,
    apply_retention,
    reduce_all_tenants,
    retained,
    run_specs,
    specs_frame,
    write_all_tenants,
)
from .plans.export import export
from .plans.report import plan_report, run
from .plans.stats import stats_frame
from .session import checkpoint_dir
from .sinks.folders import read_text_folders
from .sinks.manifest import part_files
from .sinks.readback import entry_rows, workbook_cells
from .sinks.text import csv_frame, json_array_frame, listing_lines, ndjson_lines, snapshot_bytes
from .sinks.workbook import workbooks
from .sources.registry import Source, SourceRegistry, bounded, high_water_id, testdata_registry
from .sources.layout import write_clustered
from .sources.seed import seed_from
from .sources.snapshot import read_snapshot, write_snapshot
from .spec import LISTING_MAX_ROWS, MAX_GROUPS, Metric, ReduceSpec, ReportSpec
from .streaming.incremental import current_report, reduce_stream_once, start_report_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(df: DataFrame, *cols: str) -> DataFrame:
    """Exact money: DECIMAL(18,2) columns (the oracle casts the same way)."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})


def as_double(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


FIVE_OPS = ReduceSpec(
    group_by=("event_type",),
    metrics=(
        Metric("count", "n"),
        Metric("sum", "total", "value"),
        Metric("min", "min_value", "value"),
        Metric("max", "max_value", "value"),
        Metric("avg", "avg_value", "value"),
    ),
)

FIVE_OPS_SQL = """
select event_type, count(*) as n,
       cast(coalesce(sum(cast(value as decimal(18,2))), 0) as double) as total,
       min(value) as min_value, max(value) as max_value,
       cast(sum(cast(value as decimal(18,2))) as double) / count(value) as avg_value
from events group by event_type
"""


# ------------------------------------------------------------------ raw path


@query("raw_tenant", "select * from events where user_id = 8")
def raw_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = testdata_registry(sf_dir)
    return run(spark, ReportSpec(tenant=8, source="events"), reg)


@query("raw_filtered", "select * from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
def raw_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = testdata_registry(sf_dir)
    return run(spark, ReportSpec(tenant="1-URGENT", source="orders", filters={"o_orderstatus": "P"}), reg)


# ------------------------------------------------------------------ reduce


@query("reduce_all_ops", FIVE_OPS_SQL)
def reduce_all_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = money(table(spark, sf_dir, "events"), "value")
    out = R.reduce(events, FIVE_OPS)
    return as_double(out, "total", "min_value", "max_value")


@query(
    "reduce_multi_key",
    """
select l_returnflag, l_linestatus, count(*) as n,
       cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue,
       cast(sum(cast(l_quantity as decimal(18,2))) as double) / count(l_quantity) as avg_qty
from lineitem group by l_returnflag, l_linestatus
""",
)
def reduce_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = money(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")
    spec = ReduceSpec(
        group_by=("l_returnflag", "l_linestatus", "l_returnflag"),
        metrics=(Metric("count", "n"), Metric("sum", "revenue", "l_extendedprice"), Metric("avg", "avg_qty", "l_quantity")),
    )
    return as_double(R.reduce(li, spec), "revenue")


def five_ops_doubles(df: DataFrame) -> DataFrame:
    return as_double(df, "total", "min_value", "max_value")


@query(
    "reduce_global",
    """
select count(*) as n,
       cast(coalesce(sum(cast(value as decimal(18,2))), 0) as double) as total,
       min(value) as min_value, max(value) as max_value,
       cast(sum(cast(value as decimal(18,2))) as double) / count(value) as avg_value
from events
""",
)
def reduce_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReduceSpec(metrics=FIVE_OPS.metrics)
    return five_ops_doubles(R.reduce(money(table(spark, sf_dir, "events"), "value"), spec))


@query("reduce_global_empty", "select count(*) as n from events where user_id = -1 having count(*) > 0")
def reduce_global_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReportSpec(tenant=-1, source="events", reduce=ReduceSpec(metrics=(Metric("count", "n"),)))
    return plan_report(spark, spec, testdata_registry(sf_dir)).rows


NULLED_SQL = "case when event_type = 'view' then null else cast(value as decimal(18,2)) end"


@query(
    "reduce_nulls",
    f"""
select event_type, count(*) as n,
       cast(coalesce(sum({NULLED_SQL}), 0) as double) as sum_v,
       cast(min({NULLED_SQL}) as double) as min_v, cast(max({NULLED_SQL}) as double) as max_v,
       cast(sum({NULLED_SQL}) as double) / count({NULLED_SQL}) as avg_v
from events group by event_type
""",
)
def reduce_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = money(table(spark, sf_dir, "events"), "value")
    ev = ev.withColumn("v", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value")))
    spec = ReduceSpec(
        group_by=("event_type",),
        metrics=(Metric("count", "n"), Metric("sum", "sum_v", "v"), Metric("min", "min_v", "v"),
                 Metric("max", "max_v", "v"), Metric("avg", "avg_v", "v")),
    )
    return as_double(R.reduce(ev, spec), "sum_v", "min_v", "max_v")


@query(
    "reduce_minmax_types",
    """
select event_type, min(props) as min_props, max(props) as max_props, min(ts) as first_ts, max(ts) as last_ts
from events group by event_type
""",
)
def reduce_minmax_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReduceSpec(
        group_by=("event_type",),
        metrics=(Metric("min", "min_props", "props"), Metric("max", "max_props", "props"),
                 Metric("min", "first_ts", "ts"), Metric("max", "last_ts", "ts")),
    )
    return R.reduce(table(spark, sf_dir, "events"), spec)


@query(
    "reduce_float_key",
    """
select case when isnan(k) or isinf(k) then null else k end as k, count(*) as n,
       cast(sum(cast(value as decimal(18,2))) as double) as total
from (select *, case when event_type = 'view' then 'NaN'::double when event_type = 'click' then null
                     else floor(value / 100)::double end as k from events)
group by 1
""",
)
def reduce_float_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = money(table(spark, sf_dir, "events"), "value")
    ev = ev.withColumn(
        "k",
        F.when(F.col("event_type") == "view", F.lit(float("nan")))
        .when(F.col("event_type") == "click", F.lit(None).cast("double"))
        .otherwise(F.floor(F.col("value").cast("double") / 100).cast("double")),
    )
    spec = ReduceSpec(group_by=("k",), metrics=(Metric("count", "n"), Metric("sum", "total", "value")))
    return as_double(R.reduce(ev, spec), "total")


@query(
    "reduce_ordered",
    """
select event_type, count(*) as n, row_number() over (order by to_json({'event_type': event_type})) as rn
from events group by event_type
""",
)
def reduce_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"),))
    out = R.reduce(table(spark, sf_dir, "events"), spec)
    return number_rows(out, R.group_order(spec, schema=out.schema))


@query(
    "reduce_group_cap",
    """
select user_id, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total
from events group by user_id
""",
)
def reduce_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReduceSpec(group_by=("user_id",), metrics=(Metric("count", "n"), Metric("sum", "total", "value")))
    reduced = R.enforce_group_cap(R.reduce_frame(money(table(spark, sf_dir, "events"), "value"), spec), MAX_GROUPS)
    return as_double(R.report_view(reduced, spec), "total")


@query(
    "reduce_all_tenants",
    """
select user_id, event_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total
from events group by user_id, event_type
""",
)
def reduce_all_tenants_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"), Metric("sum", "total", "value")))
    return as_double(reduce_all_tenants(money(table(spark, sf_dir, "events"), "value"), "user_id", spec), "total")


@query(
    "run_stats",
    """
with b as (select min(o_orderkey) as lo, max(o_orderkey) as hi, count(*) as rows_in,
                  count(distinct o_orderstatus) as rows_out from orders where o_orderpriority = '1-URGENT'),
s as (select *, hi - lo + 1 as span, (hi - lo + 1 + 31) // 32 as size from b)
select rows_in, rows_out, cast((span + size - 1) // size as bigint) as chunks from s
""",
)
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReportSpec(tenant="1-URGENT", source="orders", reduce=ReduceSpec(
        group_by=("o_orderstatus",), metrics=(Metric("count", "n"), Metric("sum", "total", "o_totalprice"))))
    return stats_frame(plan_report(spark, spec, testdata_registry(sf_dir)))


# ------------------------------------------------------------------ raw path, filters, order


@query(
    "raw_ordered",
    "select o_orderkey, row_number() over (order by o_orderkey) as rn from orders where o_orderpriority = '1-URGENT'",
)
def raw_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_report(spark, ReportSpec(tenant="1-URGENT", source="orders"), testdata_registry(sf_dir))
    return number_rows(plan.rows.select("o_orderkey"), plan.order)


@query(
    "hwm_scan",
    """
select * from orders where o_orderpriority = '1-URGENT'
  and o_orderkey <= (select max(o_orderkey) from orders where o_orderpriority = '1-URGENT')
""",
)
def hwm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_report(spark, ReportSpec(tenant="1-URGENT", source="orders"), testdata_registry(sf_dir))
    hwm = high_water_id(plan.scoped, plan.source)
    return bounded(plan.scoped, plan.source, hwm)


CHUNKS_SQL = """
with b as (select min(event_id) as lo, max(event_id) as hi from events),
s as (select lo, hi, (hi - lo + 1 + {n} - 1) // {n} as size from b)
"""


@query(
    "id_range_scan",
    CHUNKS_SQL.format(n=32)
    + "select event_id, cast(least((event_id - s.lo) // s.size, 31) as integer) as chunk from events, s",
)
def id_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    lo, hi = read_bounds(ev, "event_id")
    ranges = id_ranges(lo, hi, 32)
    parts = [ev.where(range_predicate(r, "event_id")).select("event_id", F.lit(r.index).alias("chunk")) for r in ranges]
    return functools.reduce(DataFrame.unionAll, parts)


@query("filter_type_bracket", "select * from orders where false")
def filter_type_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReportSpec(tenant="1-URGENT", source="orders", filters={"o_totalprice": "100"})
    return run(spark, spec, testdata_registry(sf_dir))


@query(
    "filter_null",
    """
select event_id, event_type, v from (
  select event_id, event_type, case when event_type = 'view' then null else value end as v from events)
where v is null
""",
)
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value")).alias("v")
    )
    return ev.filter(equality_filter(ev, {"v": None}))


@query(
    "filter_struct",
    """
select l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem
where {'f': l_returnflag, 's': l_linestatus} = {'f': 'A', 's': 'F'}
""",
)
def filter_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus",
        F.struct(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).alias("fs"),
    )
    return li.filter(equality_filter(li, {"fs": {"f": "A", "s": "F"}})).drop("fs")


@query(
    "filter_array",
    """
select doc_id, 'member' as matched from documents where list_contains([lang, source], 'fr')
union all
select doc_id, 'exact' as matched from documents where [lang, source] = ['fr', 'src4']
""",
)
def filter_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("tags"))
    member = docs.filter(equality_filter(docs, {"tags": "fr"})).select("doc_id", F.lit("member").alias("matched"))
    exact = docs.filter(equality_filter(docs, {"tags": ["fr", "src4"]})).select("doc_id", F.lit("exact").alias("matched"))
    return member.unionByName(exact)


ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.') || lpad(cast(millisecond({c}) % 1000 as varchar), 3, '0') || 'Z'"


@query("normalize_iso", f"select event_id, {ISO_SQL.format(c='ts')} as ts from events")
def normalize_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize(table(spark, sf_dir, "events").select("event_id", "ts"))


@query(
    "normalize_nested",
    f"""
select event_id, cast(to_json({{'at': {ISO_SQL.format(c='ts')},
                          'list': [{ISO_SQL.format(c='ts')}, {ISO_SQL.format(c="(ts + interval 1 hour)")}]}}) as varchar) as nested
from events
""",
)
def normalize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(
        "event_id",
        F.struct(F.col("ts").alias("at"), F.array(F.col("ts"), F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("list")).alias("nested"),
    )
    norm = normalize(ev)
    return norm.select("event_id", json_value(F.col("nested"), norm.schema["nested"].dataType).alias("nested"))


# ------------------------------------------------------------------ rendering

CSV_ESC = (
    "case when regexp_matches(coalesce({c}, ''), '[,\"' || chr(10) || ']') "
    "then '\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"' else coalesce({c}, '') end"
)


@query(
    "csv_lines",
    f"""
select row_number() over (order by k, doc_id) as rn, value from (
  select 0 as k, null::bigint as doc_id, 'doc_id,text,lang' as value where exists (select 1 from documents)
  union all
  select 1, doc_id, concat_ws(',', cast(doc_id as varchar), {CSV_ESC.format(c='text')}, {CSV_ESC.format(c='lang')})
  from documents)
""",
)
def csv_lines_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    frame, names, value = csv_frame(docs, [F.col("doc_id")])
    return number_rows(frame.withColumn("value", value), [F.col("__k"), *[F.col(n) for n in names]]).select("rn", "value")


@query(
    "json_lines",
    """
with d as (select doc_id, to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'n_chars': n_chars}) as j from documents),
m as (select min(doc_id) as first_id from d)
select row_number() over (order by k, doc_id) as rn, value from (
  select 1 as k, doc_id, case when doc_id = (select first_id from m) then '[' || j else ',' || j end as value from d
  union all
  select 2, null, case when (select first_id from m) is null then '[]' else ']' end)
""",
)
def json_lines_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    frame, names, value = json_array_frame(docs, [F.col("doc_id")])
    return number_rows(frame.withColumn("value", value), [F.col("__k"), *[F.col(n) for n in names]]).select("rn", "value")


@query("number_text", r"select event_id, regexp_replace(cast(value as varchar), '\.0$', '') as value_text from events")
def number_text_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", number_text(F.col("value"), ev.schema["value"].dataType).alias("value_text"))


EVENT_JSON_SQL = (
    "'{\"event_id\":' || event_id || ',\"ts\":\"' || " + ISO_SQL.format(c="ts") + " || '\",\"user_id\":' || user_id"
    " || ',\"event_type\":' || to_json(event_type) || ',\"value\":' || regexp_replace(cast(value as varchar), '\\.0$', '')"
    " || ',\"props\":' || to_json(props) || '}'"
)


@query(
    "numbered_listing",
    f"select row_number() over (order by event_id) || '. ' || {EVENT_JSON_SQL} as value from events where user_id = 8",
)
def numbered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_report(spark, ReportSpec(tenant=8, source="events", format="pdf"), testdata_registry(sf_dir))
    return listing_lines(plan.rows, plan.order, LISTING_MAX_ROWS)


@query(
    "snapshot_bytes",
    f"select count(*) as rows, cast(sum(octet_length(encode({EVENT_JSON_SQL})) + 1) as bigint) as bytes from events",
)
def snapshot_bytes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ndjson_lines(table(spark, sf_dir, "events"))
    return lines.agg(F.count(F.lit(1)).alias("rows"), snapshot_bytes(lines).alias("bytes"))


@query(
    "snapshot_roundtrip",
    f"select event_id, {ISO_SQL.format(c='ts')} as ts, user_id, event_type, value, props from events",
)
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/snapshots/roundtrip-{uuid.uuid4().hex}"
    schema, _, _ = write_snapshot(table(spark, sf_dir, "events"), path)
    return read_snapshot(spark, path, schema)


@query(
    "content_digest",
    "select doc_id, sha256(text) as digest, octet_length(encode(text)) as bytes from documents",
)
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", sha256_hex(F.col("text")).alias("digest"), utf8_bytes(F.col("text")).cast("long").alias("bytes"))


# ------------------------------------------------------------------ ranges and partials


@query(
    "chunk_ranges",
    CHUNKS_SQL.format(n=32)
    + """
select cast(t.i as integer) as chunk, lo + t.i * size as start_id,
       case when lo + (t.i + 1) * size <= hi then lo + (t.i + 1) * size end as end_id
from s, range(32) t(i) where lo + t.i * size <= hi
""",
)
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges_frame(table(spark, sf_dir, "events"), "event_id", 32)


HEX_SQL = "lpad(lower(to_hex({c})), 24, '0')"


@query(
    "objectid_ranges",
    CHUNKS_SQL.format(n=8)
    + f""",
r as (select cast(t.i as integer) as chunk, lo + t.i * size as st, lo + (t.i + 1) * size as nx, hi
      from s, range(8) t(i) where lo + t.i * size <= hi),
c as (select cast(least((event_id - s.lo) // s.size, 7) as integer) as chunk, count(*) as n_rows from events, s group by 1)
select r.chunk, {HEX_SQL.format(c='st')} as start_id,
       case when nx <= hi then {HEX_SQL.format(c='nx')} end as end_id, coalesce(c.n_rows, 0) as n_rows
from r left join c on r.chunk = c.chunk
""",
)
def objectid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "events").select(F.lpad(F.lower(F.hex("event_id")), 24, "0").alias("_id"))
    lo, hi = read_bounds(ids, "_id")
    ranges = id_ranges(lo, hi, 8, "hex")
    counts = ids.groupBy(chunk_of(ranges, "_id").alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"))
    bounds = spark.createDataFrame([(r.index, r.start, r.end) for r in ranges], "chunk int, start_id string, end_id string")
    return F.broadcast(bounds).join(counts, "chunk", "left").select(
        "chunk", "start_id", "end_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def _event_partials(spark: SparkSession, sf_dir: str, chunks: int = 32) -> DataFrame:
    ev = money(table(spark, sf_dir, "events"), "value")
    _reduced, parts, _profile, _ranges = R.partitioned_reduce(ev, FIVE_OPS, "event_id", chunks)
    return parts


PARTIALS_SQL = (
    CHUNKS_SQL.format(n=32)
    + """
select cast(least((event_id - s.lo) // s.size, 31) as integer) as chunk, event_type, count(*) as n,
       cast(sum(cast(value as decimal(18,2))) as double) as total, min(value) as min_value, max(value) as max_value,
       cast(sum(cast(value as decimal(18,2))) as double) as __avg_sum__avg_value,
       count(value) as __avg_count__avg_value, count(*) as __input_count
from events, s group by 1, 2
"""
)


@query("chunk_partials", PARTIALS_SQL)
def chunk_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_double(_event_partials(spark, sf_dir), "total", "min_value", "max_value", "__avg_sum__avg_value")


@query(
    "chunk_profile",
    f"select chunk, count(*) as groups, cast(sum(__input_count) as bigint) as rows_in from ({PARTIALS_SQL}) group by chunk",
)
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_profile(_event_partials(spark, sf_dir))


@query("partial_merge", FIVE_OPS_SQL)
def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = R.merge_partials(_event_partials(spark, sf_dir), FIVE_OPS)
    return five_ops_doubles(R.report_view(merged, FIVE_OPS))


@query("partial_incremental", FIVE_OPS_SQL)
def partial_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two id halves arrive one after the other; the stored partials absorb each."""
    ev = money(table(spark, sf_dir, "events"), "value")
    lo, hi = read_bounds(ev, "event_id")
    halves = id_ranges(lo, hi, 2)
    stored = None
    for r in halves:
        arrived = R.partials(ev.filter(range_predicate(r, "event_id")), FIVE_OPS)
        stored = R.merge_incremental(stored, arrived, FIVE_OPS)
    return five_ops_doubles(R.report_view(R.merge_partials(stored, FIVE_OPS), FIVE_OPS))


@query("reduce_stream", FIVE_OPS_SQL)
def reduce_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    out = reduce_stream_once(spark, path, schema, FIVE_OPS, prepare=lambda d: money(d, "value"))
    return five_ops_doubles(out)


# ------------------------------------------------------------------ fan-out, workbooks (K4 K6 K7)


def _export_counts(spark: SparkSession, result) -> DataFrame:
    """(entry, n_rows): data rows of every written entry, read back from the files."""
    frames = []
    for entry, path in result.paths.items():
        frames.append(entry_rows(spark, path, entry.rsplit(".", 1)[1]).select(F.lit(entry).alias("entry"), "n_rows"))
    return R.union_partials(frames)


@query(
    "fanout_snapshot",
    """
select 'report.csv' as entry, count(distinct event_type) as n_rows from events where user_id = 8
union all select 'report.json', count(distinct event_type) from events where user_id = 8
union all select 'report.pdf', count(distinct event_type) from events where user_id = 8
""",
)
def fanout_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReportSpec(tenant=8, source="events", format="zip", include_formats=("csv", "json", "pdf"), reduce=FIVE_OPS,
                      report_id=f"fanout-{uuid.uuid4().hex[:8]}")
    result = export(spark, spec, testdata_registry(sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/reports")
    return _export_counts(spark, result)


@query(
    "fanout_multipass",
    """
select 'report.csv' as entry, count(*) as n_rows from orders where o_orderpriority = '1-URGENT'
union all select 'report.json', count(*) from orders where o_orderpriority = '1-URGENT'
union all select 'report.xlsx', count(*) from orders where o_orderpriority = '1-URGENT'
""",
)
def fanout_multipass(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = ReportSpec(tenant="1-URGENT", source="orders", format="zip", include_formats=("csv", "json", "xlsx"),
                      report_id=f"multipass-{uuid.uuid4().hex[:8]}")
    result = export(spark, spec, testdata_registry(sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/reports", multipass=True)
    return _export_counts(spark, result)


@query(
    "workbook_per_group",
    """
select event_type, 0 as part, count(*) as n_rows, cast(min(event_id) as varchar) as first_key, true as starts_pk
from events group by event_type
""",
)
def workbook_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = workbooks(table(spark, sf_dir, "events"), ["event_type"], ["event_id"])
    return books.select("event_type", "part", "n_rows", "first_key",
                        (F.hex(F.substring("content", 1, 2)) == "504B").alias("starts_pk"))


@query(
    "workbook_parts",
    """
select event_type, cast(r // 500 as integer) as part, count(*) as n_rows, cast(min(event_id) as varchar) as first_key,
       true as starts_pk
from (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as r from events)
group by event_type, r // 500
""",
)
def workbook_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks split into parts of 500 rows: every group becomes several files, in id order."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    books = workbooks(ev, ["event_type"], ["event_id"], part_rows=500)
    return books.select("event_type", "part", "n_rows", "first_key",
                        (F.hex(F.substring("content", 1, 2)) == "504B").alias("starts_pk"))


_BOOK_SQL = """
with r as (select event_type, event_id, {iso} as ts, regexp_replace(cast(value as varchar), '\\.0$', '') as value, props,
                  row_number() over (partition by event_type order by event_id) - 1 as r from events),
b as (select event_type || '/' || (r // 500) as book, r % 500 + 2 as row, * from r),
c as (select book, row, unnest([{{'letter': 'A', 'kind': 'n', 'value': cast(event_id as varchar)}}, {{'letter': 'B', 'kind': 's', 'value': ts}},
                                {{'letter': 'C', 'kind': 'n', 'value': value}}, {{'letter': 'D', 'kind': 's', 'value': props}}]) as x from b
      union all
      select book, 1, unnest([{{'letter': 'A', 'kind': 's', 'value': 'event_id'}}, {{'letter': 'B', 'kind': 's', 'value': 'ts'}},
                              {{'letter': 'C', 'kind': 's', 'value': 'value'}}, {{'letter': 'D', 'kind': 's', 'value': 'props'}}]) from (select distinct book from b) t)
select book, cast(row as bigint) as row, x.letter as letter, x.kind as kind, x.value as value from c where x.value is not null
"""


@query("workbook_cells", _BOOK_SQL.format(iso=ISO_SQL.format(c="ts")))
def workbook_cells_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every workbook part (500 rows each), read back from the files' bytes."""
    ev = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value", "props")
    books = workbooks(ev, ["event_type"], ["event_id"], part_rows=500)
    named = books.select(F.concat_ws("/", "event_type", F.col("part").cast("string")).alias("path"), "content")
    return workbook_cells(named).withColumnRenamed("path", "book")


# ------------------------------------------------------------------ workload, retention, saved specs


@query(
    "seed_rows",
    """
select case when event_id % 2 = 0 then 'paid' else 'pending' end as status, count(*) as n,
       cast(sum(event_id % 1000 + 1) as bigint) as total, min('b' || (event_id % 10)) as min_bucket,
       max('b' || (event_id % 10)) as max_bucket
from events group by 1
""",
)
def seed_rows_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seed_from(table(spark, sf_dir, "events"), "event_id")
    spec = ReduceSpec(group_by=("status",), metrics=(Metric("count", "n"), Metric("sum", "total", "amount"),
                                                     Metric("min", "min_bucket", "bucket"), Metric("max", "max_bucket", "bucket")))
    return R.reduce(rows, spec)


@query("retention", "select * from events where ts + interval 20 day > timestamp '2024-01-31'")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained(table(spark, sf_dir, "events"), "ts", 20, _dt.datetime(2024, 1, 31))


# Saved specs: (spec_id, tenant, status or null = all, enabled, next_run_at).
def _request(fmt: str, filters: dict, group_by: list[str], metrics: list[tuple]) -> str:
    return json.dumps({"reportDefinitionId": "saved", "format": fmt, "filters": filters, "reduceSpec": {
        "groupBy": group_by, "metrics": [{"op": op, "as": alias, **({"field": f} if f else {})} for op, alias, f in metrics]}})


_BY_TYPE = ["event_type"], [("count", "n", None), ("max", "last_id", "event_id")]
_WHOLE = [], [("count", "n", None), ("min", "first_id", "event_id"), ("avg", "avg_user", "user_id")]
SAVED_SPECS = [
    (1, 8, _request("csv", {}, *_BY_TYPE), True, _dt.datetime(2024, 1, 1)),
    (2, 8, _request("json", {"event_type": "view"}, *_WHOLE), True, _dt.datetime(2024, 1, 15)),
    (3, 16, _request("csv", {"event_type": "click"}, *_BY_TYPE), True, _dt.datetime(2024, 1, 1)),
    (4, 16, _request("csv", {}, *_BY_TYPE), False, _dt.datetime(2024, 1, 1)),
    (5, 3, _request("csv", {}, *_BY_TYPE), True, _dt.datetime(2030, 1, 1)),
    (6, 143, _request("json", {"event_type": "error"}, ["event_type", "user_id"], [("count", "n", None)]), True, _dt.datetime(2024, 1, 31, 23, 59)),
    (7, 8, _request("csv", {"event_type": 7}, *_BY_TYPE), True, _dt.datetime(2024, 1, 1)),  # another type: no rows
]
SAVED_SPECS_NOW = _dt.datetime(2024, 2, 1)


@query(
    "batch_specs",
    """
select 1 as spec_id, 'csv' as format, '{"event_type":"' || event_type || '","n":' || count(*) || ',"last_id":' || max(event_id) || '}' as row
from events where user_id = 8 group by event_type
union all
select 2, 'json', '{"n":' || count(*) || ',"first_id":' || min(event_id) || ',"avg_user":8}'
from events where user_id = 8 and event_type = 'view' having count(*) > 0
union all
select 3, 'csv', '{"event_type":"' || event_type || '","n":' || count(*) || ',"last_id":' || max(event_id) || '}'
from events where user_id = 16 and event_type = 'click' group by event_type
union all
select 6, 'json', '{"event_type":"' || event_type || '","user_id":' || user_id || ',"n":' || count(*) || '}'
from events where user_id = 143 and event_type = 'error' group by event_type, user_id
""",
)
def batch_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: due specs, each with its own filters, reduce and format, in one aggregation per shape."""
    return run_specs(table(spark, sf_dir, "events"), specs_frame(spark, SAVED_SPECS), SAVED_SPECS_NOW, tenant_col="user_id")


# ------------------------------------------------------------------ one-pass exports and manifests

EVENT_CSV_SQL = (
    "concat_ws(',', cast(event_id as varchar), " + ISO_SQL.format(c="ts") + ", " + CSV_ESC.format(c="event_type")
    + ", regexp_replace(cast(value as varchar), '\\.0$', ''), " + CSV_ESC.format(c="props") + ")"
)


@query(
    "all_tenant_csv",
    f"""
select user_id, count(*) as n_rows,
       cast(sum(octet_length(encode({EVENT_CSV_SQL})) + 1) + {len('event_id,ts,event_type,value,props') + 1} as bigint) as bytes
from events group by user_id
""",
)
def all_tenant_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenant's raw CSV in one sorted pass, one folder per tenant; read back per tenant."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/reports/all-tenants-{uuid.uuid4().hex[:8]}"
    lines = all_tenant_lines(table(spark, sf_dir, "events"), "user_id", [F.col("event_id")], "csv")
    write_all_tenants(lines, "user_id", path)
    back = read_text_folders(spark, path, "user_id")
    return back.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(
        (F.count(F.lit(1)) - F.lit(1)).alias("n_rows"), F.sum(F.octet_length("value") + F.lit(1)).cast("long").alias("bytes"))


ORDER_CSV_SQL = (
    "concat_ws(',', cast(o_orderkey as varchar), cast(o_custkey as varchar), " + CSV_ESC.format(c="o_orderstatus")
    + ", regexp_replace(cast(o_totalprice as varchar), '\\.0$', ''), " + ISO_SQL.format(c="o_orderdate")
    + ", " + CSV_ESC.format(c="o_orderpriority") + ")"
)


@query(
    "manifest_sizes",
    f"""
select count(*) as n_rows,
       cast(sum(octet_length(encode({ORDER_CSV_SQL})) + 1)
            + {len('o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority') + 1} as bigint) as bytes
from orders where o_orderpriority = '2-HIGH'
""",
)
def manifest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9 + K11: export one tenant's CSV, then size its part files from the manifest."""
    spec = ReportSpec(tenant="2-HIGH", source="orders", report_id=f"manifest-{uuid.uuid4().hex[:8]}")
    result = export(spark, spec, testdata_registry(sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/reports")
    files = part_files(spark, result.artifact.key)
    rows = entry_rows(spark, result.artifact.key, "csv")
    return rows.select("n_rows", files.agg(F.sum("length").cast("long")).scalar().alias("bytes"))


@query(
    "report_stream",
    r"""
select 'event_type,n,max_value' as value
union all
select event_type || ',' || count(*) || ',' || regexp_replace(cast(max(value) as varchar), '\.0$', '')
from events where user_id = 8 group by event_type
""",
)
def report_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 + K1: a streaming reduce of one tenant, rendered to its CSV report per trigger."""
    spec = ReportSpec(tenant=8, source="events", report_id=f"stream-{uuid.uuid4().hex[:8]}", reduce=ReduceSpec(
        group_by=("event_type",), metrics=(Metric("count", "n"), Metric("max", "max_value", "value"))))
    base = f"{checkpoint_dir(spark).rstrip('/')}/reports"
    start_report_stream(spark, spec, testdata_registry(sf_dir), base).awaitTermination()
    return spark.read.text(current_report(spark, base, spec))


@query("retention_rewrite", "select * from events where ts + interval 20 day > timestamp '2024-01-31'")
def retention_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 rewrite: the retained rows written to a new table, read back."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/retained-{uuid.uuid4().hex[:8]}"
    apply_retention(table(spark, sf_dir, "events"), "ts", 20, _dt.datetime(2024, 1, 31), target, partition_by=("event_type",))
    back = spark.read.parquet(target)
    return back.select(*table(spark, sf_dir, "events").columns)


@query("clustered_layout", "select * from events")
def clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section 4 layout: the source rewritten clustered by (tenant, id), read back whole."""
    target = f"{checkpoint_dir(spark).rstrip('/')}/clustered-{uuid.uuid4().hex[:8]}"
    write_clustered(table(spark, sf_dir, "events"), "user_id", "event_id", target)
    return spark.read.parquet(target)


# ------------------------------------------------------------------ edges of the operators


@query("tenant_type_bracket", "select * from events where false")
def tenant_type_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant of another type family matches nothing (and is no cast error)."""
    return run(spark, ReportSpec(tenant="08", source="events"), testdata_registry(sf_dir))


@query(
    "hwm_scan_null_ids",
    "select case when o_orderkey % 10 = 0 then null else o_orderkey end as o_orderkey, o_orderstatus from orders where o_orderpriority = '1-URGENT'",
)
def hwm_scan_null_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the bounded re-read keeps rows without an id."""
    plan = plan_report(spark, ReportSpec(tenant="1-URGENT", source="orders"), testdata_registry(sf_dir))
    some = plan.scoped.select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey")).alias("o_orderkey"), "o_orderstatus")
    return bounded(some, plan.source, high_water_id(some, plan.source))


@query(
    "reduce_avg_bigint",
    """
select event_type, cast(sum(cast(9000000000000000000 + event_id as hugeint)) as double) / count(*) as avg_big
from events group by event_type
""",
)
def reduce_avg_bigint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the step sum of an average does not overflow."""
    ev = table(spark, sf_dir, "events").withColumn("big", F.lit(9_000_000_000_000_000_000) + F.col("event_id"))
    return R.reduce(ev, ReduceSpec(group_by=("event_type",), metrics=(Metric("avg", "avg_big", "big"),)))


@query(
    "reduce_ts_key",
    "select date_trunc('millisecond', ts + to_microseconds(event_id % 3000)) as ts, count(*) as n from events group by 1",
)
def reduce_ts_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that print alike are one key."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, (event_id % 3000) / 1000000)"))
    return R.reduce(ev, ReduceSpec(group_by=("ts",), metrics=(Metric("count", "n"),)))


@query(
    "chunk_ranges_large",
    """
with b as (select min(event_id)::hugeint * 100000000000000 + 7 as lo, max(event_id)::hugeint * 100000000000000 + 7 as hi from events),
s as (select lo, hi, (hi - lo + 7) // 7 as size from b)
select cast(least((event_id::hugeint * 100000000000000 + 7 - s.lo) // s.size, 6) as integer) as chunk, count(*) as n_rows
from events, s group by 1
""",
)
def chunk_ranges_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 and A9 over ids near 10^18 and beyond BIGINT: exact range arithmetic."""
    number = F.col("event_id").cast("decimal(20,0)") * F.lit(10**14).cast("decimal(15,0)") + F.lit(7)
    ev = table(spark, sf_dir, "events").select(id_number(number).alias("event_id"))
    ranges = id_ranges(*read_bounds(ev, "event_id"), 7)
    return ev.groupBy(chunk_of(ranges, "event_id").alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("run_stats_hex", """
with b as (select min(event_id) as lo, max(event_id) as hi, count(*) as rows_in, count(distinct event_type) as rows_out from events where user_id = 8),
s as (select *, (hi - lo + 32) // 32 as size from b)
select rows_in, rows_out, cast((hi - lo + size) // size as bigint) as chunks from s
""")
def run_stats_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 over 24-digit hex ids."""
    view = f"events_hex_{uuid.uuid4().hex[:8]}"
    table(spark, sf_dir, "events").withColumn("_id", F.lower(F.lpad(F.hex("event_id"), 24, "0"))).createOrReplaceTempView(view)
    reg = SourceRegistry([Source("hexed", view, "_id", "user_id", format="table", id_kind="hex")])
    spec = ReportSpec(tenant=8, source="hexed", reduce=ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"),)))
    return stats_frame(plan_report(spark, spec, reg))


@query("json_reduce_ties", """
select count(*) as n_lines, cast(sum(case when event_id % 2 = 0 then 1 else 0 end) as bigint) as n_even, 1::bigint as n_open, 1::bigint as n_close
from (select distinct event_type, event_id % 2 as event_id from events)
""")
def json_reduce_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 + O3: keys that the collation equates (a soft hyphen) still give one opening bracket."""
    ev = table(spark, sf_dir, "events").withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("\u00ad"))).otherwise(F.col("event_type")))
    spec = ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"),))
    out = R.reduce(ev, spec)
    frame, _names, value = json_array_frame(out, R.group_order(spec, schema=out.schema))
    lines = frame.select(value.alias("value"))
    return lines.agg((F.count(F.lit(1)) - 1).alias("n_lines"), F.sum(F.col("value").contains("\u00ad").cast("long")).alias("n_even"),
                     F.sum(F.col("value").startswith("[").cast("long")).alias("n_open"), F.sum((F.col("value") == "]").cast("long")).alias("n_close"))


@query("all_tenant_json", """
select case when user_id % 10 = 0 then null else user_id end as user_id, count(*) as n_rows, 1::bigint as n_open, 1::bigint as n_close
from events group by 1
""")
def all_tenant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: every tenant's JSON array, the null tenant's too."""
    ev = table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    lines = all_tenant_lines(ev, "user_id", [F.col("event_id")], "json")
    return lines.groupBy("user_id").agg(
        F.sum((F.col("value") != "]").cast("long")).alias("n_rows"), F.sum(F.col("value").startswith("[").cast("long")).alias("n_open"),
        F.sum((F.col("value") == "]").cast("long")).alias("n_close"))


@query("manifest_digest", """
select sha256(string_agg(line, chr(10) order by k, line) || chr(10)) as digest from (
  select 0 as k, 'o_orderstatus,n,last_key' as line
  union all select 1, o_orderstatus || ',' || count(*) || ',' || max(o_orderkey) from orders where o_orderpriority = '2-HIGH' group by o_orderstatus)
""")
def manifest_digest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content digest of a written report (a report of one block: the plain SHA-256 of its bytes)."""
    spec = ReportSpec(tenant="2-HIGH", source="orders", report_id="digest", reduce=ReduceSpec(
        group_by=("o_orderstatus",), metrics=(Metric("count", "n"), Metric("max", "last_key", "o_orderkey"))))
    result = export(spark, spec, testdata_registry(sf_dir), f"{checkpoint_dir(spark).rstrip('/')}/reports")
    return spark.range(1).select(F.lit(result.artifact.checksum).alias("digest"))
