import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import read_parts
from tallyspark.plans.export import export
from tallyspark.plans.report import plan_report, run
from tallyspark.plans.stats import stats_frame
from tallyspark.sources.registry import Source, SourceRegistry
from tallyspark.spec import Metric, ReduceSpec, ReportSpec, SpecError


@pytest.fixture()
def registry(spark, workdir):
    # FIXTURES 1.1 rows, stored as the default source
    rows = [
        ("0a1b2c3d4e5f60718293a4b0", "t1", "paid", 100.0, "br", dt.datetime(2024, 1, 1)),
        ("0a1b2c3d4e5f60718293a4b1", "t1", "paid", 200.0, "br", dt.datetime(2024, 1, 2)),
        ("0a1b2c3d4e5f60718293a4b2", "t1", "pending", 50.0, "us", dt.datetime(2024, 1, 3)),
        ("0a1b2c3d4e5f60718293a4b3", "t2", "paid", 999.0, "us", dt.datetime(2024, 1, 4)),
    ]
    schema = "_id string, tenantId string, status string, amount double, region string, createdAt timestamp"
    spark.createDataFrame(rows, schema).write.parquet(f"{workdir}/src")
    return SourceRegistry([Source("reportSource", f"{workdir}/src", "_id", "tenantId", id_kind="hex")])


def test_raw_csv_export(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", filters={"status": "paid"}, report_id="job1")
    res = export(spark, spec, registry, f"{workdir}/out")
    text = read_parts(res.paths["report.csv"]).decode()
    assert text.splitlines() == [
        "_id,tenantId,status,amount,region,createdAt",
        "0a1b2c3d4e5f60718293a4b0,t1,paid,100,br,2024-01-01T00:00:00.000Z",
        "0a1b2c3d4e5f60718293a4b1,t1,paid,200,br,2024-01-02T00:00:00.000Z",
    ]
    assert (res.stats.rows_in, res.stats.rows_out, res.stats.mode) == (2, 2, "raw")
    assert res.artifact.available and res.artifact.size_bytes == len(text.encode()) and len(res.artifact.checksum) == 64


def test_reduce_export_stats(spark, registry, workdir):
    # flags-flow: paid rows reduced by status -> rowsIn 2, rowsOut 1
    spec = ReportSpec(tenant="t1", filters={"status": "paid"}, report_id="job2",
                      reduce=ReduceSpec(group_by=("status",), metrics=(Metric("count", "totalOrders"), Metric("sum", "total", "amount"))))
    res = export(spark, spec, registry, f"{workdir}/out")
    text = read_parts(res.paths["report.csv"]).decode()
    assert text == "status,totalOrders,total\npaid,2,300\n"
    assert (res.stats.rows_in, res.stats.rows_out, res.stats.mode) == (2, 1, "reduce")
    assert res.stats.chunks == 2  # two ids -> ranges of one id each
    prof = export(spark, spec, registry, f"{workdir}/out2", chunk_profile=True).stats.extra["chunk_profile"]
    assert [(p["chunk"], p["groups"], p["rows_in"]) for p in prof] == [(0, 1, 1), (1, 1, 1)]


def test_zip_snapshot_and_multipass(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", filters={"status": "paid"}, format="zip", include_formats=("csv", "json"), report_id="job3")
    snap = export(spark, spec, registry, f"{workdir}/out")
    assert snap.stats.zip_strategy == "snapshot" and snap.artifact.entries == ["report.csv", "report.json"]
    assert (snap.stats.rows_in, snap.stats.rows_out) == (2, 2)
    parsed = json.loads(read_parts(snap.paths["report.json"]))
    assert [d["amount"] for d in parsed] == [100, 200]
    spec4 = ReportSpec(tenant="t1", format="zip", include_formats=("json", "csv"), report_id="job4")
    multi = export(spark, spec4, registry, f"{workdir}/out", multipass=True)
    assert multi.stats.zip_strategy == "multipass" and (multi.stats.rows_in, multi.stats.rows_out) == (3, 3)
    assert read_parts(multi.paths["report.csv"]).decode().count("\n") == 4


def test_pdf_listing_cap_fails_the_run(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", format="pdf", report_id="job5")
    with pytest.raises(Exception, match="PDF row limit exceeded"):
        export(spark, spec, registry, f"{workdir}/out", listing_max_rows=2)
    ok = export(spark, spec, registry, f"{workdir}/out", listing_max_rows=3)
    lines = read_parts(ok.paths["report.pdf"]).decode().splitlines()
    assert [l.split(". ", 1)[0] for l in lines] == ["1", "2", "3"] and ok.stats.rows_out == 3


def test_xlsx_export_and_optional_failure(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", format="xlsx", report_id="job6")
    res = export(spark, spec, registry, f"{workdir}/out")
    files = list(Path(res.paths["report.xlsx"]).glob("*.xlsx"))
    assert len(files) == 1 and files[0].read_bytes()[:2] == b"PK" and res.stats.rows_out == 3
    bad = ReportSpec(tenant="t1", format="csv", report_id="job7")
    blocked = Path(f"{workdir}/blocked")
    blocked.write_text("a file where a folder should be")
    art = export(spark, bad, registry, f"{blocked}/x", policy="optional").artifact
    assert not art.available and art.reason == "OPTIONAL_INTEGRATION_FAILURE"


def test_noop_mode(spark, registry, workdir):
    res = export(spark, ReportSpec(tenant="t1", report_id="job8"), registry, f"{workdir}/out", noop=True)
    assert res.artifact.mode == "noop" and res.artifact.size_bytes > 0
    assert (res.stats.rows_in, res.stats.rows_out) == (3, 3) and len(res.artifact.checksum) == 64
    assert not Path(f"{workdir}/out/t1/job8").exists()


def test_gzip_compressed_single_format(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", compression="zip", report_id="job9")
    res = export(spark, spec, registry, f"{workdir}/out")
    assert res.artifact.entries == ["report.csv"]
    assert read_parts(res.paths["report.csv"]).decode().count("\n") == 4


def test_group_cap_in_export(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", report_id="job10", reduce=ReduceSpec(group_by=("status",), metrics=(Metric("count", "n"),)))
    with pytest.raises(Exception, match="REPORT_REDUCE_MAX_GROUPS"):
        export(spark, spec, registry, f"{workdir}/out", max_groups=1)


def test_allowlist_and_tenant_filter(spark, registry):
    with pytest.raises(SpecError, match="'orders' is not allowed"):
        run(spark, ReportSpec(tenant="t1", source="orders"), registry)
    with pytest.raises(SpecError, match="scope column"):
        run(spark, ReportSpec(tenant="t1", filters={"tenantId": "t2"}), registry)


def test_stats_frame(spark, registry):
    plan = plan_report(spark, ReportSpec(tenant="t1", reduce=ReduceSpec(group_by=("region",), metrics=(Metric("count", "n"),))), registry)
    # hex ids: the lazy frame covers BIGINT ids only; rows in/out still hold
    r = stats_frame(plan.__class__(plan.spec, plan.source, plan.scoped, plan.rows, plan.order, "raw")).first()
    assert (r.rows_in, r.rows_out) == (3, 3)


def test_cli_runs_a_request(spark, workdir):
    from tallyspark.cli import main, parse_source

    src = parse_source("orders=/data/o:_id:tenantId:hex")
    assert (src.name, src.path, src.id_col, src.tenant_col, src.id_kind) == ("orders", "/data/o", "_id", "tenantId", "hex")
    spark.createDataFrame([(1, "t1", "paid", 5.0), (2, "t1", "paid", 7.0)], "id long, tenant string, status string, amount double") \
        .write.parquet(f"{workdir}/cli_src")
    req = {"reportDefinitionId": "r1", "format": "json",
           "reduceSpec": {"groupBy": ["status"], "metrics": [{"op": "sum", "field": "amount", "as": "total"}]}}
    Path(f"{workdir}/req.json").write_text(json.dumps(req))
    assert main(["--request", f"{workdir}/req.json", "--tenant", "t1", "--source", f"src={workdir}/cli_src:id:tenant",
                 "--out", f"{workdir}/cli_out"]) == 0
    (run_dir,) = Path(f"{workdir}/cli_out/t1/r1").iterdir()
    assert json.loads(read_parts(f"{run_dir}/report.json")) == [{"status": "paid", "total": 12}]


def test_raw_json_export(spark, registry, workdir):
    res = export(spark, ReportSpec(tenant="t1", format="json", report_id="jj"), registry, f"{workdir}/out")
    parsed = json.loads(read_parts(res.paths["report.json"]))
    assert [d["status"] for d in parsed] == ["paid", "paid", "pending"]
    assert parsed[0]["createdAt"] == "2024-01-01T00:00:00.000Z" and parsed[0]["amount"] == 100
    assert (res.stats.rows_in, res.stats.rows_out) == (3, 3)


def test_reduce_json_and_listing_in_group_order(spark, registry, workdir):
    spec = ReportSpec(tenant="t1", format="zip", include_formats=("json", "pdf", "xlsx"), report_id="rj",
                      reduce=ReduceSpec(group_by=("region", "status"), metrics=(Metric("count", "n"), Metric("avg", "a", "amount"))))
    res = export(spark, spec, registry, f"{workdir}/out")
    parsed = json.loads(read_parts(res.paths["report.json"]))
    assert parsed == [{"region": "br", "status": "paid", "n": 2, "a": 150}, {"region": "us", "status": "pending", "n": 1, "a": 50}]
    listing = read_parts(res.paths["report.pdf"]).decode().splitlines()
    assert listing == ['1. {"region":"br","status":"paid","n":2,"a":150}', '2. {"region":"us","status":"pending","n":1,"a":50}']
    assert (res.stats.rows_in, res.stats.rows_out, res.stats.zip_strategy) == (3, 2, "snapshot")
    assert len(list(Path(res.paths["report.xlsx"]).glob("*.xlsx"))) == 1


def test_ndjson_source_with_fixed_schema(spark, workdir):
    Path(f"{workdir}/src.json").mkdir()
    Path(f"{workdir}/src.json/part-0.json").write_text(
        '{"_id":"0a1b2c3d4e5f60718293a4b0","tenantId":"t1","status":"paid","amount":100}\n'
        '\n{"_id":"0a1b2c3d4e5f60718293a4b1","tenantId":"t1","status":"paid","amount":200.5}\n')
    src = Source("docs", f"{workdir}/src.json", "_id", "tenantId", format="json", id_kind="hex",
                 schema="_id string, tenantId string, status string, amount double")
    reg = SourceRegistry([src])
    spec = ReportSpec(tenant="t1", source="docs", reduce=ReduceSpec(group_by=("status",), metrics=(Metric("sum", "total", "amount"),)))
    assert [tuple(r) for r in run(spark, spec, reg).collect()] == [("paid", 300.5)]


def test_empty_report_in_every_format(spark, registry, workdir):
    import io
    import zipfile

    spec = ReportSpec(tenant="nobody", format="zip", include_formats=("csv", "json", "pdf", "xlsx"), report_id="empty")
    res = export(spark, spec, registry, f"{workdir}/out")
    root = res.artifact.key
    assert read_parts(f"{root}/report.csv") == b"" and read_parts(f"{root}/report.pdf") == b""
    assert json.loads(read_parts(f"{root}/report.json")) == []
    books = list(Path(f"{root}/report.xlsx").glob("*.xlsx"))
    assert len(books) == 1
    sheet = zipfile.ZipFile(io.BytesIO(books[0].read_bytes())).read("xl/worksheets/sheet1.xml")
    assert b"<row" not in sheet
    assert (res.stats.rows_in, res.stats.rows_out) == (0, 0)
    single = export(spark, ReportSpec(tenant="nobody", report_id="empty1"), registry, f"{workdir}/out")
    assert read_parts(single.paths["report.csv"]) == b"" and single.artifact.size_bytes == 0


def test_wide_schema_in_every_format(spark, workdir):
    import datetime as _dt
    import decimal as _dec
    import io
    import zipfile

    schema = ("_id string, tenantId string, flag boolean, price decimal(10,2), day date, at timestamp, "
              "tags array<string>, doc struct<k:string,n:double>, attrs map<string,int>, blob binary")
    rows = [("0a1b2c3d4e5f60718293a4b0", "w", True, _dec.Decimal("1.50"), _dt.date(2024, 1, 2), _dt.datetime(2024, 1, 2, 3, 4, 5),
             ["a", "b,c"], ("x", 2.0), {"q": 1}, b"\x00\x01"),
            ("0a1b2c3d4e5f60718293a4b1", "w", None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(f"{workdir}/wide")
    reg = SourceRegistry([Source("wide", f"{workdir}/wide", "_id", "tenantId", id_kind="hex")])
    spec = ReportSpec(tenant="w", source="wide", format="zip", include_formats=("csv", "json", "pdf", "xlsx"), report_id="wide")
    res = export(spark, spec, reg, f"{workdir}/out")
    root = res.artifact.key
    parsed = json.loads(read_parts(f"{root}/report.json"))
    assert parsed[0]["price"] == 1.5 and parsed[0]["day"] == "2024-01-02T00:00:00.000Z"
    assert parsed[0]["doc"] == {"k": "x", "n": 2} and parsed[0]["attrs"] == {"q": 1} and parsed[0]["tags"] == ["a", "b,c"]
    assert parsed[1]["tags"] is None and parsed[1]["flag"] is None
    csv_text = read_parts(f"{root}/report.csv").decode()
    assert '"[""a"",""b,c""]"' in csv_text and ",1.5," in csv_text
    assert read_parts(f"{root}/report.pdf").decode().startswith("1. {")
    book = next(Path(f"{root}/report.xlsx").glob("*.xlsx")).read_bytes()
    sheet = zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    assert "AAE=" in sheet and 't="b"' in sheet and res.stats.rows_out == 2


def test_json_with_identical_rows_has_one_opening_bracket(spark, workdir):
    rows = [(1, "t", "x"), (1, "t", "x"), (0, "t", "y"), (0, "t", "y")]  # exact duplicates tie on (id, row hash)
    spark.createDataFrame(rows, "k long, tenant string, v string").write.parquet(f"{workdir}/dups")
    reg = SourceRegistry([Source("d", f"{workdir}/dups", "k", "tenant", unique_id=False)])
    res = export(spark, ReportSpec(tenant="t", source="d", format="json", report_id="dups"), reg, f"{workdir}/out")
    text = read_parts(res.paths["report.json"]).decode()
    assert text.count("[") == 1
    assert json.loads(text) == [{"k": 0, "tenant": "t", "v": "y"}] * 2 + [{"k": 1, "tenant": "t", "v": "x"}] * 2


def test_runs_of_one_definition_do_not_see_each_other(spark, registry, workdir):
    whole = ReportSpec(tenant="t1", format="zip", include_formats=("csv", "json"), report_id="again")
    first = export(spark, whole, registry, f"{workdir}/out")
    second = export(spark, ReportSpec(tenant="t1", format="zip", include_formats=("csv",), report_id="again"), registry, f"{workdir}/out")
    assert first.artifact.key != second.artifact.key
    assert Path(first.paths["report.json"]).exists() and not Path(f"{second.artifact.key}/report.json").exists()
    assert second.artifact.size_bytes == len(read_parts(second.paths["report.csv"]))


def test_snapshot_limit_is_an_error_under_either_policy_and_nothing_stays(spark, registry, workdir):
    from tallyspark.session import checkpoint_dir
    from tallyspark.sinks.text import SnapshotTooLarge

    spec = ReportSpec(tenant="t1", format="zip", include_formats=("csv",), report_id="limit")
    with pytest.raises(SnapshotTooLarge):
        export(spark, spec, registry, f"{workdir}/out", policy="optional", snapshot_max_bytes=10, run_id="limited")
    ok = export(spark, spec, registry, f"{workdir}/out", policy="optional", run_id="unlimited")
    assert ok.artifact.available
    for run_id in ("limited", "unlimited"):
        assert not Path(f"{checkpoint_dir(spark)}/snapshots/{run_id}".removeprefix("file:")).exists()


@pytest.mark.parametrize("kw", [{"format": "csv"}, {"format": "json"}, {"format": "pdf"}, {"format": "csv", "compression": "zip"},
                                {"format": "zip", "include_formats": ("csv", "json")}])
def test_dry_run_has_the_real_size_and_digest(spark, registry, workdir, kw):
    spec = ReportSpec(tenant="t1", report_id="dry", **kw)
    real = export(spark, spec, registry, f"{workdir}/out").artifact
    dry = export(spark, spec, registry, f"{workdir}/dry", noop=True)
    assert (dry.artifact.size_bytes, dry.artifact.checksum) == (real.size_bytes, real.checksum)
    assert not Path(f"{workdir}/dry").exists() and dry.paths == {}


def test_no_limit_unless_asked(spark, workdir):
    spark.range(10_001).withColumn("tenant", F.lit("t")).write.parquet(f"{workdir}/many")
    reg = SourceRegistry([Source("many", f"{workdir}/many", "id", "tenant")])
    res = export(spark, ReportSpec(tenant="t", source="many", format="pdf"), reg, f"{workdir}/out")
    assert res.stats.rows_out == 10_001 and read_parts(res.paths["report.pdf"]).count(b"\n") == 10_001
    spark.range(600_000).withColumn("tenant", F.lit("t")).write.parquet(f"{workdir}/groups")
    reg = SourceRegistry([Source("groups", f"{workdir}/groups", "id", "tenant")])
    spec = ReportSpec(tenant="t", source="groups", reduce=ReduceSpec(group_by=("id",), metrics=(Metric("count", "n"),)))
    assert export(spark, spec, reg, f"{workdir}/out", checksum=False).stats.rows_out == 600_000


def test_declared_unique_ids_that_repeat_still_give_json(spark, workdir):
    spark.createDataFrame([(1, "t", "a"), (1, "t", "b"), (2, "t", "c")], "k long, tenant string, v string").write.parquet(f"{workdir}/lie")
    reg = SourceRegistry([Source("d", f"{workdir}/lie", "k", "tenant")])
    res = export(spark, ReportSpec(tenant="t", source="d", format="json"), reg, f"{workdir}/out")
    assert [r["k"] for r in json.loads(read_parts(res.paths["report.json"]))] == [1, 1, 2]
    assert res.stats.rows_out == 3


def test_workbook_grouped_by_a_date_in_spark_order(spark):
    import io
    import zipfile

    from tallyspark.sinks.workbook import workbooks

    t0 = dt.datetime(2024, 5, 1)
    rows = [(dt.date(2024, 5, 1), t0 + dt.timedelta(microseconds=m), x) for m, x in ((30, 3.0), (10, None), (20, float("nan")))]
    df = spark.createDataFrame(rows, "day date, at timestamp, x double")
    got = workbooks(df, ["day"], [F.col("at")]).collect()
    sheet = zipfile.ZipFile(io.BytesIO(bytes(got[0].content))).read("xl/worksheets/sheet1.xml").decode()
    assert got[0].day == dt.date(2024, 5, 1) and got[0].n_rows == 3 and sheet.index('r="B4"') < sheet.index("<v>3</v>")
    keys = workbooks(df.withColumn("g", F.lit(1)), ["g"], [F.col("x")], part_rows=1).orderBy("part").collect()
    assert [k.first_key for k in keys] == [None, "3.0", "NaN"]


def test_csv_rows_with_quoted_newlines_are_counted_whole(spark, workdir):
    from tallyspark.sinks.readback import entry_rows
    from tallyspark.sinks.text import csv_lines, write_lines

    df = spark.createDataFrame([(1, 'a\n"b"\nc'), (2, ""), (3, "x")], "id long, t string")
    write_lines(csv_lines(df, [F.col("id")]), f"{workdir}/q")
    assert entry_rows(spark, f"{workdir}/q", "csv").first().n_rows == 3


def test_passes_read_one_version_of_the_source(spark, workdir, monkeypatch):
    import os

    from tallyspark.plans import export as module
    from tallyspark.sources.registry import SourceChanged

    spark.range(100, 200).selectExpr("id as k", "'t' as tenant").coalesce(1).write.parquet(f"{workdir}/src")
    reg = SourceRegistry([Source("d", f"{workdir}/src", "k", "tenant")])
    spec = ReportSpec(tenant="t", source="d", format="zip", include_formats=("csv", "json", "pdf"))
    plain, done = module.write_format, []

    def then(change):
        def write(*args, **kwargs):
            plain(*args, **kwargs)
            if not done:
                change()
            done.append(1)
        monkeypatch.setattr(module, "write_format", write)
        done.clear()

    then(lambda: spark.range(0, 50).selectExpr("id as k", "'t' as tenant").coalesce(1).write.mode("append").parquet(f"{workdir}/src"))
    res = export(spark, spec, reg, f"{workdir}/out", multipass=True)
    assert res.stats.rows_out == 100 and len(json.loads(read_parts(res.paths["report.json"]))) == 100
    assert read_parts(res.paths["report.csv"]).decode().count("\n") == 101 and read_parts(res.paths["report.pdf"]).decode().count("\n") == 100

    def replace():
        part = next(p for p in Path(f"{workdir}/src").glob("*.parquet"))
        os.utime(part, (1, 1))

    then(replace)
    with pytest.raises(SourceChanged):
        export(spark, spec, reg, f"{workdir}/out", multipass=True)
