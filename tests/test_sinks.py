import io
import json
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import read_parts
from tallyspark.sinks.manifest import OPTIONAL_FAILURE, Artifact, manifest_digest, with_policy
from tallyspark.sinks.text import (
    SnapshotTooLarge, check_snapshot_size, csv_lines, json_array_lines, listing_lines, ndjson_lines, write_lines,
)
from tallyspark.sinks.workbook import column_letter, render_workbook, workbooks
from tallyspark.sources.snapshot import read_snapshot, write_snapshot


def test_csv_file_bytes_in_total_order(spark, workdir):
    df = spark.range(0, 5000, numPartitions=7).select(((F.col("id") * 7919) % 5000).alias("id"), F.lit("a,b").alias("s"))
    write_lines(csv_lines(df, [F.col("id")]), f"{workdir}/r.csv")
    text = read_parts(f"{workdir}/r.csv").decode()
    lines = text.split("\n")
    assert lines[0] == "id,s" and lines[-1] == ""
    assert [int(x.split(",")[0]) for x in lines[1:-1]] == list(range(5000))


def test_empty_csv_is_zero_bytes(spark, workdir):
    write_lines(csv_lines(spark.createDataFrame([], "id long"), [F.col("id")]), f"{workdir}/e.csv")
    assert read_parts(f"{workdir}/e.csv") == b""


def test_json_array_file_parses(spark, workdir):
    df = spark.range(0, 300, numPartitions=4).select("id", (F.col("id") % 3).alias("k"))
    write_lines(json_array_lines(df, [F.col("id")]), f"{workdir}/r.json")
    parsed = json.loads(read_parts(f"{workdir}/r.json"))
    assert [d["id"] for d in parsed] == list(range(300))


def test_gzip_compression(spark, workdir):
    df = spark.createDataFrame([(1, "x")], "id long, s string")
    write_lines(csv_lines(df, [F.col("id")]), f"{workdir}/z", compression="zip")
    assert list(Path(f"{workdir}/z").glob("part-*.gz"))
    assert read_parts(f"{workdir}/z") == b"id,s\n1,x\n"


def test_listing_numbers_and_cap(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, s string")
    got = [r.value for r in listing_lines(df, [F.col("id")], 10).collect()]
    assert got == ['1. {"id":1,"s":"a"}', '2. {"id":2,"s":"b"}']
    with pytest.raises(Exception, match="PDF row limit exceeded. max=1"):
        listing_lines(df, [F.col("id")], 1).collect()


def test_snapshot_limit_and_roundtrip(spark, workdir):
    df = spark.createDataFrame([(7, "é", 0.25), (8, None, 1200.0)], "id long, s string, v double")
    want = '{"id":7,"s":"é","v":0.25}\n{"id":8,"s":null,"v":1200}\n'.encode()
    with pytest.raises(SnapshotTooLarge, match=rf"\({len(want) - 1} bytes\)"):
        check_snapshot_size(ndjson_lines(df), len(want) - 1)
    assert check_snapshot_size(ndjson_lines(df), len(want)) == check_snapshot_size(ndjson_lines(df)) == (len(want), 2)
    schema, size, n = write_snapshot(df, f"{workdir}/snap")
    assert (n, size) == (2, len(want))
    back = sorted(tuple(r) for r in read_snapshot(spark, f"{workdir}/snap", schema).collect())
    assert back == [(7, "é", 0.25), (8, None, 1200.0)]


def test_blank_lines_of_ndjson_are_no_rows(spark, workdir):
    Path(f"{workdir}/nd").mkdir()
    Path(f"{workdir}/nd/part-0.json").write_text('\n{"k":"x"}\n\n\n{"k":"y"}\n{"k":null}\n')
    assert [r.k for r in read_snapshot(spark, f"{workdir}/nd", "k string").collect()] == ["x", "y", None]


def test_manifest_does_not_depend_on_the_part_files(spark, workdir, monkeypatch):
    import hashlib

    from tallyspark.sinks import manifest

    df = spark.range(40_000).select("id", F.concat(F.lit("text é "), F.col("id")).alias("s"))
    one, many = f"{workdir}/one", f"{workdir}/many"
    write_lines(csv_lines(df, [F.col("id")]).coalesce(1), one)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        write_lines(csv_lines(df, [F.col("id")]), many)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    data = read_parts(one)
    assert read_parts(many) == data and len(list(Path(many).glob("part-*"))) > 20
    size, digest, files = manifest_digest(spark, one)
    assert size == len(data) == files.agg(F.sum("length")).first()[0]
    assert digest == hashlib.sha256(data).hexdigest()  # one block
    assert manifest_digest(spark, many)[:2] == (size, digest)
    monkeypatch.setattr(manifest, "BLOCK", 1000)
    monkeypatch.setattr(manifest, "RANGE", 7000)
    monkeypatch.setattr(manifest, "FOLD", 10)
    level = [hashlib.sha256(data[i : i + 1000]).digest() for i in range(0, size, 1000)]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 10])).digest() for i in range(0, len(level), 10)]
    assert manifest_digest(spark, one)[1] == manifest_digest(spark, many)[1] == level[0].hex()
    Path(f"{workdir}/none").mkdir()
    write_lines(spark.createDataFrame([], "value string"), f"{workdir}/empty")
    assert manifest_digest(spark, f"{workdir}/empty")[:2] == (0, hashlib.sha256(b"").hexdigest())


def test_policy(spark):
    def boom():
        raise OSError("store down")

    art = with_policy("optional", boom, "t/j/report.csv")
    assert (art.available, art.reason) == (False, OPTIONAL_FAILURE)
    with pytest.raises(OSError):
        with_policy("required", boom, "k")
    assert with_policy("required", lambda: Artifact("filesystem", True), "k").available


def test_workbook_bytes():
    import pandas as pd

    data = render_workbook(["id", "amount"], pd.DataFrame({"id": [1], "amount": [10.0]}))
    assert data[:2] == b"PK"
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="A1" t="inlineStr"><is><t>id</t></is></c>' in sheet and "<v>10</v>" in sheet
    assert [column_letter(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_workbooks_split_a_hot_group(spark):
    # one group holds most rows: it is cut into parts, each rendered separately, in id order
    df = spark.range(0, 2300, numPartitions=5).select(
        F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.lit("cold")).alias("g"), "id", (F.col("id") * 0.5).alias("v"))
    books = workbooks(df, ["g"], ["id"], part_rows=700).select("g", "part", "n_rows", "first_key", "content").collect()
    got = sorted((b.g, b.part, b.n_rows, b.first_key) for b in books)
    assert got == [("cold", 0, 300, "2000"), ("hot", 0, 700, "0"), ("hot", 1, 700, "700"), ("hot", 2, 600, "1400")]
    for b in books:
        sheet = zipfile.ZipFile(io.BytesIO(b.content)).read("xl/worksheets/sheet1.xml")
        assert sheet.count(b"<row ") == b.n_rows + 1


def test_manifest_without_checksum(spark, workdir):
    df = spark.createDataFrame([(1, "x")], "id long, s string")
    write_lines(csv_lines(df, [F.col("id")]), f"{workdir}/nc")
    size, digest, _ = manifest_digest(spark, f"{workdir}/nc", checksum=False)
    assert size == len(b"id,s\n1,x\n") and digest is None


def test_report_path_stays_under_base():
    import pytest as _pytest

    from tallyspark.sinks.text import report_path

    assert report_path("/base/", "t1", "job", "report.csv") == "/base/t1/job/report.csv"
    for tenant, rid in [("../x", "job"), ("t1", "a/b"), ("t1", ".."), ("", "job")]:
        with _pytest.raises(ValueError):
            report_path("/base", tenant, rid, "report.csv")


def test_workbook_cells_for_decimals_and_nested(spark):
    df = spark.createDataFrame([(1, [1, 2], ("x",))], "id long, tags array<int>, doc struct<k:string>") \
        .withColumn("price", F.lit("12.50").cast("decimal(10,2)"))
    book = workbooks(df.withColumn("g", F.lit("all")), ["g"], ["id"], columns=["id", "tags", "doc", "price"]).first()
    sheet = zipfile.ZipFile(io.BytesIO(book.content)).read("xl/worksheets/sheet1.xml").decode()
    assert '<t xml:space="preserve">[1,2]</t>' in sheet and '{"k":"x"}' in sheet.replace("&quot;", '"')
    assert '<c r="D2"><v>12.5</v></c>' in sheet



def test_part_files_follow_their_numbers(spark, workdir):
    from tallyspark.sinks.manifest import part_files

    for i, name in enumerate(["part-100000-a.txt", "part-99999-a.txt", "part-00002-a.txt"]):
        Path(f"{workdir}/{name}").write_text("x" * (i + 1))
    rows = part_files(spark, workdir).orderBy("begins").collect()
    assert [(r.path.rsplit("/", 1)[1], r.begins) for r in rows] == [("part-00002-a.txt", 0), ("part-99999-a.txt", 3), ("part-100000-a.txt", 5)]


def test_groups_never_share_a_workbook_name(spark, workdir):
    from tallyspark.sinks.readback import workbook_cells
    from tallyspark.sinks.workbook import group_name, write_workbooks

    groups = [("a-b", "c"), ("a", "b-c"), (None, "x"), ("None", "x"), ("%null", "x"), ("", ""), ("..", "../../up"), ("a/b", "c"), ("é ü", "~"), ("w" * 300, "x"), ("w" * 300, "y"), ("%2D", "-"), ("A.b", ".")]
    assert len({group_name(g) for g in groups}) == len(groups) and all("/" not in group_name(g) and len(group_name(g)) < 200 for g in groups)
    df = spark.createDataFrame([(*g, i, f"t{i}<&>\n") for i, g in enumerate(groups) for _ in range(2)], "g string, h string, id long, t string")
    for folder in (False, True):
        out = f"{workdir}/in/books{folder}"
        manifest = write_workbooks(df, out, ["g", "h"], ["id"], folder_per_group=folder).collect()
        found = {str(p) for p in Path(f"{workdir}").rglob("*.xlsx") if f"books{folder}" in str(p)}
        assert {m.file for m in manifest} == found and len(found) == len(groups) and all(p.startswith(out) for p in found)
        for m in manifest:
            data = Path(m.file).read_bytes()
            assert (m.n_rows, m.length, m.sha256) == (2, len(data), __import__("hashlib").sha256(data).hexdigest())
        cells = workbook_cells(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)).collect()
        got = sorted((c.row, c.letter, c.kind, c.value) for c in cells)
        assert got == sorted([(1, "A", "s", "id"), (1, "B", "s", "t")] * len(groups) + [(r, *x) for r in (2, 3) for i in range(len(groups)) for x in (("A", "n", str(i)), ("B", "s", f"t{i}<&>\n"))])


def test_a_large_sheet_goes_on_in_a_further_piece(spark, workdir, monkeypatch):
    from tallyspark.sinks import workbook

    rows = [(i, "x" * (200_000 if i == 3 else 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("g", F.lit(1))
    cols, kinds = ["id", "t"], ["n", "s"]
    import pyarrow as pa

    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array([1] * (b - a)), pa.array([0] * (b - a), pa.int32()), pa.array(range(a, b)), pa.array([str(a)] * (b - a)), pa.array([str(i) for i, _ in rows[a:b]]), pa.array([t for _, t in rows[a:b]])], names=["g", "part", "__row", "__first", "c0", "c1"])
    monkeypatch.setattr(workbook, "PIECE_BYTES", 100_000)
    monkeypatch.setattr(workbook, "SLICE_ROWS", 4)
    books = list(workbook._streamed(iter([batch(0, 7), batch(7, 50)]), 1, cols, kinds, lambda k, p, q, f: workbook._Content(["g"], cols, kinds, k, p, q, f)))
    assert [(b.column("part")[0].as_py(), b.column("piece")[0].as_py(), b.column("n_rows")[0].as_py()) for b in books] == [(0, 0, 4), (0, 1, 46)]
    got = workbooks(df, ["g"], ["id"]).collect()  # the small limits travel with the function
    assert [(b.part, b.piece, b.n_rows, b.first_key) for b in got] == [(0, 0, 4, "0"), (0, 1, 46, "4")]
