"""The sink of many groups' text reports (L2)."""

import os

import pytest
from conftest import read_parts
from pyspark.sql import functions as F

from tallyspark.sinks import folders

ODD = ["plain", "a b", "a/b", "a=b:c", "50%", "[x]{y}^?*#'\"\\", "tab\there", "é", "..x", None, ""]


def test_folders_and_bytes_are_those_of_sparks_writer(spark, workdir):
    rows = [(t, i, None if i == 1 else f"{t} line {i} é") for t in ODD for i in range(3)]
    lines = spark.createDataFrame(rows, "`the tenant` string, i int, value string").sort("the tenant", "i").select("the tenant", "value")
    folders.write_text_folders(lines, "the tenant", f"{workdir}/ours")
    lines.write.partitionBy("the tenant").text(f"{workdir}/spark")
    found = {d for d in os.listdir(f"{workdir}/ours") if "=" in d}
    assert found == {d for d in os.listdir(f"{workdir}/spark") if "=" in d} and len(found) == len(ODD) - 1
    for d in found:
        ours, theirs = (read_parts(f"{workdir}/{w}/{d}").decode().splitlines() for w in ("ours", "spark"))
        assert sorted(ours) == sorted(theirs), d
    assert os.path.exists(f"{workdir}/ours/_SUCCESS")
    folders.write_text_folders(lines.where("`the tenant` = 'plain'"), "the tenant", f"{workdir}/ours")  # replaces all
    assert [d for d in os.listdir(f"{workdir}/ours") if "=" in d] == ["the tenant=plain"]


def test_a_group_across_batches_and_unsorted_rows_lose_nothing(spark, workdir):
    lines = spark.range(0, 30_000, numPartitions=3).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("value"))
    folders.write_text_folders(lines.sort("g", F.col("value").cast("long")), "g", f"{workdir}/sorted")
    assert read_parts(f"{workdir}/sorted/g=1").decode() == "".join(f"{i}\n" for i in range(1, 30_000, 2))
    folders.write_text_folders(lines.where("id < 60"), "g", f"{workdir}/mixed")
    assert sorted(map(int, read_parts(f"{workdir}/mixed/g=0").split())) == list(range(0, 60, 2))


def test_lines_read_back_are_sparks(spark, workdir, monkeypatch):
    monkeypatch.setattr(folders, "BLOCK", 7)
    rows = [(t, i, ["one", "two\rthree", "four\r\nfive\nsix", "", "é" * 9, None][i]) for t in ODD for i in range(6)]
    lines = spark.createDataFrame(rows, "t string, i int, value string").sort("t", "i").select("t", "value")
    folders.write_text_folders(lines, "t", f"{workdir}/out")
    ours = folders.read_text_folders(spark, f"{workdir}/out", "t")
    theirs = spark.read.schema("value string, t string").text(f"{workdir}/out").select("t", "value")
    assert ours.count() == len(ODD) * 9 and sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    folders.write_text_folders(lines.limit(0), "t", f"{workdir}/none")
    assert folders.read_text_folders(spark, f"{workdir}/none", "t").collect() == []


def test_a_failed_write_leaves_nothing(spark, workdir):
    lines = spark.range(10).select(F.col("id").alias("g"), F.when(F.col("id") == 9, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(Exception, match="no"):
        folders.write_text_folders(lines, "g", f"{workdir}/failed")
    assert not os.path.exists(f"{workdir}/failed")


def test_all_tenant_csv_starts_no_process_per_tenant(spark, workdir):
    """Hadoop's local file system leaves a checksum file (and starts three processes) per folder."""
    from tallyspark.catalog import ORACLE_SQL, QUERIES
    from tallyspark.plans.batch import all_tenant_lines, write_all_tenants

    spark.sql("select id as event_id, timestamp_ntz'2024-01-01' as ts, if(id % 4 = 0, null, id % 4) as user_id, 'a,b' as event_type, 1.5d as value, "
              "cast(null as string) as props from range(40)").write.parquet(f"{workdir}/events.parquet")
    write_all_tenants(all_tenant_lines(spark.read.parquet(f"{workdir}/events.parquet"), "user_id", [F.col("event_id")]), "user_id", f"{workdir}/out")
    names = [f for d, _, fs in os.walk(f"{workdir}/out") for f in fs if "=" in d]
    assert len(names) == 4 and not any(f.endswith(".crc") for f in names)
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view events as from '{workdir}/events.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, QUERIES["all_tenant_csv"](spark, workdir).collect()))) == sorted(map(str, con.sql(ORACLE_SQL["all_tenant_csv"]).fetchall()))
