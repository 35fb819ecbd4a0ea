import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["event_type", "n", "total", "avg_value"]
    assert sum(r.n for r in rows) == spark.read.parquet(f"{entry.FLAGSHIP_DIR}/events.parquet").filter("user_id = 8").count()


def test_every_query_named_and_oracles_are_a_subset():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 40
    assert set(sql) <= set(qs)


def test_queries_run_at_smoke_scale(spark):
    # every registered query builds and runs on the smallest tables
    for name, fn in entry.queries().items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name
