import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import reduce as R
from tallyspark.operators.ordering import number_rows
from tallyspark.spec import INPUT_COUNT, Metric, ReduceSpec, SpecError


@pytest.fixture(scope="module")
def sales(spark):
    # FIXTURES 1.1: three seeded rows of the end-to-end tests
    return spark.createDataFrame(
        [("65e5b6f1de74f57fcb0f97a6", "t1", "paid", 100.0, "br"),
         ("65e5b6f1de74f57fcb0f97a7", "t1", "paid", 200.0, "br"),
         ("65e5b6f1de74f57fcb0f97a8", "t1", "pending", 50.0, "us")],
        "_id string, tenantId string, status string, amount double, region string",
    )


def test_paid_rows_reduce(sales):
    spec = ReduceSpec(group_by=("status",), metrics=(Metric("count", "totalOrders"), Metric("sum", "total", "amount")))
    reduced = R.reduce_frame(sales.filter(F.col("status") == "paid"), spec)
    row = reduced.first()
    assert (row.status, row.totalOrders, row.total, row[INPUT_COUNT]) == ("paid", 2, 300.0, 2)
    assert R.report_view(reduced, spec).columns == ["status", "totalOrders", "total"]


def test_five_ops(sales):
    spec = ReduceSpec(group_by=("region",), metrics=(
        Metric("count", "n"), Metric("sum", "s", "amount"), Metric("min", "lo", "amount"),
        Metric("max", "hi", "amount"), Metric("avg", "mean", "amount")))
    got = {r.region: r for r in R.reduce(sales, spec).collect()}
    assert (got["br"].n, got["br"].s, got["br"].lo, got["br"].hi, got["br"].mean) == (2, 300.0, 100.0, 200.0, 150.0)
    assert (got["us"].n, got["us"].mean) == (1, 50.0)


def test_all_null_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("sum", "s", "v"), Metric("min", "lo", "v"),
                                                Metric("max", "hi", "v"), Metric("avg", "m", "v"), Metric("count", "n")))
    got = {r.g: r for r in R.reduce(df, spec).collect()}
    assert (got["b"].s, got["b"].lo, got["b"].hi, got["b"].m, got["b"].n) == (0.0, None, None, None, 1)
    assert got["a"].m == 1.0  # nulls are not counted in the average


def test_true_min_max_when_first_chunk_is_null(spark):
    # A null partial in the first chunk must not freeze the result at null
    df = spark.createDataFrame([(1, "g", None), (2, "g", 5.0), (3, "g", 3.0)], "id long, g string, v double")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("min", "lo", "v"), Metric("max", "hi", "v")))
    parts = R.partials(df, spec, chunk=F.col("id"))
    merged = R.merge_partials(parts, spec).first()
    assert (merged.lo, merged.hi) == (3.0, 5.0)


def test_nan_and_null_keys_share_a_group(spark):
    df = spark.createDataFrame([(float("nan"), 1.0), (None, 2.0), (float("inf"), 3.0), (1.0, 4.0)], "k double, v double")
    spec = ReduceSpec(group_by=("k",), metrics=(Metric("count", "n"),))
    got = {(None if r.k is None else r.k): r.n for r in R.reduce(df, spec).collect()}
    assert got == {None: 3, 1.0: 1}


def test_nan_never_wins_min_max(spark):
    df = spark.createDataFrame([("g", float("nan")), ("g", 2.0), ("g", 1.0)], "g string, v double")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("min", "lo", "v"), Metric("max", "hi", "v")))
    r = R.reduce(df, spec).first()
    assert (r.lo, r.hi) == (1.0, 2.0)


def test_non_finite_sum_is_an_error(spark):
    df = spark.createDataFrame([("g", float("inf")), ("g", 2.0)], "g string, v double")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("sum", "s", "v"),))
    with pytest.raises(Exception, match="Non numeric value"):
        R.reduce(df, spec).collect()


def test_global_reduce_empty_gives_no_row(spark):
    df = spark.createDataFrame([], "g string, v double")
    spec = ReduceSpec(metrics=(Metric("count", "n"), Metric("sum", "s", "v")))
    assert R.reduce(df, spec).count() == 0
    one = spark.createDataFrame([("a", 2.0)], "g string, v double")
    assert R.reduce(one, spec).collect() == [Row(n=1, s=2.0)]


def test_integer_sum_stays_integral_and_decimal_exact(spark):
    df = spark.createDataFrame([(1, 2**40), (1, 2**40)], "g int, v long")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("sum", "s", "v"),))
    out = R.reduce(df, spec)
    assert out.schema["s"].dataType == T.LongType() and out.first().s == 2**41
    dec = spark.createDataFrame([(1, "0.10"), (1, "0.20")], "g int, v string").withColumn("v", F.col("v").cast("decimal(10,2)"))
    r = R.reduce(dec, spec).first()
    assert str(r.s) == "0.30"


def test_unknown_column_and_text_avg_rejected(sales):
    with pytest.raises(SpecError, match="Unknown groupBy field"):
        R.reduce(sales, ReduceSpec(group_by=("nope",), metrics=(Metric("count", "n"),)))
    with pytest.raises(SpecError, match="avg needs a numeric field"):
        R.reduce(sales, ReduceSpec(metrics=(Metric("avg", "a", "region"),)))


def test_sum_of_text_is_zero(sales):
    r = R.reduce(sales, ReduceSpec(metrics=(Metric("sum", "s", "region"),))).first()
    assert r.s == 0


def test_partial_merge_matches_fixture(spark):
    # FIXTURES 1.3: three partial rows with the keys in an _id struct
    schema = ("_id struct<region:string>, orders long, totalAmount double, minAmount double, maxAmount double, "
              "__avg_sum__avgAmount double, __avg_count__avgAmount long, __input_count long")
    parts = spark.createDataFrame([
        (("us",), 2, 30.0, 10.0, 20.0, 30.0, 2, 2),
        (("us",), 1, 15.0, 15.0, 15.0, 15.0, 1, 1),
        (("br",), 1, 5.0, 5.0, 5.0, 5.0, 1, 1),
    ], schema)
    spec = ReduceSpec(group_by=("region",), metrics=(
        Metric("count", "orders"), Metric("sum", "totalAmount", "amount"), Metric("min", "minAmount", "amount"),
        Metric("max", "maxAmount", "amount"), Metric("avg", "avgAmount", "amount")))
    merged = R.merge_partials(parts, spec)
    ordered = R.report_view(R.ordered(merged, spec), spec).collect()
    assert [tuple(r) for r in ordered] == [("br", 1, 5.0, 5.0, 5.0, 5.0), ("us", 3, 45.0, 10.0, 20.0, 15.0)]
    totals = merged.agg(F.sum(INPUT_COUNT).alias("i"), F.count(F.lit(1)).alias("o")).first()
    assert (totals.i, totals.o) == (4, 2)


def test_incremental_merge_equals_direct(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") * 1.5).alias("v"), "id")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("count", "n"), Metric("sum", "s", "v"), Metric("min", "lo", "v"),
                                                Metric("max", "hi", "v"), Metric("avg", "m", "v")))
    stored = None
    for lo in range(0, 1000, 250):
        stored = R.merge_incremental(stored, R.partials(df.filter((F.col("id") >= lo) & (F.col("id") < lo + 250)), spec), spec)
    inc = sorted(tuple(r) for r in R.report_view(R.merge_partials(stored, spec), spec).collect())
    direct = sorted(tuple(r) for r in R.reduce(df, spec).collect())
    assert inc == direct


def test_group_cap(spark):
    df = spark.createDataFrame([("a",), ("b",)], "g string")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("count", "n"),))
    assert R.enforce_group_cap(R.reduce_frame(df, spec), 2).count() == 2
    with pytest.raises(R.GroupCapExceeded, match=r"REPORT_REDUCE_MAX_GROUPS \(1\)"):
        R.enforce_group_cap(R.reduce_frame(df, spec), 1)


def test_group_order_like_locale_compare(spark):
    df = spark.createDataFrame([("B",), ("a",), (None,), ("b",), ("A",), ("10",), ("9",)], "k string")
    spec = ReduceSpec(group_by=("k",), metrics=(Metric("count", "n"),))
    got = [r.k for r in R.ordered(R.reduce(df, spec), spec).collect()]
    assert got == ["10", "9", "a", "A", "b", "B", None]
    numbered = number_rows(R.reduce(df, spec), [R.group_order_key(spec)])
    assert [r.k for r in numbered.orderBy("rn").collect()] == got


def test_group_order_uses_javascript_number_text(spark):
    # JSON of the keys is {"k":10}, {"k":10.5}, {"k":9}: "." sorts before "}" in Unicode collation
    df = spark.createDataFrame([(10.0,), (9.0,), (10.5,)], "k double")
    spec = ReduceSpec(group_by=("k",), metrics=(Metric("count", "n"),))
    assert [r.k for r in R.ordered(R.reduce(df, spec), spec).collect()] == [10.5, 10.0, 9.0]


def test_stored_partials_across_rounds(spark, workdir):
    df = spark.range(0, 900).select((F.col("id") % 4).cast("string").alias("g"), F.col("id").cast("double").alias("v"), "id")
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("count", "n"), Metric("avg", "m", "v")))
    stored = None
    for i, lo in enumerate(range(0, 900, 300)):
        arrived = R.partials(df.filter((F.col("id") >= lo) & (F.col("id") < lo + 300)), spec)
        stored = R.save_partials(R.merge_incremental(stored, arrived, spec), f"{workdir}/partials-{i}")
    final = sorted(tuple(r) for r in R.report_view(R.merge_partials(stored, spec), spec).collect())
    assert final == sorted(tuple(r) for r in R.reduce(df, spec).collect())


def test_partitioned_reduce_equals_direct(spark):
    df = spark.range(5, 2005).select("id", (F.col("id") % 6).cast("string").alias("g"), (F.col("id") * 0.25).alias("v"))
    spec = ReduceSpec(group_by=("g",), metrics=(Metric("count", "n"), Metric("sum", "s", "v"), Metric("avg", "m", "v")))
    reduced, parts, profile, ranges = R.partitioned_reduce(df, spec, "id", 32)
    assert len(ranges) == 32 and profile.count() == 32
    assert sorted(map(tuple, R.report_view(reduced, spec).collect())) == sorted(map(tuple, R.reduce(df, spec).collect()))
    hexed = df.select(F.lpad(F.lower(F.hex("id")), 24, "0").alias("hid"), "g", "v")
    hreduced, _, hprofile, hranges = R.partitioned_reduce(hexed, spec, "hid", 8, "hex")
    assert len(hranges) == 8 and hprofile.agg(F.sum("rows_in")).first()[0] == 2000
    assert sorted(map(tuple, R.report_view(hreduced, spec).collect())) == sorted(map(tuple, R.reduce(df, spec).collect()))
