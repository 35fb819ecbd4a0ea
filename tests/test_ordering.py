from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.ordering import number_rows, number_rows_within
from tallyspark.operators.ranges import build_ranges, id_ranges, int_to_objectid, objectid_to_int, ranges_frame


def test_number_rows_matches_row_number(spark):
    df = spark.range(0, 20000, numPartitions=9).select(((F.col("id") * 7) % 20000).alias("k"))
    got = number_rows(df, [F.col("k")]).select("k", "rn")
    want = df.select("k", F.row_number().over(Window.orderBy("k")).alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == 20000


def test_number_rows_within_skewed_groups(spark):
    df = spark.range(0, 30000, numPartitions=6).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"), "id")
    got = number_rows_within(df, ["g"], [F.col("id")]).select("g", "id", "rn")
    want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == 30000


def test_ranges_fixtures():
    pad = lambda h: h.zfill(24)
    one = id_ranges(pad("10"), pad("ff"), 1, "hex")
    assert [(r.index, r.start, r.end) for r in one] == [(0, pad("10"), None)]
    many = id_ranges(pad("100"), pad("5ff"), 8, "hex")
    assert len(many) > 1 and many[-1].end is None
    for a, b in zip(many, many[1:]):
        assert a.end == b.start
    assert objectid_to_int(many[-1].start) <= objectid_to_int(pad("5ff"))
    assert id_ranges("f" * 24, pad("1"), 4, "hex") == []
    assert int_to_objectid(objectid_to_int("0a1b2c3d4e5f60718293a4b0")) == "0a1b2c3d4e5f60718293a4b0"


def test_ranges_cover_without_overlap():
    for lo, hi, n in [(0, 9, 32), (5, 5, 4), (0, 9999, 32), (17, 1000, 7)]:
        rs = build_ranges(lo, hi, n)
        covered = []
        for i, s, e in rs:
            covered.extend(range(s, (hi + 1) if e is None else e))
        assert covered == list(range(lo, hi + 1))
        assert rs[-1][2] is None


def test_ranges_frame_matches_python(spark):
    df = spark.range(3, 1000)
    got = [(r.chunk, r.start_id, r.end_id) for r in ranges_frame(df, "id", 32).orderBy("chunk").collect()]
    assert got == build_ranges(3, 999, 32)
    single = [(r.chunk, r.start_id, r.end_id) for r in ranges_frame(df, "id", 1).collect()]
    assert single == [(0, 3, None)]


def test_number_rows_within_without_broadcast(spark):
    df = spark.range(0, 5000, numPartitions=5).select((F.col("id") % 4).alias("g"), "id")
    got = number_rows_within(df, ["g"], [F.col("id")]).select("g", "id", "rn")
    want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("rn"))
    assert got.exceptAll(want).count() == 0 and got.count() == 5000


def test_numbering_keeps_odd_column_names(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, `x.y` string")
    assert [tuple(r) for r in number_rows(df, [F.col("id")]).orderBy("rn").collect()] == [(1, "a", 1), (2, "b", 2)]
    g = number_rows_within(df.withColumn("g", F.lit(1)), ["g"], [F.col("id")]).orderBy("rn").collect()
    assert [r["x.y"] for r in g] == ["a", "b"]


def test_number_rows_within_null_group(spark):
    df = spark.range(0, 300, numPartitions=3).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 2).cast("string")).alias("g"), "id")
    for bound in (2_000_000, 0):
        got = number_rows_within(df, ["g"], [F.col("id")]).select("g", "id", "rn")
        want = df.select("g", "id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("rn"))
        assert got.exceptAll(want).count() == 0 and got.count() == 300


def test_ranges_are_exact_for_large_ids(spark):
    import random

    from tallyspark.operators.ranges import chunk_of

    draw = random.Random(11)
    for _ in range(6):
        lo = draw.randrange(-(2**62), 2**61)
        hi, chunks = lo + draw.randrange(1, 2**62), draw.choice([1, 3, 7, 1000])
        want = build_ranges(lo, hi, chunks)
        got = ranges_frame(spark.createDataFrame([(lo,), (hi,), (None,)], "id long"), "id", chunks).orderBy("chunk").collect()
        assert [(r.chunk, r.start_id, r.end_id) for r in got] == want
        edges = sorted({x for _, s, e in want[:50] for x in (s - 1, s, (hi if e is None else e) - 1) if lo <= x <= hi})
        ranges = id_ranges(lo, hi, chunks)
        rows = spark.createDataFrame([(x,) for x in edges], "id long").select("id", chunk_of(ranges, "id").alias("c")).collect()
        assert all(next(i for i, s, e in want if s <= r.id and (e is None or r.id < e)) == r.c for r in rows)
        hexed = [int_to_objectid(x - lo + 5) for x in edges]
        hex_ranges = id_ranges(int_to_objectid(5), int_to_objectid(hi - lo + 5), chunks, "hex")
        both = spark.createDataFrame([(h,) for h in hexed] + [(None,)], "id string").select("id", chunk_of(hex_ranges, "id").alias("c")).collect()
        assert {r.id: r.c for r in both} == {None: None, **{int_to_objectid(r.id - lo + 5): r.c for r in rows}}
    assert spark.createDataFrame([(None,), (4,)], "id long").select(chunk_of(id_ranges(5, 9, 2), "id").alias("c")).collect() == [(None,), (None,)]


def test_ranges_over_ids_beyond_bigint(spark, workdir):
    """chunk_ranges_large: event ids above 92,233 times 10^14 pass 2^63."""
    from tallyspark.catalog import QUERIES

    ids = [0, 1, 92_233, 92_234, 99_999, 699_999, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{workdir}/events.parquet")
    got = {r.chunk: r.n_rows for r in QUERIES["chunk_ranges_large"](spark, workdir).collect()}
    assert got == {0: 5, 6: 1, None: 1}
