import datetime as dt

import pytest
from pyspark.sql import types as T

from tallyspark.operators.filters import equality_filter, id_range, sanitize_filters
from tallyspark.sources.registry import DEFAULT_SOURCE, Source, SourceRegistry, resolve_source_name
from tallyspark.spec import SpecError


def test_sanitize_drops_operators_and_dotted_keys():
    raw = {"status": "paid", "nested": {"ok": True, "$where": "1"}, "$or": [1], "bad.field": 2}
    assert sanitize_filters(raw) == {"status": "paid", "nested": {"ok": True}}
    assert sanitize_filters([1, 2]) == {}
    assert sanitize_filters(None) == {}
    # lists are values: nothing inside them is touched
    assert sanitize_filters({"tags": [{"$x": 1}]}) == {"tags": [{"$x": 1}]}


def test_resolve_source_name():
    assert resolve_source_name("  ", ["reportSource"]) == DEFAULT_SOURCE
    assert resolve_source_name(" events ", ["events"]) == "events"
    with pytest.raises(SpecError, match="must match"):
        resolve_source_name("bad-name", ["bad-name"])
    with pytest.raises(SpecError, match="'orders' is not allowed"):
        resolve_source_name("orders", ["reportSource"])
    reg = SourceRegistry([Source("orders", "/x", "id", "t")], allowed=["reportSource"])
    with pytest.raises(SpecError, match="not allowed"):
        reg.resolve("orders")


@pytest.fixture(scope="module")
def frame(spark):
    schema = T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("flag", T.BooleanType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("doc", T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])),
    ])
    rows = [
        (1, 100.0, "paid", True, dt.datetime(2024, 1, 1), ["x", "y"], (1, "u")),
        (2, 100.5, "paid", False, dt.datetime(2024, 1, 2), ["y"], (1, None)),
        (3, None, None, None, None, None, None),
        (4, float("nan"), "100", True, dt.datetime(2024, 1, 3), [], (2, "v")),
    ]
    return spark.createDataFrame(rows, schema)


def ids(df, filters, **kw):
    return sorted(r.id for r in df.filter(equality_filter(df, filters, **kw)).collect())


def test_typed_equality_never_casts(frame):
    assert ids(frame, {"amount": 100}) == [1]
    assert ids(frame, {"amount": "100"}) == []  # D6: a string never equals a number
    assert ids(frame, {"status": 100}) == []
    assert ids(frame, {"status": "100"}) == [4]
    assert ids(frame, {"flag": True}) == [1, 4]
    assert ids(frame, {"flag": 1}) == []  # a number is not a boolean
    assert ids(frame, {"at": dt.datetime(2024, 1, 2)}) == [2]
    assert ids(frame, {"at": "2024-01-02"}) == []


def test_null_filter_matches_null(frame):
    assert ids(frame, {"status": None}) == [3]


def test_nan_matches_nan(frame):
    assert ids(frame, {"amount": float("nan")}) == [4]


def test_struct_filter_is_whole_document(frame):
    assert ids(frame, {"doc": {"a": 1, "b": "u"}}) == [1]
    assert ids(frame, {"doc": {"a": 1, "b": None}}) == [2]
    assert ids(frame, {"doc": {"b": "u", "a": 1}}) == []  # field order matters
    assert ids(frame, {"doc": {"a": 1}}) == []  # missing field
    assert ids(frame, {"amount": {}}) == []  # D8: sanitised operator map matches nothing


def test_array_filters(frame):
    assert ids(frame, {"tags": "y"}) == [1, 2]  # membership
    assert ids(frame, {"tags": ["x", "y"]}) == [1]  # exact
    assert ids(frame, {"tags": ["y", "x"]}) == []
    assert ids(frame, {"tags": []}) == [4]


def test_all_entries_anded(frame):
    assert ids(frame, {"status": "paid", "flag": False}) == [2]
    assert ids(frame, {}) == [1, 2, 3, 4]


def test_unknown_column_and_scope_column_rejected(frame):
    with pytest.raises(SpecError, match="Unknown filter column"):
        equality_filter(frame, {"nope": 1})
    with pytest.raises(SpecError, match="scope column"):
        equality_filter(frame, {"status": "paid"}, forbid=("status",))


def test_id_range_half_open(frame):
    assert sorted(r.id for r in frame.filter(id_range("id", 2, 4)).collect()) == [2, 3]
    assert sorted(r.id for r in frame.filter(id_range("id", 2, None)).collect()) == [2, 3, 4]


def test_tenant_filter_pushed_to_parquet(spark):
    from tallyspark.plans.report import plan_report
    from tallyspark.sources.registry import testdata_registry
    from tallyspark.spec import ReportSpec

    plan = plan_report(spark, ReportSpec(tenant=8, source="events", filters={"event_type": "view"}),
                       testdata_registry("/root/testdata/sf0.001"))
    from conftest import plan_text

    text = plan_text(plan.scoped)
    assert "EqualTo(user_id,8)" in text and "EqualTo(event_type,view)" in text


def test_range_partials_scan_pushes_tenant_filters_and_range(spark):
    from conftest import plan_text
    from tallyspark.operators import reduce as R
    from tallyspark.operators.ranges import id_ranges, range_predicate
    from tallyspark.sources.registry import scan_tenant, testdata_registry
    from tallyspark.spec import Metric, ReduceSpec

    reg = testdata_registry("/root/testdata/sf0.001")
    src, df = reg.load(spark, "events")
    r = id_ranges(0, 999, 4)[1]
    scoped = scan_tenant(df, src, 8, equality_filter(df, {"event_type": "view"}) & range_predicate(r, src.id_col))
    parts = R.partials(scoped, ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"),)))
    text = plan_text(parts)
    for piece in ("EqualTo(user_id,8)", "EqualTo(event_type,view)", f"GreaterThanOrEqual(event_id,{r.start})", f"LessThan(event_id,{r.end})"):
        assert piece in text
    expected = df.filter(f"user_id = 8 and event_type = 'view' and event_id >= {r.start} and event_id < {r.end}").count()
    got = parts.collect()
    assert sum(row.n for row in got) == expected
