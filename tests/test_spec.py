import pytest

from tallyspark.spec import Metric, PartitionSpec, ReduceSpec, ReportSpec, SpecError, check_formats


def test_duplicated_alias_rejected():
    with pytest.raises(SpecError, match="Duplicated metric alias"):
        ReduceSpec(metrics=(Metric("count", "orders"), Metric("sum", "orders", "amount")))


def test_metric_needs_field_unless_count():
    Metric("count", "n")
    with pytest.raises(SpecError, match="requires a valid field"):
        Metric("sum", "total")
    with pytest.raises(SpecError):
        Metric("avg", "a", "bad.field")


def test_unknown_op_and_bad_names():
    with pytest.raises(SpecError, match="Unsupported reduce operation"):
        Metric("median", "m", "x")
    with pytest.raises(SpecError, match="Invalid metric alias"):
        Metric("count", "has space")
    with pytest.raises(SpecError, match="Invalid groupBy field"):
        ReduceSpec(group_by=("a$b",), metrics=(Metric("count", "n"),))


def test_at_least_one_metric():
    with pytest.raises(SpecError, match="at least one metric"):
        ReduceSpec(metrics=())


@pytest.mark.parametrize("alias", ["_id", "__input_count", "__avg_sum__x", "__avg_count__y"])
def test_reserved_aliases_rejected(alias):
    with pytest.raises(SpecError, match="Reserved"):
        ReduceSpec(metrics=(Metric("count", alias),))


def test_alias_equal_to_group_field_rejected():
    with pytest.raises(SpecError, match="collides"):
        ReduceSpec(group_by=("status",), metrics=(Metric("count", "status"),))


def test_group_keys_collapse_repeats():
    spec = ReduceSpec(group_by=("a", "b", "a"), metrics=(Metric("count", "n"),))
    assert spec.keys == ["a", "b"]


def test_output_format_rules():
    with pytest.raises(SpecError, match="required when format=zip"):
        ReportSpec(tenant="t", format="zip")
    with pytest.raises(SpecError, match="allowed only when format=zip"):
        ReportSpec(tenant="t", format="csv", include_formats=("json",))
    with pytest.raises(SpecError, match="compression=zip cannot"):
        ReportSpec(tenant="t", format="zip", include_formats=("csv",), compression="zip")
    with pytest.raises(SpecError, match="duplicates"):
        ReportSpec(tenant="t", format="zip", include_formats=("csv", "csv"))
    spec = ReportSpec(tenant="t", format="zip", include_formats=("csv", "json"))
    assert spec.entries == ["report.csv", "report.json"]
    assert check_formats("csv", None) == []
    with pytest.raises(SpecError, match="requires includeFormats"):
        check_formats("zip", [])


def test_partition_spec():
    assert PartitionSpec().chunks == 32
    with pytest.raises(SpecError):
        PartitionSpec(chunks=0)


def test_parse_reference_request_shape():
    spec = ReportSpec.parse(
        {
            "reportDefinitionId": "sales",
            "format": "csv",
            "filters": {"status": "paid"},
            "reduceSpec": {"groupBy": ["status"], "metrics": [{"op": "count", "as": "orders"}, {"op": "sum", "field": "amount", "as": "total"}]},
            "partitionSpec": {"strategy": "objectIdRange", "chunks": 8},
            "sourceCollection": "reportSource",
        },
        tenant="tenant-a",
    )
    assert spec.reduce.keys == ["status"]
    assert [m.alias for m in spec.reduce.metrics] == ["orders", "total"]
    assert spec.partition.chunks == 8 and spec.report_id == "sales"


def test_names_are_matched_whole():
    for bad in ("abc\n", "a b", "", "\nabc"):
        with pytest.raises(SpecError):
            Metric("count", bad)
        with pytest.raises(SpecError):
            ReduceSpec(metrics=(Metric("count", "n"),), group_by=(bad,))


def test_request_needs_its_definition_and_format():
    whole = {"reportDefinitionId": "r", "format": "csv"}
    assert ReportSpec.parse(whole, "t").report_id == "r"
    for name in whole:
        with pytest.raises(SpecError, match=name):
            ReportSpec.parse({k: v for k, v in whole.items() if k != name}, "t")
