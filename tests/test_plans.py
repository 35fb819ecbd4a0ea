import json
"""Plan regressions: the physical shapes the scale design relies on."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import plan_text
from tallyspark.plans.batch import reduce_all_tenants, run_specs, specs_frame
from tallyspark.plans.report import run
from tallyspark.sources.registry import testdata_registry as registry_for
from tallyspark.spec import Metric, ReduceSpec, ReportSpec

SF = "/root/testdata/sf0.001"


def test_raw_report_sorts_by_range_without_a_single_task(spark):
    text = plan_text(run(spark, ReportSpec(tenant=8, source="events"), registry_for(SF)), "simple")
    assert "rangepartitioning(event_id" in text
    assert "SinglePartition" not in text
    assert "EqualTo(user_id,8)" in text


def test_saved_specs_aggregate_before_they_join(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    request = json.dumps({"reportDefinitionId": "s", "format": "csv", "filters": {"event_type": "view"},
                          "reduceSpec": {"groupBy": [], "metrics": [{"op": "count", "as": "n"}]}})
    specs = specs_frame(spark, [(i, i, request, True, dt.datetime(2024, 1, 1)) for i in range(50)])
    text = plan_text(run_specs(ev, specs, dt.datetime(2024, 2, 1), tenant_col="user_id"), "simple")
    below = text[max(0, text.index("Scan parquet") - 4000) : text.index("Scan parquet")]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # printed top-down: between the scan and the aggregates there is no join
    assert below.rindex("HashAggregate") > below.rindex("Join ")


def test_all_tenant_reduce_combines_before_the_shuffle(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    out = reduce_all_tenants(ev, "user_id", ReduceSpec(group_by=("event_type",), metrics=(Metric("sum", "s", "value"),)))
    text = plan_text(out, "simple")
    partial = text.index("partial_sum")
    exchange = text.index("Exchange hashpartitioning(user_id")
    assert exchange < partial  # printed top-down: the exchange sits above the partial aggregate
    assert "ReadSchema: struct<user_id:bigint,event_type:string,value:double>" in text
