"""Run exports over a source whose tasks fail on their first attempt; print one JSON line.

Started by tests/test_retry.py in its own process (its own SparkContext, local[4,4] so a
failed task is retried).  Outputs must equal those of the same exports over a clean source.
"""

import json
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallyspark.plans.export import export  # noqa: E402
from tallyspark.session import checkpoint_dir, prepare  # noqa: E402
from tallyspark.sources.registry import Source, SourceRegistry  # noqa: E402
from tallyspark.spec import Metric, ReduceSpec, ReportSpec  # noqa: E402


def flaky(batches):
    from pyspark import TaskContext

    ctx = TaskContext.get()
    if ctx.attemptNumber() == 0 and ctx.partitionId() in (1, 3):
        raise RuntimeError("injected task failure")
    yield from batches


def read_parts(path: str) -> str:
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def main() -> None:
    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "6").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    prepare(spark)
    checkpoint_dir(spark)
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.createOrReplaceTempView("clean_events")
    src.repartition(4).mapInPandas(flaky, src.schema).createOrReplaceTempView("flaky_events")
    out = tempfile.mkdtemp(prefix="retry-")
    results = {}
    for view in ("clean_events", "flaky_events"):
        reg = SourceRegistry([Source("events", view, "event_id", "user_id", format="table")])
        texts = []
        for fmt, reduce in (("csv", None), ("pdf", None),
                            ("json", ReduceSpec(group_by=("event_type",), metrics=(Metric("count", "n"), Metric("max", "m", "value"))))):
            spec = ReportSpec(tenant=8, source="events", format=fmt, reduce=reduce, report_id=f"{view}-{fmt}")
            res = export(spark, spec, reg, out)
            texts.append(read_parts(res.artifact.key))
        results[view] = texts
    print(json.dumps({"equal": results["clean_events"] == results["flaky_events"],
                      "sizes": [len(t) for t in results["flaky_events"]]}))
    spark.stop()


if __name__ == "__main__":
    main()
