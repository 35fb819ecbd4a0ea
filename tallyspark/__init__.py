"""tallyspark: tenant-scoped tabular reports as Spark jobs.

A report spec names a source table, a tenant, an equality filter and optionally a group-by
with count/sum/min/max/avg; the engine plans it as DataFrame operations and renders it as
CSV, JSON, NDJSON, numbered listings or workbooks.
"""

import sys as _sys

# Functions that run on executors (applyInPandas / mapInPandas helpers) are pickled with their
# code, so Python workers need no import path to this package -- wherever the driver starts.
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):
    pass

from .spec import Metric, PartitionSpec, ReduceSpec, ReportSpec, SpecError  # noqa: E402
from .plans.export import export  # noqa: E402
from .plans.report import plan_report, run  # noqa: E402
from .sources.registry import Source, SourceRegistry  # noqa: E402

__all__ = ["Metric", "PartitionSpec", "ReduceSpec", "ReportSpec", "Source", "SourceRegistry", "SpecError",
           "export", "plan_report", "run"]
