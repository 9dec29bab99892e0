"""hpcstats: distributed statistics over supercomputer job records and resource-usage samples."""

import sys as _sys

try:  # ship this package's functions with the tasks (pickle by value), so Python workers
    # need not find `hpcstats` on their own path (e.g. a driver started from another folder)
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: workers need the package installed
    pass

# the public API in one place
from hpcstats.functions.intervals import Rows, Span, parse_interval  # noqa: E402
from hpcstats.functions.predicates import FilterSpec, Predicate, check_window, select_metrics  # noqa: E402
from hpcstats.functions.rules import host_rules, job_rules  # noqa: E402
from hpcstats.operators.box import box_outliers, box_source, box_stats  # noqa: E402
from hpcstats.operators.correlation import common_times, paired_points, pearson, pearson_pairs  # noqa: E402
from hpcstats.operators.distribution import cdf, histogram, kde  # noqa: E402
from hpcstats.operators.extract import extract, row_count  # noqa: E402
from hpcstats.operators.quality import audit, passing, quarantine  # noqa: E402
from hpcstats.operators.quantiles import exact_quantiles  # noqa: E402
from hpcstats.operators.rolling import rolling  # noqa: E402
from hpcstats.operators.summary import metric_summary, outside_ratio  # noqa: E402
from hpcstats.plans.analysis import analyse, explain  # noqa: E402
from hpcstats.session import build_session  # noqa: E402
from hpcstats.sources.readers import read_host, read_jdbc, read_jdbc_split, read_job, run_sql, union_sources  # noqa: E402
from hpcstats.sources.sinks import export, write_csv, write_json, write_parquet  # noqa: E402

__all__ = [
    "Rows", "Span", "parse_interval", "FilterSpec", "Predicate", "check_window", "select_metrics", "host_rules",
    "job_rules", "box_outliers", "box_source", "box_stats", "common_times", "paired_points", "pearson",
    "pearson_pairs", "cdf", "histogram", "kde", "extract", "row_count", "audit", "passing", "quarantine",
    "exact_quantiles", "rolling", "metric_summary", "outside_ratio", "analyse", "explain", "build_session",
    "read_host", "read_jdbc", "read_jdbc_split", "read_job", "run_sql", "union_sources", "export", "write_csv",
    "write_json", "write_parquet",
]
