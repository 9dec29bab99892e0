"""Plan shape: pushdown, pruning, no Python in hot paths, no pairwise joins, split windows."""

import re

import pytest

import __spark_entry__ as entry
from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.predicates import FilterSpec, Predicate
from hpcstats.operators.extract import extract
from hpcstats.operators.rolling import rolling
from hpcstats.plans.analysis import explain
from hpcstats.sources.shared_tables import host_view
from helpers import SF_SMALL

PAIRWISE = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "MapInPandas", "MapInArrow")


def _plan(df):
    return explain(df, "formatted")


def test_entry_contract(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and df.columns == ["event", "unit", "n", "mean", "median", "std"]
    ours = {name for name in entry.queries() if not re.match(r"op\d+_|pipeline$", name)}
    assert ours == {name for name in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", name)}


# Python runs only for rolling medians (pandas' rolling on bounded cells); everything else stays in the JVM.
PYTHON_ALLOWED = {**dict.fromkeys(("rolling_count_median", "rolling_count_plain", "rolling_count_by_host", "rolling_time_median",
                                   "rolling_time_plain", "rolling_time_ties", "rolling_dirty", "rolling_count_long",
                                   "rolling_median_days"), "FlatMapGroupsInArrow")}


def test_no_pairwise_joins_and_python_only_where_designed(spark):
    from hpcstats.plans.catalog import QUERIES
    for name, q in QUERIES.items():
        plan = _plan(q(spark, SF_SMALL))
        assert not any(p in plan for p in PAIRWISE), name
        found = {p for p in PYTHON if p in plan}
        allowed = {PYTHON_ALLOWED[name]} if name in PYTHON_ALLOWED else set()
        if name == "rolling_median_narrow_cells":  # frames of many cells: groups are cut to the middle of the core
            allowed = {"FlatMapGroupsInArrow", "FlatMapGroupsInPandas", "MapInPandas"}
        assert found <= allowed, (name, found)


def test_extract_pushdown_and_pruning(spark):
    h = host_view(spark, SF_SMALL)
    spec = FilterSpec("host", columns=("time", "value"), window=("2024-01-05", "2024-01-06"),
                      predicates=(Predicate("value", ">", 3),))
    plan = _plan(extract(h, spec))
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")][0]
    for part in ("GreaterThanOrEqual(ts,2024-01-05T00:00)", "LessThanOrEqual(ts,2024-01-06T00:00)",
                 "GreaterThan(value,3.0)"):
        assert part in pushed, pushed
    scan = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert scan and all("user_id" not in s and "props" not in s for s in scan)
    topk = _plan(extract(h, FilterSpec("host", order_by=("value",), limit=5)))
    assert "TakeOrderedAndProject" in topk


@pytest.mark.parametrize("interval", [Span(3, "Hours"), Rows(5)])
def test_split_windows_are_not_per_metric(spark, interval):
    h = host_view(spark, SF_SMALL).select("event_id", "time", "event", "value")
    med = _plan(rolling(h, ["median"], interval, tie="event_id"))
    assert "FlatMapGroupsInArrow" in med and ("_b" in med or "_c" in med)
    for split in (True, False):   # the argument does not choose an unbounded plan
        plan = _plan(rolling(h, ["mean"], interval, tie="event_id", split=split))
        windows = [line for line in plan.splitlines() if line.startswith("Arguments") and "specifiedwindowframe" in line.lower()]
        assert windows and all(any(k in w for k in ("_cell", "_c#", "_hb")) for w in windows), windows


def test_stored_host_data_pushes_every_condition(spark, tmp_path):
    from hpcstats.sources.readers import read_host
    path = str(tmp_path / "host_data")
    host_view(spark, SF_SMALL).write.partitionBy("event").parquet(path)
    stored = read_host(spark, path)
    spec = FilterSpec("host", window=("2024-01-05", "2024-01-06"), predicates=(
        Predicate("event", "=", "cpuuser"), Predicate("host", "=", "NODE3"), Predicate("value", ">", 10)))
    plan = _plan(extract(stored, spec))
    assert "PartitionFilters: [isnotnull(event" in plan and "(event#" in plan   # partition pruning on event
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")][0]
    for part in ("EqualTo(host,NODE3)", "GreaterThan(value,10.0)", "GreaterThanOrEqual(time,"):
        assert part in pushed, pushed


def test_no_frame_is_refused(spark):
    """Frames longer than a worker's rows are answered, too (tests/test_rolling_cells.py has their values)."""
    from hpcstats.operators import rolling as r
    assert not [name for name in dir(r) if name.startswith("PANDAS")]
    h = host_view(spark, SF_SMALL)
    for interval in (Span(6, "Hours"), Rows(400)):
        out = r.rolling(h, ["mean", "median"], interval, tie="event_id", target_rows=10)
        assert out.count() == h.count()
    assert r.rolling(h, ["mean", "std"], Span(5, "Days"), tie="event_id").count() == h.count()


def test_no_partition_of_the_mean_plan_holds_a_span(spark):
    """The windows of mean/std run per cell, in the JVM."""
    from hpcstats.operators import rolling as r
    h = host_view(spark, SF_SMALL)
    plan = _plan(r.rolling(h, ["mean", "std"], Span(5, "Days"), tie="event_id"))
    windows = [line for line in plan.splitlines() if line.startswith("Arguments") and "windowspecdefinition" in line]
    assert windows and all("_cell#" in line for line in windows)
    assert not any(name in plan for name in PYTHON) and "CheckpointRDD" not in plan
