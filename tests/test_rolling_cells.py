"""Rolling windows over frames longer than any task: cells narrowed by rows, cores from dyadic nodes and sorted groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL, host_frame
from hpcstats.functions.intervals import Rows, Span
from hpcstats.operators import rolling as r
from hpcstats.operators.rolling import rolling
from hpcstats.plans.catalog import oracle
from hpcstats.sources.shared_tables import host_view

BASE = pd.Timestamp("2024-01-01")
STATS = ["mean", "median", "std"]


@pytest.fixture()
def tiny(monkeypatch):
    """Cells of a handful of rows, however small the table."""
    monkeypatch.setattr(r, "MIN_BUCKET_ROWS", 1)
    monkeypatch.setattr(r, "SAMPLES", 4)
    monkeypatch.setattr(r, "MEDIAN_TARGET_ROWS", 6)
    monkeypatch.setattr(r, "SHORT_FRAME", 3)


def frame(spark, seconds, values):
    rows = [(i, str(BASE + pd.Timedelta(seconds=int(s))), "cpuuser", None if np.isnan(v) else float(v)) for i, (s, v) in enumerate(zip(seconds, values))]
    series = pd.Series(values, index=[BASE + pd.Timedelta(seconds=int(s)) for s in seconds])
    return host_frame(spark, rows).select("event_id", "time", "event", "value"), series


def bursts(rng, n):
    """Two thirds of the rows in a few seconds, the rest over days; values that drift, jump and are missing."""
    seconds = np.sort(np.concatenate([rng.integers(0, 400_000, n // 3), 200_000 + rng.integers(0, 300, n - n // 3)]))
    values = np.round(np.cumsum(rng.normal(0, 1, n)) + np.where(rng.random(n) < 0.02, 1e9, 0.0), 3)
    values[rng.random(n) < 0.1] = np.nan
    return seconds, values


def close(got, want, tol=1e-9):
    got, want = np.array(got, dtype=float), np.array(want, dtype=float)
    assert (np.isnan(got) == np.isnan(want)).all()
    both = ~np.isnan(want)
    assert np.allclose(got[both], want[both], rtol=tol, atol=tol)


def plain(series, starts, ends, least=1):
    """Statistics of series[start:end] for each row, directly."""
    out = {s: [] for s in STATS}
    for a, b in zip(starts, ends):
        v = series.to_numpy()[a:b]
        v = v[~np.isnan(v)]
        ok = len(v) >= least
        out["mean"].append(v.mean() if ok else np.nan)
        out["median"].append(np.median(v) if ok else np.nan)
        out["std"].append(v.std(ddof=1) if ok and len(v) > 1 else np.nan)
    return out


@pytest.mark.parametrize("hours,ties", [(1, "peers"), (30, "row"), (30, "peers")])
def test_spans_of_many_cells(spark, tiny, hours, ties):
    rng = np.random.default_rng(hours)
    seconds, values = bursts(rng, 360)
    df, series = frame(spark, seconds, values)
    w = hours * 3600
    starts = np.searchsorted(seconds, seconds - w, side="right")
    ends = np.searchsorted(seconds, seconds, side="right") if ties == "peers" else np.arange(1, len(seconds) + 1)
    got = rolling(df, STATS, Span(hours, "Hours"), tie="event_id", ties=ties, target_rows=6).orderBy("event_id").toPandas()
    want = plain(series, starts, ends)
    for stat in STATS:
        close(got[stat], want[stat], 1e-7 if stat == "std" else 1e-9)


@pytest.mark.parametrize("n", [4, 37, 200, 1000])
def test_row_windows_of_any_length(spark, tiny, n):
    rng = np.random.default_rng(n)
    seconds, values = bursts(rng, 300)
    values[:150] = np.where(np.isnan(values[:150]), 1.0, values[:150])
    df, series = frame(spark, seconds, values)
    got = rolling(df, STATS, Rows(n), tie="event_id", target_rows=8, chunk_rows=8).orderBy("event_id").toPandas()
    i = np.arange(len(seconds))
    want = plain(series, np.maximum(i - n + 1, 0), i + 1, least=n)
    for stat in STATS:
        close(got[stat], want[stat], 1e-7 if stat == "std" else 1e-9)


def test_long_row_window_stays_in_the_jvm(spark):
    df = spark.range(4000).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.col("id") + 1_700_000_000)).cast("timestamp_ntz").alias("time"),
                                  F.lit("cpuuser").alias("event"), F.sin("id").alias("value"))
    out = rolling(df, ["mean", "std"], Rows(1_000_000), tie="event_id")
    assert "Python" not in out._jdf.queryExecution().toString() and "InArrow" not in out._jdf.queryExecution().toString()
    assert out.where("mean is not null").count() == 0 and out.count() == 4000
    got = rolling(df, ["mean", "std"], Rows(3000), tie="event_id").orderBy("event_id").toPandas()
    close(got["mean"], got["value"].rolling(3000).mean(), 1e-9)
    close(got["std"], got["value"].rolling(3000).std(), 1e-9)


def test_shared_table_in_tiny_cells_equals_the_sql(spark, tiny):
    """The registered query's SQL, in cells of about forty rows."""
    import duckdb
    from hpcstats.plans.catalog import rnd
    h = host_view(spark, SF_SMALL).select("event_id", "time", "event", "value")
    got = rnd(rolling(h, STATS, Span(3, "Hours"), tie="event_id", target_rows=20), STATS).toPandas().sort_values("event_id")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{SF_SMALL}/events.parquet')")
    want = con.execute(oracle()["rolling_time_plain"]).df().sort_values("event_id")
    for stat in STATS:
        close(got[stat], want[stat], 1e-6)


def test_cells_are_bounded_with_one_hot_metric(spark, monkeypatch):
    """One metric has most rows, and most of these in one minute: no cell holds more than twice the target."""
    monkeypatch.setattr(r, "MIN_BUCKET_ROWS", 1)
    hot = spark.range(6000).select("id", F.lit("cpuuser").alias("event"), (F.col("id") * 10_000 + F.lit(10 ** 12)).alias("_key"))
    rest = spark.range(300).select((F.col("id") + 6000).alias("id"), F.lit("nfs").alias("event"), (F.col("id") * 3_600_000_000).alias("_key"))
    rows = hot.unionByName(rest)
    for wide in (False, True):
        for w in (86_400_000_000, 5_000_000):
            cells = r.plan_cells(rows, ["event"], w, 50, wide)
            located = r._located(rows, cells, ["event"], w)
            events = located.select("event", F.explode(F.array("_j", "_l")).alias("_cell"))
            sizes = events.groupBy("event", "_cell").count()
            assert sizes.agg(F.max("count")).first()[0] <= 2 * cells.target == 100
            assert located.where(F.col("_key") < F.col("_j")).isEmpty()
            if wide:  # the quiet metric keeps wide cells
                assert sizes.where("event = 'nfs'").count() < 60


def test_dyadic_nodes_cover_an_interval_once(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a) * 4, int(b) * 4) for a, b in np.sort(rng.integers(-200, 200, (60, 2)), axis=1)]
    df = spark.createDataFrame(pairs, "x long, y long").withColumn("n", r._nodes("x", "y", 2, 11))
    for x, y, nodes in df.collect():
        covered = sorted(v for n in nodes for v in range(n["no"] << n["lv"], (n["no"] + 1) << n["lv"]))
        assert covered == list(range(x, y)) and len(nodes) <= 2 * 10


def test_very_large_values_that_left_do_not_show(spark):
    values = np.array([1e300, 1.0, 2.0, 4.0, 8.0, 1e-3, 2e-3, 3e-3] * 4)
    df, series = frame(spark, np.arange(len(values)) * 60, values)
    got = rolling(df, STATS, Span(4, "Minutes"), tie="event_id").orderBy("event_id").toPandas()
    i = np.arange(len(values))
    quiet = np.array([1e300 not in values[max(k - 3, 0):k + 1] for k in i])
    want = plain(series, np.maximum(i - 3, 0), i + 1)
    for stat in STATS:
        close(np.array(got[stat])[quiet], np.array(want[stat])[quiet])


def test_a_frame_covers_few_cells_whatever_the_target(spark):
    """A cell looks at the groups of all cells of its frames, so a small target must not cut a full frame into thousands."""
    w = 10_000 * 1_000_000
    axis = spark.range(20_000).select(F.lit("cpuuser").alias("event"), (F.col("id") * 1_000_000).alias(r.KEY))
    cells = r.plan_cells(axis, ["event"], w, target_rows=3, wide=True, frame_cells=r.FRAME_CELLS)
    entered = r._located(axis, cells, ["event"], w).select("_j").distinct().count()
    assert r.FRAME_CELLS <= entered <= 2 * 4 * r.FRAME_CELLS  # two frames long; a cell is cut to less than half its bound


def test_medians_of_a_full_frame_with_a_small_target(spark):
    rng = np.random.default_rng(12)
    df, series = frame(spark, np.sort(rng.integers(0, 20_000, 3000)), np.round(rng.normal(50, 20, 3000), 2))
    want = series.rolling("10000s", closed="right").median()
    got = rolling(df, ["median"], Span(10_000, "Seconds"), tie="event_id", ties="row", target_rows=3).orderBy("event_id").toPandas()
    close(got["median"], want)
