"""Whole-series statistics, rolling windows and exact quantiles against pandas/numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hpcstats.functions.intervals import Rows, Span, parse_interval
from hpcstats.operators.quantiles import exact_quantiles
from hpcstats.operators.rolling import rolling
from hpcstats.operators.summary import metric_summary, outside_ratio
from helpers import host_frame

BASE = pd.Timestamp("2024-01-01 00:00:00")


def _rows(values, minutes=None, event="cpuuser"):
    minutes = minutes if minutes is not None else list(range(len(values)))
    return [(i, str(BASE + pd.Timedelta(minutes=m)), event, None if v is None else float(v))
            for i, (m, v) in enumerate(zip(minutes, values))]


def _close(a, b, tol=1e-9):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or (isinstance(b, float) and math.isnan(b))
    if b is None or (isinstance(b, float) and math.isnan(b)):
        return False
    return abs(a - b) <= tol * max(1.0, abs(a), abs(b))


def test_mean_and_rolling_mean_small_frame(spark):
    df = host_frame(spark, _rows([1, 2, 3, 4, 5]))
    s = metric_summary(df, metrics=["cpuuser"]).first()
    assert s["mean"] == 3.0 and s["median"] == 3.0 and s["n"] == 5
    for split in (False, True):
        r = rolling(df, ["mean"], Rows(2), tie="event_id", split=split).orderBy("event_id")
        assert [x["mean"] for x in r.collect()] == [None, 1.5, 2.5, 3.5, 4.5]


def test_std_matches_pandas(spark):
    df = host_frame(spark, _rows([10, 20, 30, 40]))
    s = metric_summary(df, metrics=["cpuuser"]).first()
    assert _close(s["std"], pd.Series([10, 20, 30, 40.0]).std())
    r = rolling(df, ["std"], Rows(2), tie="event_id").orderBy("event_id").collect()
    want = pd.Series([10, 20, 30, 40.0]).rolling(2).std().tolist()
    assert all(_close(a["std"], b) for a, b in zip(r, want))


def test_one_row_std_null_and_missing_metric(spark):
    df = host_frame(spark, _rows([7]))
    rows = {r["event"]: r for r in metric_summary(df).collect()}
    assert rows["cpuuser"]["std"] is None and rows["cpuuser"]["mean"] == 7.0
    assert rows["nfs"]["n"] == 0 and rows["nfs"]["mean"] is None and rows["nfs"]["median"] is None


def test_nan_is_missing(spark):
    df = host_frame(spark, _rows([1, None, 3, float("nan")]))
    s = metric_summary(df, metrics=["cpuuser"]).first()
    assert s["n"] == 2 and s["mean"] == 2.0
    o = outside_ratio(df, 2.0, metrics=["cpuuser"]).first()
    assert o["n_rows"] == 4 and o["n_outside"] == 1 and o["ratio_outside"] == 0.25
    empty = outside_ratio(df, 2.0, metrics=["nfs"]).first()
    assert empty["ratio_outside"] is None


@pytest.mark.parametrize("engine", ["spark", "pandas"])
def test_ties_peers_and_row(spark, engine):
    df = host_frame(spark, _rows([1, 2, 3, 4], minutes=[0, 1, 1, 2]))
    peers = rolling(df, ["mean"], Span(1, "Minutes"), tie="event_id", engine=engine).orderBy("event_id").collect()
    assert [r["mean"] for r in peers] == [1.0, 2.5, 2.5, 4.0]
    for split in (False, True):
        row = rolling(df, ["mean"], Span(1, "Minutes"), tie="event_id", ties="row", split=split, engine=engine) \
            .orderBy("event_id").collect()
        assert [r["mean"] for r in row] == [1.0, 2.0, 2.5, 4.0]


def test_interval_rules():
    with pytest.raises(ValueError):
        Rows(0)
    with pytest.raises(ValueError):
        Span(3, "Weeks")
    with pytest.raises(ValueError):
        parse_interval("Time", 3, None)
    assert parse_interval("Time", 3, "Hours").micros == 3 * 3_600_000_000
    assert parse_interval("None") is None and parse_interval("Count", 4) == Rows(4)


@pytest.mark.parametrize("seed,engine", [(1, "auto"), (2, "spark"), (3, "pandas")])
def test_rolling_random_against_pandas(spark, seed, engine):
    rng = np.random.default_rng(seed)
    n = 400
    minutes = np.sort(rng.integers(0, 600, n))           # many equal timestamps
    values = rng.normal(10, 3, n).round(2)
    values[rng.random(n) < 0.05] = np.nan
    rows = [(i, str(BASE + pd.Timedelta(minutes=int(m))), "cpuuser", None if np.isnan(v) else float(v))
            for i, (m, v) in enumerate(zip(minutes, values))]
    df = host_frame(spark, rows)
    pdf = pd.DataFrame({"time": [BASE + pd.Timedelta(minutes=int(m)) for m in minutes], "value": values})
    ser = pdf.set_index("time")["value"]
    # row windows
    for split in (False, True):
        got = rolling(df, ["mean", "median", "std"], Rows(7), tie="event_id", split=split,
                      chunk_rows=50, engine=engine).orderBy("event_id").toPandas()
        want = {"mean": ser.rolling(7).mean(), "median": ser.rolling(7).median(), "std": ser.rolling(7).std()}
        for stat in want:
            assert all(_close(a, b) for a, b in zip(got[stat], want[stat].values)), (stat, split)
    # time windows, row order ties (pandas rule)
    for split in (False, True):
        got = rolling(df, ["mean", "median", "std"], Span(30, "Minutes"), tie="event_id", ties="row",
                      split=split, split_factor=2, engine=engine).orderBy("event_id").toPandas()
        want = {"mean": ser.rolling("30min").mean(), "median": ser.rolling("30min").median(),
                "std": ser.rolling("30min").std()}
        for stat in want:
            assert all(_close(a, b, 1e-7) for a, b in zip(got[stat], want[stat].values)), (stat, split)


def test_auto_buckets_against_pandas(spark):
    rng = np.random.default_rng(3)
    n = 300
    minutes = np.sort(rng.integers(0, 3000, n))
    values = rng.normal(0, 1, n)
    rows = [(i, str(BASE + pd.Timedelta(minutes=int(m))), "cpuuser", float(v))
            for i, (m, v) in enumerate(zip(minutes, values))]
    df = host_frame(spark, rows)
    ser = pd.Series(values, index=[BASE + pd.Timedelta(minutes=int(m)) for m in minutes])
    for ties in ("row",):
        got = rolling(df, ["mean", "median"], Span(45, "Minutes"), tie="event_id", ties=ties,
                      target_rows=15).orderBy("event_id").toPandas()
        assert all(_close(a, b, 1e-9) for a, b in zip(got["mean"], ser.rolling("45min").mean().values))
        assert all(_close(a, b, 1e-9) for a, b in zip(got["median"], ser.rolling("45min").median().values))
    got = rolling(df, ["std"], Rows(4), tie="event_id", chunk_rows=32, target_rows=10).orderBy("event_id").toPandas()
    assert all(_close(a, b, 1e-9) for a, b in zip(got["std"], ser.rolling(4).std().values))


def test_split_equals_plain_on_shared_table(spark):
    from hpcstats.sources.shared_tables import host_view
    from helpers import SF_SMALL
    h = host_view(spark, SF_SMALL).select("event_id", "time", "event", "value")
    a = rolling(h, ["mean", "std"], Span(2, "Hours"), tie="event_id", split=True, split_factor=1)
    b = rolling(h, ["mean", "std"], Span(2, "Hours"), tie="event_id", split=False)
    diff = a.alias("a").join(b.alias("b"), "event_id").where(
        F.abs(F.col("a.mean") - F.col("b.mean")) > 1e-9).count()
    assert diff == 0 and a.count() == b.count() == h.count()


@pytest.mark.parametrize("skewed", [False, True])
def test_exact_quantiles_refinement(spark, skewed):
    rng = np.random.default_rng(7)
    vals = rng.normal(0, 1, 3000)
    if skewed:
        vals[:1000] = 0.25          # a third of all rows share one value
        vals[1000:1200] = 1e-12 * np.arange(200)   # a tight cluster
    groups = np.where(np.arange(3000) % 3 == 0, "a", "b")
    pdf = pd.DataFrame({"g": groups, "value": vals})
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, "value", probs, by=["g"], in_memory_rows=0, rank_rows=40, splits=8).toPandas()
    fast = exact_quantiles(df, "value", probs, by=["g"]).toPandas()
    for g, sub in pdf.groupby("g"):
        want = np.percentile(sub["value"], [p * 100 for p in probs])
        for frame in (got, fast):
            row = frame[frame["g"] == g].iloc[0]
            assert all(_close(row[c], w, 1e-12) for c, w in zip(["q_0", "q_0_25", "q_0_5", "q_0_75", "q_1"], want))


def test_exact_quantiles_global_and_empty(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)], "value double")
    r = exact_quantiles(df, "value", [0.5], in_memory_rows=0, rank_rows=3, splits=4).first()
    assert r[0] == 4.5
    empty = exact_quantiles(df.where("value > 100"), "value", [0.5], by=[])
    assert empty.count() == 0


def test_refinement_on_shared_table(spark):
    from hpcstats.sources.shared_tables import host_view
    from helpers import SF_CHECK
    h = host_view(spark, SF_CHECK)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    forced = exact_quantiles(h, "value", probs, by=["event"], in_memory_rows=0, rank_rows=100, splits=16)
    direct = exact_quantiles(h, "value", probs, by=["event"])
    pdf = h.select("event", "value").toPandas()
    a, b = forced.toPandas().set_index("event"), direct.toPandas().set_index("event")
    for event, sub in pdf.groupby("event"):
        want = np.percentile(sub["value"].dropna(), [p * 100 for p in probs])
        for col, w in zip(a.columns, want):
            assert _close(a.loc[event, col], w, 1e-12) and _close(b.loc[event, col], w, 1e-12)


def test_quantiles_narrow_by_count(spark):
    """Infinities, extreme magnitudes and a NULL group: the same answers on every path, and few values ranked at last."""
    import hpcstats.operators.quantiles as Q
    vals = [float(2.0 ** e) for e in range(-400, 400, 3)] + [-1e308, 1e308, 0.0, 5e-324, float("inf"), float("inf"), float("-inf")]
    rows = [("a", v) for v in vals] + [(None, v) for v in vals] + [(None, 1.0)] * 200 + [("b", float("inf"))] * 9 + [("b", float("nan")), ("b", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(6)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    one, many = ({r[0]: tuple(r[1:]) for r in Q.exact_quantiles(df, "value", probs, by=["g"], **kw).collect()}
                 for kw in ({}, {"in_memory_rows": 0, "rank_rows": 5, "splits": 8}))
    assert one.keys() == many.keys() == {"a", "b", None}
    for g in one:
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) for a, b in zip(one[g], many[g])), g
    assert one[None][2] == 1.0 and one["b"] == (math.inf,) * 5

def test_extract_compares_nan_like_the_database(spark):
    from hpcstats.functions.predicates import FilterSpec, Predicate
    from hpcstats.operators.extract import extract
    df = host_frame(spark, _rows([1, None, 30, float("nan")]))
    got = extract(df, FilterSpec("host", predicates=(Predicate("value", ">", 10),))).select("event_id").collect()
    assert sorted(r[0] for r in got) == [2, 3]          # NaN sorts above every number; NULL never matches
    s = metric_summary(df, metrics=["cpuuser"]).first()
    assert s["n"] == 2 and s["mean"] == 15.5            # ... while the statistics skip it


@pytest.mark.parametrize("engine", ["spark", "pandas"])
def test_rows_without_time_get_null(spark, engine):
    df = host_frame(spark, _rows([1, 2, 3, 4]))
    df = df.withColumn("time", F.when(F.col("event_id") == 1, F.lit(None)).otherwise(F.col("time")))
    # the sample without a time (id 1) is in no frame and has no statistic
    for interval, want in ((Rows(2), {0: None, 1: None, 2: 2.0, 3: 3.5}),
                           (Span(5, "Minutes"), {0: 1.0, 1: None, 2: 2.0, 3: 8.0 / 3})):
        got = {r["event_id"]: r["mean"] for r in
               rolling(df, ["mean"], interval, tie="event_id", engine=engine).collect()}
        assert got.keys() == want.keys() and all(_close(got[k], want[k]) for k in want), got
