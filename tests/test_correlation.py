"""Pearson correlation: values, p-values and guards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hpcstats.functions.pvalue import pearson_p
from hpcstats.operators.correlation import common_times, paired_points, pearson, pearson_pairs
from hpcstats.plans.catalog import hourly
from helpers import SF_CHECK, host_frame


@pytest.mark.parametrize("r,n,p", [(0.5, 10, 0.14111), (0.2, 100, 0.04604), (0.9, 3, 0.28713)])
def test_p_values(r, n, p):
    assert abs(pearson_p(r, n) - p) < 5e-6


def test_p_value_edges():
    assert pearson_p(0.3, 2) == 1.0 and pearson_p(1.0, 10) == 0.0 and pearson_p(None, 10) is None
    assert abs(pearson_p(0.0, 50) - 1.0) < 1e-12


def test_pearson_on_shared_table(spark):
    h = hourly(spark, SF_CHECK)
    r = pearson(h, "cpuuser", "memused", tie="event_id").first()
    assert r["status"] == "ok" and r["n"] == 628
    assert abs(r["correlation"] - (-0.030066)) < 1e-6 and abs(r["p_value"] - 0.45198) < 1e-5
    pts = paired_points(h, "cpuuser", "memused", tie="event_id").toPandas()
    assert len(pts) == 628 == common_times(h, "cpuuser", "memused").count()
    assert abs(np.corrcoef(pts["x"], pts["y"])[0, 1] - r["correlation"]) < 1e-12


def test_guards(spark):
    rows = [(1, "2024-01-01 00:00:00", "cpuuser", 1.0), (2, "2024-01-01 00:00:00", "memused", 5.0),
            (3, "2024-01-01 01:00:00", "cpuuser", 2.0), (4, "2024-01-01 01:00:00", "memused", 5.0),
            (5, "2024-01-01 02:00:00", "cpuuser", 3.0), (6, "2024-01-01 03:00:00", "nfs", 1.0)]
    df = host_frame(spark, rows)
    got = {(r["metric_x"], r["metric_y"]): r for r in
           pearson_pairs(df, ["cpuuser", "memused", "nfs", "block"], tie="event_id").collect()}
    assert got[("cpuuser", "memused")]["status"] == "constant"
    assert got[("cpuuser", "memused")]["correlation"] is None
    assert got[("cpuuser", "nfs")]["status"] == "insufficient_samples"
    assert got[("memused", "block")]["status"] == "insufficient_samples"
    with pytest.raises(ValueError):
        pearson(df, "nfs", "nfs")


def test_keep_first_per_time(spark):
    rows = [(1, "2024-01-01 00:00:00", "cpuuser", 1.0), (2, "2024-01-01 00:00:00", "cpuuser", 100.0),
            (3, "2024-01-01 00:00:00", "memused", 2.0), (4, "2024-01-01 01:00:00", "cpuuser", 2.0),
            (5, "2024-01-01 01:00:00", "memused", 4.0), (6, "2024-01-01 02:00:00", "cpuuser", 3.0),
            (7, "2024-01-01 02:00:00", "memused", 7.0)]
    df = host_frame(spark, rows)
    r = pearson(df, "cpuuser", "memused", tie="event_id").first()
    assert r["n"] == 3 and math.isclose(r["correlation"], np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])


def test_p_value_expression_equals_the_function(spark):
    from hpcstats.functions.pvalue import p_value
    rng = np.random.default_rng(2)
    rows = [(float(r), int(n)) for n in (2, 3, 4, 5, 10, 59, 60, 61, 1000, 10 ** 6, 10 ** 10) for r in (*rng.uniform(-1, 1, 4), 0.0, 1e-9, 1e-5, 0.999999, 1.0, -1.0)]
    rows += [(None, 5), (0.5, None), (0.5, 1), (float("nan"), 9)]
    for r, n, p in spark.createDataFrame(rows, "r double, n long").withColumn("p", p_value(F.col("r"), F.col("n"))).collect():
        want = pearson_p(r, n)
        assert (p is None) == (want is None) and (p is None or abs(p - want) <= 1e-12 + 1e-9 * want), (r, n, p, want)


def test_many_pairs_by_blocks_equal_pairs_one_by_one(spark, monkeypatch):
    """Drifting, constant, missing and rare metrics: the matrices of blocks give what the copies per pair give."""
    from hpcstats.operators import correlation as c
    h = hourly(spark, SF_CHECK).select("event_id", "time", "event", "value")
    extra = [h.where(f"event = 'cpuuser' and event_id % {k + 2} = 0").withColumn("event", F.lit(f"m{k}")).withColumn(
        "value", F.when(F.lit(k == 3), F.lit(0.1)).when(F.lit(k == 4) & (F.col("event_id") % 5 == 0), F.lit(None)).otherwise(
            F.col("value") * (k + 1) + F.col("event_id") * 1e4 * (k % 2) + 1e6)) for k in range(8)]
    df = h
    for e in extra:
        df = df.unionByName(e)
    metrics = ["cpuuser", "memused", "nfs", *[f"m{k}" for k in range(8)], "absent"]
    monkeypatch.setattr(c, "SPREAD_PAIRS", 10 ** 6)
    one = {(r.metric_x, r.metric_y): r for r in pearson_pairs(df, metrics, tie="event_id").collect()}
    monkeypatch.setattr(c, "SPREAD_PAIRS", 10)
    blocks = pearson_pairs(df, metrics, tie="event_id")
    many = {(r.metric_x, r.metric_y): r for r in blocks.collect()}
    assert one.keys() == many.keys() and len(one) == 66
    for k, a in one.items():
        b = many[k]
        assert (a.n_x, a.n_y, a.n, a.status) == (b.n_x, b.n_y, b.n, b.status), k
        for x, y in ((a.correlation, b.correlation), (a.p_value, b.p_value)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), k
    assert {r.status for r in many.values()} >= {"ok", "constant", "missing_values", "insufficient_samples"}
