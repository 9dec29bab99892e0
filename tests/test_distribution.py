"""Histogram/CDF/KDE against numpy, box summary against the box-chart rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hpcstats.operators.box import box_outliers, box_source, box_stats
from hpcstats.operators.distribution import cdf, histogram, kde
from hpcstats.functions.intervals import Span
from hpcstats.sources.shared_tables import host_view
from helpers import SF_CHECK, host_frame


@pytest.fixture(scope="module")
def host_pdf(spark):
    h = host_view(spark, SF_CHECK)
    return h, h.select("event", "value").toPandas()


def test_histogram_matches_numpy_auto(spark, host_pdf):
    h, pdf = host_pdf
    got = histogram(h).toPandas()
    for event, sub in pdf.groupby("event"):
        counts, edges = np.histogram(sub["value"].dropna().to_numpy(), bins="auto")
        g = got[got["event"] == event].sort_values("bin")
        assert g["count"].tolist() == counts.tolist()
        assert np.allclose(g["bin_lo"].to_numpy(), edges[:-1]) and np.allclose(g["bin_hi"].to_numpy(), edges[1:])


def test_cdf_running_counts(spark, host_pdf):
    h, pdf = host_pdf
    got = cdf(h).toPandas()
    for event, sub in pdf.groupby("event"):
        counts, _ = np.histogram(sub["value"].dropna().to_numpy(), bins="auto")
        g = got[got["event"] == event].sort_values("bin")
        assert g["cum_count"].tolist() == np.cumsum(counts).tolist()
        assert math.isclose(g["cum_fraction"].iloc[-1], 1.0)


def test_histogram_one_value_and_fixed_bins(spark):
    df = host_frame(spark, [(1, "2024-01-01 00:00:00", "cpuuser", 5.0)])
    r = histogram(df).collect()
    assert len(r) == 1 and r[0]["bin_lo"] == 4.5 and r[0]["bin_hi"] == 5.5 and r[0]["count"] == 1
    assert kde(df).count() == 0   # no spread, no density
    df2 = host_frame(spark, [(i, "2024-01-01 00:00:00", "cpuuser", float(i)) for i in range(10)])
    counts, _ = np.histogram(np.arange(10.0), bins=4)
    got = histogram(df2, bins=4).orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()


def test_kde_matches_formula(spark, host_pdf):
    h, pdf = host_pdf
    got = kde(h).toPandas()
    for event, sub in pdf.groupby("event"):
        x = sub["value"].dropna().to_numpy()
        bw = x.std(ddof=1) * len(x) ** (-0.2)
        grid = np.linspace(x.min(), x.max(), 200)
        dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
        g = got[got["event"] == event].sort_values("point")
        assert np.allclose(g["x"].to_numpy(), grid) and np.allclose(g["density"].to_numpy(), dens, rtol=1e-10)
        _, edges = np.histogram(x, bins="auto")
        assert np.allclose(g["count_density"].to_numpy(), dens * len(x) * (edges[1] - edges[0]))


def _box_reference(x, whis=1.5):
    """The box-chart rules, written out from their documentation."""
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    hi_in = x[x <= q3 + whis * iqr]
    lo_in = x[x >= q1 - whis * iqr]
    whishi = q3 if len(hi_in) == 0 or hi_in.max() < q3 else hi_in.max()
    whislo = q1 if len(lo_in) == 0 or lo_in.min() > q1 else lo_in.min()
    fliers = np.concatenate([x[x < whislo], x[x > whishi]])
    half = 1.57 * iqr / np.sqrt(len(x))
    return dict(n=len(x), mean=x.mean(), q1=q1, median=med, q3=q3, iqr=iqr, whislo=whislo, whishi=whishi,
                notch_lo=med - half, notch_hi=med + half, n_outliers=len(fliers))


def test_box_matches_rules(spark, host_pdf):
    h, pdf = host_pdf
    got = box_stats(h).toPandas().set_index("event")
    out = box_outliers(h).groupBy("event").count().toPandas().set_index("event")["count"]
    for event, sub in pdf.groupby("event"):
        want = _box_reference(sub["value"].dropna().to_numpy())
        row = got.loc[event]
        for k, v in want.items():
            assert math.isclose(row[k], v, rel_tol=1e-9, abs_tol=1e-12), (event, k)
        assert out.get(event, 0) == want["n_outliers"]


def test_box_whiskers_fall_back_to_quartiles(spark):
    # every value outside the fences on one side -> whisker = quartile
    vals = [0.0] * 10 + [100.0]
    df = host_frame(spark, [(i, "2024-01-01 00:00:00", "cpuuser", v) for i, v in enumerate(vals)])
    r = box_stats(df).first()
    want = _box_reference(np.array(vals))
    assert r["whishi"] == want["whishi"] and r["whislo"] == want["whislo"] and r["n_outliers"] == 1


def test_box_source_rolling(spark):
    h = host_view(spark, "/root/testdata/sf0.001").select("event_id", "time", "event", "value")
    src = box_source(h, ["mean", "std"], Span(3, "Hours"), source="rolling", tie="event_id")
    assert set(src.columns) == {"event", "statistic", "value"}
    assert src.count() == 2 * h.count()
    assert box_source(h, source="raw").count() == h.count()
    with pytest.raises(ValueError):
        box_source(h, source="other")


def test_kde_reach_skips_only_zero_terms(spark):
    # enough rows that a row reaches only part of the grid (bandwidth << range)
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(0, 1, 200_000), rng.normal(40, 0.5, 100_000), [-3000.0, 9000.0]])
    pdf = pd.DataFrame({"event": "cpuuser", "value": x})
    got = kde(spark.createDataFrame(pdf)).orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** (-0.2)
    assert 40 * bw < (x.max() - x.min()) / 4          # the reach really cuts the grid
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.array([np.exp(-0.5 * ((g - x) / bw) ** 2).sum() for g in grid]) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.allclose(got["density"].to_numpy(), dens, rtol=1e-9, atol=0)


@pytest.mark.parametrize("kind", ["normal", "heavy", "copies"])
def test_kde_equals_the_plain_sum(spark, kind):
    """The box expansion against every value's kernel at every grid point."""
    rng = np.random.default_rng(11)
    values = {"normal": rng.normal(1e6, 3, 700), "heavy": np.concatenate([rng.normal(0, 1, 400), [1e5, -2e4, 5e4]]),
              "copies": np.repeat([1.0, 2.0, 2.5], [300, 5, 200])}[kind]
    df = host_frame(spark, [(i, "2024-01-01 00:00:00", "nfs", float(v)) for i, v in enumerate(values)])
    got = kde(df).orderBy("point").toPandas()
    h = values.std(ddof=1) * len(values) ** -0.2
    grid = got["x"].to_numpy()
    want = np.exp(-0.5 * ((grid[:, None] - values[None, :]) / h) ** 2).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi))
    assert len(got) == 200 and np.allclose(got["density"], want, rtol=1e-9, atol=0)


def test_kde_keeps_one_record_per_box(spark):
    from hpcstats.operators.distribution import _box_moments
    rows = spark.range(20_000).repartition(3).selectExpr("'nfs' as event", "cast(id % 1000 as double) as value", "0D as lo", "999D as hi", "200D as h")
    boxes = _box_moments(rows, ["event"]).collect()
    assert len(boxes) == 50 and 0.99 * 20_000 < sum(b["_m0"] for b in boxes) <= 20_000
