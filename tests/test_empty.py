"""Empty input: every operator returns its schema without error (FIXTURES 2.3)."""

import pytest

from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.rules import host_rules
from hpcstats.operators.box import box_outliers, box_stats
from hpcstats.operators.correlation import paired_points, pearson, pearson_pairs
from hpcstats.operators.distribution import cdf, histogram, kde
from hpcstats.operators.quality import audit, quarantine
from hpcstats.operators.rolling import rolling
from hpcstats.operators.summary import metric_summary, outside_ratio
from hpcstats.plans.analysis import analyse
from hpcstats.sources.shared_tables import host_view
from helpers import SF_SMALL


@pytest.fixture(scope="module")
def empty(spark):
    return host_view(spark, SF_SMALL).where("value > 1e300")


def test_statistics_on_empty(spark, empty):
    s = {r["event"]: r for r in metric_summary(empty).collect()}
    assert len(s) == 6 and all(r["n"] == 0 and r["median"] is None for r in s.values())
    assert all(r["ratio_outside"] is None for r in outside_ratio(empty, 1.0).collect())
    for frame in (histogram(empty), cdf(empty), kde(empty), box_stats(empty), box_outliers(empty),
                  paired_points(empty, "cpuuser", "memused", tie="event_id")):
        assert frame.count() == 0 and len(frame.columns) > 1
    r = pearson(empty, "cpuuser", "memused", tie="event_id").first()
    assert r["status"] == "insufficient_samples" and r["correlation"] is None
    assert pearson_pairs(empty, ["cpuuser", "memused", "nfs"]).count() == 3


@pytest.mark.parametrize("engine", ["spark", "pandas"])
def test_rolling_on_empty(spark, empty, engine):
    for interval in (Rows(3), Span(1, "Hours")):
        out = rolling(empty.select("event_id", "time", "event", "value"), ["mean", "median"], interval,
                      tie="event_id", engine=engine)
        assert out.count() == 0 and out.columns == ["event_id", "time", "event", "value", "mean", "median"]


def test_quality_and_analysis_on_empty(spark, empty):
    assert {r["n_failed"] for r in audit(empty, host_rules()).collect()} == {0}
    assert quarantine(empty, host_rules()).count() == 0
    res = analyse(empty, ["Mean", "PDF", "CDF"], interval=Span(2, "Hours"), tie="event_id")
    assert all(df.count() == 0 for k, df in res.items())
