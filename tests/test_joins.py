"""Above the broadcast bound, joins with per-group tables are salted and give the same answers."""

import hpcstats.plans.joins as J
from hpcstats.functions.intervals import Rows, Span
from hpcstats.operators.box import box_stats
from hpcstats.operators.distribution import histogram, kde
from hpcstats.operators.quantiles import exact_quantiles
from hpcstats.operators.rolling import rolling
from hpcstats.sources.shared_tables import host_view
from helpers import SF_SMALL


def _rounded(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


def _run(h):
    series = h.select("event_id", "time", "event", "value")
    return {
        "box": _rounded(box_stats(h).collect()),
        "hist": _rounded(histogram(h).collect()),
        "kde": _rounded(kde(h).collect()),
        "q": _rounded(exact_quantiles(h, "value", [0.5], by=["event"], in_memory_rows=0, rank_rows=50,
                                    splits=16).collect()),
        "roll_t": _rounded(rolling(series, ["mean", "median"], Span(3, "Hours"), tie="event_id").collect()),
        "roll_r": _rounded(rolling(series, ["std"], Rows(4), tie="event_id").collect()),
    }


def test_salted_joins_equal_broadcast_joins(spark, monkeypatch):
    h = host_view(spark, SF_SMALL)
    broadcast = _run(h)
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", 0)
    salted = _run(h)
    for key in broadcast:
        assert broadcast[key] == salted[key], key


def test_salted_plan_has_no_broadcast(spark, monkeypatch):
    from hpcstats.plans.analysis import explain
    h = host_view(spark, SF_SMALL)
    monkeypatch.setattr(J, "BROADCAST_MAX_ROWS", 0)
    plan = explain(histogram(h))
    assert "_salt" in plan
