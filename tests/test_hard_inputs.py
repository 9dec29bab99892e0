"""Inputs that the clean shared tables do not hold: NULL keys, infinities, session zones, long lists, big integers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.predicates import FilterSpec, Predicate
from hpcstats.functions.pvalue import pearson_p
from hpcstats.functions.rules import host_rules, job_rules, numeric_text
from hpcstats.operators.box import box_stats
from hpcstats.operators.extract import extract
from hpcstats.operators.quality import audit, quarantine
from hpcstats.operators.rolling import rolling
from hpcstats.plans.analysis import analyse
from hpcstats.sources.dirty import samples_dirty
from hpcstats.sources.shared_tables import host_view, job_view

STATS = ["mean", "median", "std"]


def _answers(df, extra=()):
    return {r.event_id: tuple(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in (*STATS, *extra))
            for r in df.collect()}


@pytest.mark.parametrize("interval", [Span(6, "Hours"), Rows(3)])
def test_rolling_has_one_answer_on_every_path(spark, interval):
    h = samples_dirty(spark, SF_SMALL).where("event in ('cpuuser', 'block')")
    by = ("event", "host")
    want = _answers(rolling(h, STATS, interval, by=by, tie="event_id"), ["big"])
    assert len(want) == h.count() and any(v[-1] and v[-1] > 2 ** 53 and v[-1] % 2 for v in want.values())
    assert {r.event_id: r.value for r in rolling(h, STATS, interval, by=by, tie="event_id").collect()} == \
        {r.event_id: r.value for r in h.collect()}   # the value itself passes unchanged, infinities too
    zone = spark.conf.get("spark.sql.session.timeZone")
    for kw in ({"split": False}, {"engine": "spark"}, {"engine": "pandas"}, {"target_rows": 5, "chunk_rows": 7}):
        assert _answers(rolling(h, STATS, interval, by=by, tie="event_id", **kw), ["big"]) == want, kw
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert _answers(rolling(h, STATS, interval, by=by, tie="event_id"), ["big"]) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_windows_cross_a_clock_change(spark):
    times = [dt.datetime(2024, 3, 10, 1) + dt.timedelta(minutes=30 * i) for i in range(6)]
    df = spark.createDataFrame([(i, t.isoformat(sep=" "), "cpuuser", float(i + 1)) for i, t in enumerate(times)],
                               "event_id long, time string, event string, value double").withColumn("time", F.to_timestamp_ntz("time"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for engine in ("auto", "spark", "pandas"):
            rows = rolling(df, ["mean", "median"], Span(1, "Hours"), tie="event_id", engine=engine).orderBy("event_id").collect()
            assert [r.mean for r in rows] == [r.median for r in rows] == [1.0, 1.5, 2.5, 3.5, 4.5, 5.5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_box_keeps_the_null_group(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", float(i)) for i in range(5)], "event string, value double")
    assert {r.event: (r.n, r.median) for r in box_stats(df).collect()} == {None: (9, 4.0), "a": (5, 2.0)}


def test_rules_on_very_long_texts(spark):
    good = ",".join(f"node{i} " for i in range(100_000))
    rows = [("JOB1", good), ("JOB2", good + ",rack"), ("JOB3", "NODE" + "7" * 200_000), ("JOB4", None)]
    jobs = spark.createDataFrame(rows, "jid string, host_list string")
    counts = {r.rule: r.n_failed for r in audit(jobs, job_rules(["jid", "host_list"])).collect()}
    assert counts == {"jid_format": 0, "host_list_format": 1}
    assert [r.jid for r in quarantine(jobs, job_rules(["jid", "host_list"])).collect()] == ["JOB2"]
    numbers = ["1" * 100_000, "1_" * 50_000 + "1", "1_" * 50_000, "1__0", "_1", "1_.5", "1._5", "1_0.5_0e1_0", " +.5 ", "1e", ".", "", "NaN", "-Infinity"]
    found = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, value string").select("i", numeric_text("value").alias("ok"))
    assert [r.ok for r in found.orderBy("i").collect()] == [True, True, False, False, False, False, False, True, True, False, False, False, True, True]
    assert host_rules(["value"])


def test_numbers_are_bound_exactly(spark):
    df = spark.createDataFrame([(2 ** 53,), (2 ** 53 + 1,), (2 ** 53 + 2,)], "ncores long")
    count = lambda op, v: extract(df, FilterSpec("job", columns=("ncores",), predicates=(Predicate("ncores", op, v),))).count()
    assert count("=", "9007199254740993") == 1 and count("=", 9007199254740993) == 1
    assert count(">", "9007199254740993.5") == 1 and count("=", "1e2") == 0 and count("<", "inf") == 3
    assert count("=", str(2 ** 70)) == 0
    with pytest.raises(ValueError):
        count("=", "many")


def test_long_in_lists_are_joined(spark):
    jobs = job_view(spark, SF_SMALL)
    values = tuple(f"JOB{i}" for i in range(0, 400_000, 2))
    spec = FilterSpec("job", columns=("jid",), in_column="jid", in_values=values)
    found = extract(jobs, spec)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and len(plan) < 20_000
    assert found.count() == jobs.where("cast(substring(jid, 4) as long) % 2 = 0").count()
    whole = extract(jobs, FilterSpec("job", columns=("nhosts",), in_column="nhosts", in_values=tuple(str(i) for i in range(2, 3000))))
    assert whole.count() == jobs.where("nhosts >= 2").count()
    with pytest.raises(ValueError):
        extract(jobs, FilterSpec("job", in_column="nhosts", in_values=tuple(f"x{i}" for i in range(2000))))


@pytest.mark.parametrize("n", [10 ** 6, 10 ** 8, 10 ** 10, 10 ** 12])
def test_p_values_of_very_many_pairs(n):
    for t in (0.1, 1.0, 3.0):
        nu = n - 2
        got = pearson_p(t / math.sqrt(nu + t * t), n)
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        want = math.erfc(t / math.sqrt(2)) + density * (t + t ** 3) / (2 * nu)   # Student's tails, expanded about the normal's
        assert got == pytest.approx(want, rel=1e-8)


def test_analyse_without_a_statistic_and_by_host(spark):
    h = host_view(spark, SF_SMALL)
    for none in (["None"], [None], "None", None, []):
        assert list(analyse(h, none)) == ["series"]
    out = analyse(h, ["Mean"], interval=Span(6, "Hours"), by=("event", "host"), tie="event_id")
    assert "host" in out["rolling"].columns and out["box"].select("event", "host").distinct().count() == out["box"].count()
    assert out["rolling"].count() == h.count()
