"""Filter specs, typed binding, time-window rule and metric choice."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hpcstats.functions.predicates import (FilterSpec, Predicate, check_window, normalise_value, select_metrics,
                                           split_list)
from hpcstats.operators.extract import extract, row_count
from hpcstats.sources.shared_tables import host_view, job_view
from helpers import SF_SMALL


def test_window_rule():
    with pytest.raises(ValueError, match="Invalid Times"):
        check_window("2024-01-02", "2024-01-01", 5)
    with pytest.raises(ValueError, match="Invalid Times"):
        check_window("2024-01-02", "2024-01-02", 5)
    with pytest.raises(ValueError, match="Time Window Too Large"):
        check_window("2024-01-01", "2024-01-07", 5)
    # 5 days 23:59:59 is still 5 whole days
    s, e = check_window("2024-01-01 00:00:00", "2024-01-06 23:59:59", 5)
    assert (e - s).days == 5
    check_window("2024-01-01", "2025-01-01", None)


def test_spec_add_remove_and_normalise():
    spec = FilterSpec("host").add("jid", "=", "job12").add("event", "=", "cpuuser")
    assert spec.predicates[0].value == "JOB12" and spec.predicates[1].value == "cpuuser"
    assert len(spec.remove(0).predicates) == 1 and len(spec.predicates) == 2
    assert FilterSpec("job").add("queue", "=", "debug").predicates[0].value == "DEBUG"
    assert normalise_value("host", "node3") == "NODE3"
    assert normalise_value("host", "CPU %") == "CPU %"
    assert split_list("a, b ,c") == ["a", "b", "c"]


def test_in_values_rules():
    assert FilterSpec("host", in_column="host", in_values="").in_values == ()
    assert FilterSpec("host", in_column="host", in_values=" , NODE1").in_values == ()
    with pytest.raises(ValueError):
        FilterSpec("host", in_values="NODE1")


def test_select_metrics_rule():
    assert select_metrics(None) == ["cpuuser", "gpu_usage", "memused", "memused_minus_diskcache", "block", "nfs"]
    assert select_metrics(FilterSpec("host").add("unit", "=", "GB/s")) == ["block"]
    assert select_metrics(FilterSpec("host").add("event", "!=", "cpuuser")) == ["cpuuser"]
    assert len(select_metrics(FilterSpec("host").add("host", "=", "NODE1"))) == 6


def test_typed_binding_and_like(spark):
    jobs = job_view(spark, SF_SMALL)
    got = extract(jobs, FilterSpec("job").add("ncores", "<", "700.5")).count()
    want = jobs.where(F.col("ncores") < 700.5).count()
    assert got == want and got > 0
    with pytest.raises(ValueError, match="LIKE"):
        extract(jobs, FilterSpec("job").add("ncores", "LIKE", "1%"))
    with pytest.raises(ValueError, match="Invalid column name selected"):
        extract(jobs, FilterSpec("job", columns=("jid", "nope")))
    with pytest.raises(ValueError):
        Predicate("jid", "=~", "JOB1")
    assert Predicate("jid", "<>", "JOB1").op == "!="


def test_extract_order_limit_nulls(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "id long, value double")
    asc = extract(df, FilterSpec("host", order_by=("value",)))
    assert [r["id"] for r in asc.collect()] == [3, 1, 2]
    desc = extract(df, FilterSpec("host", order_by=("value",), descending=True, limit=2))
    assert [r["id"] for r in desc.collect()] == [2, 1]


def test_time_window_pushed_down(spark):
    h = host_view(spark, SF_SMALL)
    x = extract(h, FilterSpec("host", window=(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 6))))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert row_count(x).first()[0] == x.count()


def test_jdbc_options_need_all_variables():
    from hpcstats.sources.readers import jdbc_options
    with pytest.raises(ValueError, match="DBPW"):
        jdbc_options("host_data", env={"DBHOST": "h", "DBNAME": "d", "DBUSER": "u"})
    opts = jdbc_options("job_data", env={"DBHOST": "h", "DBNAME": "d", "DBUSER": "u", "DBPW": "p"},
                        partition_column="jid_num", lower_bound=0, upper_bound=100, num_partitions=8)
    assert opts["url"] == "jdbc:postgresql://h:5432/d" and opts["numPartitions"] == "8"


def test_read_job_and_parameterised_sql(spark, tmp_path):
    from hpcstats.sources.readers import read_job, run_sql
    jobs = job_view(spark, SF_SMALL)
    path = str(tmp_path / "jobs")
    jobs.write.parquet(path)
    back = read_job(spark, path)
    assert back.columns[:3] == ["jid", "submit_time", "start_time"] and back.count() == jobs.count()
    got = run_sql(spark, "select count(*) from jobs where queue = :q and ncores < :c", {"q": "debug", "c": 700.5},
                  views={"jobs": back}).first()[0]
    assert got == jobs.where("queue = 'debug' and ncores < 700.5").count()


def test_order_by_must_be_selected(spark):
    h = host_view(spark, SF_SMALL)
    with pytest.raises(ValueError, match="ORDER BY"):
        extract(h, FilterSpec("host", columns=("host",), order_by=("value",)))
    out = extract(h, FilterSpec("host", columns=("host",), distinct=True, order_by=("host",)))
    assert [r["host"] for r in out.collect()] == sorted({r["host"] for r in h.select("host").collect()})


def test_time_text_functions(spark):
    from hpcstats.functions.text import fixed, stamp, whole_days
    df = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-06 23:59:59", 3.14159)], "s string, e string, v double") \
        .select(F.to_timestamp_ntz("s").alias("s"), F.to_timestamp_ntz("e").alias("e"), "v")
    r = df.select(stamp("e").alias("st"), whole_days("s", "e").alias("d"), fixed("v").alias("f"),
                  fixed("v", 10).alias("f10")).first()
    assert (r["st"], r["d"], r["f"], r["f10"]) == ("2024-01-06-23-59-59", 5, "3.14", "3.1415900000")


def test_jdbc_bounds_query():
    from hpcstats.sources.readers import bounds_query
    assert bounds_query("job_data", "jobnum") == \
        "(select min(jobnum) as lo, max(jobnum) as hi, count(*) as n from job_data) as bounds"


def test_extract_equals_parameterised_sql(spark):
    """The extract returns what the original's SQL text with bound values returns."""
    from hpcstats.sources.readers import run_sql
    h, j = host_view(spark, SF_SMALL), job_view(spark, SF_SMALL)
    views = {"host_data": h, "job_data": j}
    cases = [
        (extract(h, FilterSpec("host", columns=("host", "value"))), "SELECT host, value FROM host_data", {}),
        (extract(h, FilterSpec("host", columns=("host", "value"), predicates=(
            Predicate("host", "=", "NODE3"), Predicate("event", "<>", "nfs")))),
         "SELECT host, value FROM host_data WHERE host = :p0 AND event <> :p1", {"p0": "NODE3", "p1": "nfs"}),
        (extract(h, FilterSpec("host", columns=("host", "value"), predicates=(Predicate("host", "=", "NODE3"),),
                               window=("2024-01-02 00:00:00", "2024-01-05 00:00:00"))),
         "SELECT host, value FROM host_data WHERE host = :p0 AND time BETWEEN "
         "CAST(:s AS TIMESTAMP_NTZ) AND CAST(:e AS TIMESTAMP_NTZ)",
         {"p0": "NODE3", "s": "2024-01-02 00:00:00", "e": "2024-01-05 00:00:00"}),
        (extract(j, FilterSpec("job", columns=("jid", "runtime"), predicates=(Predicate("runtime", "<", "7200"),),
                               window=("1995-01-01 00:00:00", "1995-06-01 00:00:00"))),
         "SELECT jid, runtime FROM job_data WHERE runtime < :p0 AND start_time BETWEEN "
         "CAST(:s AS TIMESTAMP_NTZ) AND CAST(:e AS TIMESTAMP_NTZ)",
         {"p0": 7200.0, "s": "1995-01-01 00:00:00", "e": "1995-06-01 00:00:00"}),
    ]
    for got, text, args in cases:
        want = run_sql(spark, text, args, views=views)
        assert sorted(got.collect()) == sorted(want.collect()), text


def test_job_window_is_on_start_time_and_series_is_ordered(spark):
    jobs = job_view(spark, SF_SMALL)
    spec = FilterSpec.with_default_cap("job", window=("1996-01-01 00:00:00", "1996-03-01 00:00:00"))
    got = extract(jobs, spec)
    want = jobs.where(F.col("start_time").between(F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"),
                                                  F.lit("1996-03-01 00:00:00").cast("timestamp_ntz")))
    assert got.count() == want.count() > 0
    assert got.where(F.col("submit_time") > F.lit("1996-03-01 00:00:00").cast("timestamp_ntz")).count() == 0
    with pytest.raises(ValueError, match="Too Large"):
        FilterSpec.with_default_cap("job", window=("1996-01-01", "1996-07-01"))
    series = extract(host_view(spark, SF_SMALL),
                     FilterSpec("host", columns=("time", "event_id"), order_by=("time", "event_id"))).collect()
    assert series == sorted(series)
