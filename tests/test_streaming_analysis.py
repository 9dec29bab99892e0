"""Streaming filters/quarantine and the whole-analysis call."""

import tempfile

import pytest
from pyspark.sql import functions as F

from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.predicates import FilterSpec, Predicate
from hpcstats.functions.rules import host_rules
from hpcstats.operators.extract import drop_aux, series_columns, with_unit
from hpcstats.plans.analysis import analyse, explain
from hpcstats.sources.shared_tables import host_view
from hpcstats.streaming import filter_stream, read_host_stream, split_by_rules, write_stream
from helpers import SF_SMALL


def test_stream_filter_and_quarantine(spark):
    h = host_view(spark, SF_SMALL)
    src = tempfile.mkdtemp(prefix="hpcstats-stream-src-")
    h.drop("event_id").withColumn("unit", F.when(F.col("event") == "nfs", F.lit("MB")).otherwise(F.col("unit"))) \
        .write.mode("overwrite").parquet(src)
    stream = read_host_stream(spark, src, max_files_per_trigger=1)
    spec = FilterSpec("host", predicates=(Predicate("value", ">", 10),))
    good, bad = split_by_rules(filter_stream(stream, spec), host_rules())
    out, qdir = tempfile.mkdtemp(prefix="hpcstats-stream-out-"), tempfile.mkdtemp(prefix="hpcstats-stream-q-")
    q1 = write_stream(good, out, out + "/_ckpt")
    q2 = write_stream(bad, qdir, qdir + "/_ckpt")
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    n_good = spark.read.parquet(out).count()
    n_bad = spark.read.parquet(qdir).count()
    assert n_bad == h.where("value > 10 and event = 'nfs'").count() > 0
    assert n_good + n_bad == h.where("value > 10").count()
    with pytest.raises(ValueError):
        filter_stream(stream, FilterSpec("host", limit=5))


def test_analyse_whole_and_rolling(spark):
    h = host_view(spark, SF_SMALL)
    res = analyse(h, ["Mean", "Median", "Standard Deviation", "PDF", "CDF", "Ratio of Data Outside Threshold"],
                  threshold=50.0)
    assert set(res) == {"series", "summary", "box", "histogram", "kde", "cdf", "outside"}
    assert res["summary"].count() == 6 and res["box"].where("statistic = 'raw'").count() == 5
    rolled = analyse(h, ["Mean", "Standard Deviation"], interval=Span(3, "Hours"), tie="event_id")
    assert rolled["rolling"].count() == h.count()
    assert {r["statistic"] for r in rolled["box"].collect()} == {"mean", "std"}
    picked = analyse(h, ["Mean"], interval=Rows(3), spec=FilterSpec("host").add("unit", "=", "MB/s"),
                     tie="event_id")
    assert {r["event"] for r in picked["rolling"].select("event").distinct().collect()} == {"nfs"}
    with pytest.raises(ValueError):
        analyse(h, ["Mode"])
    assert "Scan parquet" in explain(res["summary"])


def test_projection_helpers(spark):
    df = spark.createDataFrame([(1, "cpuuser", 2.0, "x", 1.0, 2.0)], "id long, event string, value double, "
                                                                     "type string, diff double, arc double")
    assert drop_aux(df).columns == ["id", "event", "value"]
    assert with_unit(df.select("event")).first()["unit"] == "CPU %"
    with pytest.raises(ValueError):
        series_columns(df)


def test_analyse_row_interval_and_engine(spark):
    h = host_view(spark, SF_SMALL)
    a = analyse(h, ["Mean", "Median"], interval=Rows(4), tie="event_id", engine="spark")
    b = analyse(h, ["Mean", "Median"], interval=Rows(4), tie="event_id", engine="pandas")
    ra = {r["event_id"]: (r["mean"], r["median"]) for r in a["rolling"].collect()}
    rb = {r["event_id"]: (r["mean"], r["median"]) for r in b["rolling"].collect()}
    assert ra.keys() == rb.keys() and len(ra) == h.count()
    assert all((x is None and y is None) or abs(x - y) < 1e-9 for k in ra for x, y in zip(ra[k], rb[k]))
    assert {r["statistic"] for r in a["box"].collect()} == {"mean", "median"}
