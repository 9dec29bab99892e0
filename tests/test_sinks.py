"""Export rules: naive UTC, folder names, parallel writers."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from hpcstats.sources.sinks import export, export_name, is_empty, utc_naive, write_csv
from hpcstats.sources.readers import read_host, union_sources
from hpcstats.sources.shared_tables import host_view
from helpers import SF_SMALL


def test_zoned_to_naive_utc(spark):
    df = spark.createDataFrame([(1, "2021-01-01 12:00:00")], "id long, t string") \
        .select("id", F.to_utc_timestamp(F.to_timestamp("t"), "US/Eastern").alias("timestamp"))
    out = utc_naive(df)
    assert dict(out.dtypes)["timestamp"] == "timestamp_ntz"
    assert out.first()["timestamp"] == dt.datetime(2021, 1, 1, 17, 0)
    spark.conf.set("spark.sql.session.timeZone", "US/Eastern")
    try:
        assert utc_naive(df).first()["timestamp"] == dt.datetime(2021, 1, 1, 17, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_export_name():
    assert export_name("job", "csv", "2024-01-01 00:00:00", dt.datetime(2024, 1, 2, 3, 4, 5)) == \
        "job-data-csv-2024-01-01-00-00-00-to-2024-01-02-03-04-05"


def test_csv_roundtrip_and_empty(spark):
    h = host_view(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="hpcstats-test-")
    path = export(h, folder, "host", "2024-01-01", "2024-01-02", fmt="csv")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == h.count() and set(back.columns) == set(h.columns)
    assert is_empty(h.where("value > 1e12")) and not is_empty(h)
    p2 = export(h, folder, "host", "2024-01-01", "2024-01-02", fmt="parquet")
    assert read_host(spark, p2).count() == h.count()


def test_union_sources(spark):
    h = host_view(spark, SF_SMALL)
    parts = [h.where("event = 'cpuuser'"), h.where("event != 'cpuuser'").drop("event_id")]
    u = union_sources(parts)
    assert u.count() == h.count() and "event_id" in u.columns


def test_csv_export_reads_back_with_model_types(spark):
    from hpcstats.operators.summary import metric_summary
    h = host_view(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="hpcstats-test-")
    path = export(h, folder, "host", "2024-01-01", "2024-01-31", fmt="csv")
    back = read_host(spark, path, fmt="csv", header=True)
    assert dict(back.dtypes)["time"] == "timestamp_ntz" and dict(back.dtypes)["value"] == "double"
    a = {r["event"]: (r["n"], r["median"]) for r in metric_summary(h).collect()}
    b = {r["event"]: (r["n"], r["median"]) for r in metric_summary(back).collect()}
    assert a == b
