"""Balanced splits by any column, and the layout of the host table at rest."""

import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import SF_SMALL
from hpcstats.sources.layout import read_host_layout, write_host_layout
from hpcstats.sources.shared_tables import host_view
from hpcstats.sources.splits import split_conditions, split_points, split_read, split_sql


def skewed(spark):
    """Times with two thirds of the rows in one minute; every seventh without a value."""
    rows = spark.range(9000).select(
        "id", F.when(F.col("id") % 7 == 0, None).otherwise(F.timestamp_seconds(
            F.when(F.col("id") % 3 == 0, F.col("id") * 977 + 1_700_000_000).otherwise(1_704_000_000 + F.col("id") % 60)).cast("timestamp_ntz")).alias("time"))
    return rows.select("*", F.concat(F.lit("o'b"), F.date_format("time", "yyyyMMddHHmmss")).alias("name"), F.col("time").cast("date").alias("day"),
                       F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.sin("id")).alias("x"))


@pytest.mark.parametrize("column", ["id", "time", "name", "day", "x"])
def test_pieces_hold_every_row_once(spark, tmp_path, column):
    path = str(tmp_path / "t")
    skewed(spark).repartition(5).write.parquet(path)
    df = spark.read.parquet(path)
    points = split_points(df, column, rows_per_split=500)
    pieces = [sorted(r[0] for r in p.select("id").collect()) for p in split_read(df, column, points)]
    assert sorted(x for p in pieces for x in p) == list(range(9000))
    by_sql = [df.where(text).count() for text in split_sql(column, points)]
    assert by_sql == [len(p) for p in pieces]
    if column in ("id", "x"):   # no value fills a piece
        sizes = [len(p) for p in pieces if p]
        assert 12 <= len(points) <= 18 and max(sizes[:-1]) < 1000
    if column in ("time", "name"):
        assert len(points) >= 12


def test_split_filters_are_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    skewed(spark).write.parquet(path)
    points = [dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)]
    plan = spark.read.parquet(path).where(split_conditions("time", points)[1])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(time,2024-01-01" in plan and "LessThan(time,2024-02-01" in plan


def test_small_and_empty_tables_are_one_piece(spark):
    df = skewed(spark)
    assert split_points(df, "id", rows_per_split=10_000) == [] and split_points(df.limit(0), "id") == []
    assert [p.count() for p in split_read(df, "id", [])] == [9000]
    assert split_sql("id", []) == ["1 = 1"] and split_sql("n", ["a'b"])[0] == "n < 'a''b'"


def test_jdbc_sample_query():
    from hpcstats.sources.readers import sample_query
    assert sample_query("host_data", "time", 0.25) == \
        "(select time as v from host_data where time is not null and random() < 0.250000000000) as sample"


def files_read(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    return leaf.metrics().get("numFiles").get().value()


def test_layout_prunes_folders_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "host")
    h = host_view(spark, SF_SMALL)
    burst = spark.range(3000).select((F.col("id") + 10 ** 6).alias("event_id"), F.timestamp_seconds(1_704_700_000 + F.col("id") * 9).cast("timestamp_ntz").alias("time"),
                                     F.lit("cpuuser").alias("event"), F.col("id").cast("double").alias("value"))
    df = h.unionByName(burst, allowMissingColumns=True).unionByName(burst.limit(3).withColumn("time", F.lit(None).cast("timestamp_ntz")), allowMissingColumns=True)
    write_host_layout(df, path, rows_per_file=500)
    back = read_host_layout(spark, path)
    assert sorted(back.columns) == sorted(df.columns) and back.count() == df.count()
    assert back.select(df.columns).exceptAll(df).isEmpty()
    window = ("2024-01-08 07:30:00", "2024-01-08 08:30:00")
    some = read_host_layout(spark, path, window, ["cpuuser"])
    want = df.where("event = 'cpuuser' and time between '2024-01-08 07:30:00' and '2024-01-08 08:30:00'")
    assert some.count() == want.count() > 250
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time,2024-01-08" in plan
    everything, one_day = files_read(back.select("value")), files_read(some.select("value"))
    assert one_day < everything / 5
    # the hot date lies in several files of disjoint times, each of bounded rows
    ranges = []
    for f in (tmp_path / "host" / "event=cpuuser" / "date=2024-01-08").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        assert meta.num_rows <= 1000
        at = meta.schema.names.index("time")
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        ranges.append((min(s.min for s in stats), max(s.max for s in stats)))
    ranges.sort()
    assert len(ranges) >= 3 and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
