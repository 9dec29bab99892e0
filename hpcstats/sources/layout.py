"""The host table at rest: partitions by metric and date, files bounded by rows and cut by time.

``write_host_layout`` counts the samples of every (event, date) and writes
``ceil(rows / rows_per_file)`` files for it, each a range of its time: a hot date
is range-split inside, at quantiles of its own times, and rows are sorted by time
within a file, so row groups hold narrow ranges.  ``read_host_layout`` turns a
time window into a condition on the date partitions as well, so a window and a
choice of metrics read only their folders, files and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hpcstats.functions.predicates import to_datetime
from hpcstats.functions.text import wall_micros
from hpcstats.plans.joins import join_small, materialize
from hpcstats.sources.readers import conform_host
from hpcstats.sources.sinks import utc_naive

ROWS_PER_FILE = 5_000_000
MOST_CUTS = 4096         # files of one metric and date that get cuts of their own; above it each holds more rows
KEY = ["event", "date"]


def write_host_layout(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "error", compression: str = "zstd") -> str:
    """Write samples as ``event=.../date=.../part-*.parquet`` (samples without a time, or a metric, have a folder of their own)."""
    df = utc_naive(df).withColumn("date", F.col("time").cast("date")).withColumn("_at", wall_micros("time"))
    counts = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    files = F.least(F.lit(MOST_CUTS), F.ceil(F.col("_n") / rows_per_file)).cast("int")
    sized = materialize(counts.select(*KEY, "_n", files.alias("_files")), "layout-sizes", {"most": F.max("_files")})
    hot = sized.where("_files > 1").select(*KEY, "_files")
    # cuts of the hot dates: quantiles of their times, from a mergeable summary
    dense = join_small(df.select(*KEY, "_at"), hot, KEY)
    summary = dense.groupBy(*KEY, "_files").agg(F.percentile_approx("_at", _evenly(MOST_CUTS if sized._hpcstats_observed["most"] == MOST_CUTS
                                                                                   else max(2, sized._hpcstats_observed["most"] or 2)), 100_000).alias("_q"))
    picked = F.transform(F.sequence(F.lit(1), F.col("_files") - 1), lambda k: F.get("_q", F.floor(k * F.size("_q") / F.col("_files")).cast("int") - 1))
    cuts = materialize(summary.select(*KEY, F.array_distinct(picked).alias("_cuts")), "layout-cuts")
    placed = join_small(df, cuts, KEY, "left")
    slot = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_at"))), F.lit(0))
    slot = F.when(F.col("_cuts").isNull(), 0).otherwise(slot)
    dealt = placed.withColumn("_slot", slot).repartition(*KEY, "_slot").sortWithinPartitions(*KEY, "_at").drop("_at", "_cuts", "_slot")
    writer = dealt.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", 2 * rows_per_file)
    writer.partitionBy(*KEY).parquet(path)
    return path


def _evenly(n: int):
    return F.array(*[F.lit((i + 1) / n) for i in range(n)])


def read_host_layout(spark: SparkSession, path: str, window=None, metrics=None) -> DataFrame:
    """Samples of a layout, of a time window (both ends included) and metrics if given; only their folders and row groups are read."""
    df = spark.read.parquet(path)
    if metrics is not None:
        df = df.where(F.col("event").isin(list(metrics)))
    if window is not None:
        start, end = (to_datetime(x) for x in window)
        df = df.where(F.col("date").between(F.lit(start.date()), F.lit(end.date())) & F.col("time").between(F.lit(start), F.lit(end)))
    return conform_host(df.drop("date"))
