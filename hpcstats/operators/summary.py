"""Whole-series statistics per metric.

All of them are one hash aggregate per metric with map-side partial
aggregation, so a metric holding a third of all samples is still spread over
every map task.  The median is the exact one of ``exact_quantiles``.
Results are left-joined from the chosen metric list, so a metric without
samples still has its row (count 0, statistics NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.operators.quantiles import exact_quantiles
from hpcstats.plans.joins import materialize, observed
from hpcstats.sources.readers import missing_as_null
from hpcstats.schema import EVENT_TO_UNIT, EVENTS


def metric_frame(spark, metrics) -> DataFrame:
    """The chosen metrics (at most the six of the dimension) with their units, as a JVM literal table."""
    metrics = list(metrics) if metrics is not None else list(EVENTS)
    rows = [F.struct(F.lit(m).alias("event"), F.lit(EVENT_TO_UNIT.get(m)).cast("string").alias("unit"))
            for m in metrics]
    return spark.range(1).select(F.inline(F.array(*rows)))


def slice_metrics(df: DataFrame, metrics) -> DataFrame:
    """keep the chosen metrics (an IN filter, pushed to the scan).

    No choice means the six metrics of the dimension, so the per-metric
    tables have at most six rows and may be broadcast.
    """
    return df.where(F.col("event").isin(list(metrics) if metrics is not None else list(EVENTS)))


def metric_summary(df: DataFrame, metrics=None, stats=("mean", "median", "std")) -> DataFrame:
    """Per metric n, mean, median, std (each only if asked) of non-null `value`."""
    spark = df.sparkSession
    data = missing_as_null(slice_metrics(df, metrics))
    v = F.col("value")
    aggs = [F.count(v).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    if "mean" in stats:
        aggs.append(F.avg(v).alias("mean"))
    if "std" in stats:
        aggs.append(F.stddev_samp(v).alias("std"))
    per_metric = materialize(data.groupBy("event").agg(*aggs), "summary", {"max_n": F.max("n")})
    out = metric_frame(spark, metrics).join(per_metric, "event", "left")
    if "median" in stats:
        bounds = per_metric.where(F.col("n") > 0).select("event", F.col("n").alias("_n"), "_lo", "_hi")
        bounds._hpcstats_observed = {"max_n": observed(per_metric).get("max_n")}
        med = exact_quantiles(data, "value", [0.5], by=["event"], names=["median"], bounds=bounds)
        out = out.join(med, "event", "left")
    cols = ["event", "unit", F.coalesce(F.col("n"), F.lit(0)).alias("n")]
    cols += [s for s in ("mean", "median", "std") if s in stats]
    return out.select(*cols)


def outside_ratio(df: DataFrame, threshold: float, metrics=None) -> DataFrame:
    """Share of samples with ``|value| > threshold`` per metric.

    The denominator counts every row, NULL values included; NULL/NaN values
    are never outside.  No rows -> NULL ratio (not an error).
    """
    spark = df.sparkSession
    data = missing_as_null(slice_metrics(df, metrics))
    outside = F.count_if(F.abs(F.col("value")) > F.lit(float(threshold)))
    per_metric = data.groupBy("event").agg(F.count(F.lit(1)).alias("n_rows"), outside.alias("n_outside"))
    ratio = F.try_divide(F.col("n_outside"), F.col("n_rows"))
    return (metric_frame(spark, metrics).join(F.broadcast(per_metric), "event", "left")
            .select("event", "unit",
                    F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
                    F.coalesce("n_outside", F.lit(0)).alias("n_outside"),
                    ratio.alias("ratio_outside"),
                    (F.lit(1.0) - ratio).alias("ratio_inside")))
