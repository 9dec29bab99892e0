"""Box-and-whisker summaries.

Per group: n, mean, q1, median, q3, iqr, whiskers, notch and the number of
outliers, with the rules of the box chart: whiskers at 1.5*IQR clipped to the
most extreme data value inside the fences (q1/q3 when no value is inside or
the value lies inside the box), notch ``median +- 1.57*IQR/sqrt(n)``, outliers
= values beyond the whiskers.  ``box_outliers`` returns the outlier rows
themselves as a DataFrame (never collected).

Passes: n/min/max, exact quartiles (see ``exact_quantiles``), then one
aggregate over the rows joined with their group's fences (checked broadcast)
for mean, whiskers and the outlier count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.functions.intervals import Rows, Span
from hpcstats.operators.quantiles import exact_quantiles, group_bounds
from hpcstats.operators.rolling import rolling
from hpcstats.plans.joins import join_null_safe, join_small, materialize, stored_columns
from hpcstats.sources.readers import missing_as_null

WHIS = 1.5


def _fences(data: DataFrame, by: list[str], whis: float) -> DataFrame:
    bounds = materialize(group_bounds(data, "value", by), "box-bounds", {"max_n": F.max("_n")})
    q = exact_quantiles(data, "value", [0.25, 0.5, 0.75], by=by, names=["q1", "median", "q3"], bounds=bounds)
    iqr = F.col("q3") - F.col("q1")
    return materialize(join_null_safe(q, bounds, by).select(
        *by, F.col("_n").alias("n"), "q1", "median", "q3", iqr.alias("iqr"),
        (F.col("q1") - F.lit(whis) * iqr).alias("lo_fence"),
        (F.col("q3") + F.lit(whis) * iqr).alias("hi_fence")), "box-fences")


def box_stats(df: DataFrame, by=("event",), whis: float = WHIS) -> DataFrame:
    by = list(by)
    if not by:
        raise ValueError("give at least one grouping column (e.g. 'event')")
    data = missing_as_null(df).select(*by, "value").where(F.col("value").isNotNull())  # F15
    fences = _fences(data, by, whis)
    rows = join_small(data, fences, by, cols=[*by, "lo_fence", "hi_fence", "q1", "q3"])
    v = F.col("value")
    # a value lies beyond a whisker exactly when it lies beyond the fence (the whisker is the
    # most extreme value inside the fence, or the quartile when none is), so the outliers
    # are counted in the same pass as the whiskers
    agg = rows.groupBy(*by).agg(
        F.avg(v).alias("mean"),
        F.max(F.when(v <= F.col("hi_fence"), v)).alias("_hi_in"),
        F.min(F.when(v >= F.col("lo_fence"), v)).alias("_lo_in"),
        F.count_if((v < F.col("lo_fence")) | (v > F.col("hi_fence"))).alias("n_outliers"))
    out = join_null_safe(fences, agg, by)
    whishi = F.when(F.col("_hi_in").isNull() | (F.col("_hi_in") < F.col("q3")), F.col("q3")).otherwise(F.col("_hi_in"))
    whislo = F.when(F.col("_lo_in").isNull() | (F.col("_lo_in") > F.col("q1")), F.col("q1")).otherwise(F.col("_lo_in"))
    half = F.lit(1.57) * F.col("iqr") / F.sqrt(F.col("n").cast("double"))
    # one row per group, computed once: callers join it back to the samples
    return materialize(out.select(*by, "n", "mean", "q1", "median", "q3", "iqr", whislo.alias("whislo"), whishi.alias("whishi"),
                      (F.col("median") - half).alias("notch_lo"), (F.col("median") + half).alias("notch_hi"),
                      "n_outliers"), "box")


def box_outliers(df: DataFrame, by=("event",), whis: float = WHIS, box: DataFrame | None = None) -> DataFrame:
    """Rows beyond the whiskers of their group (all input columns + whislo/whishi)."""
    by = list(by)
    box = box if box is not None else box_stats(df, by, whis)
    data = missing_as_null(df).where(F.col("value").isNotNull())
    v = F.col("value")
    return join_small(data, box, by, cols=[*by, "whislo", "whishi"]) \
        .where((v < F.col("whislo")) | (v > F.col("whishi")))


def box_source(df: DataFrame, stats=("mean", "median", "std"), interval=None, source: str = "raw",
               by=("event",), tie: str | None = None, **rolling_kw) -> DataFrame:
    """The series each box summarises, as (by..., statistic, value).

    ``source='rolling'``: the rolling outputs, one box per statistic (computed
    once into the checkpoint folder, since the box reads them several times).
    ``source='raw'``: the raw values once (the original repeated them per
    statistic; the repeats carry no information, Q13).
    """
    by = list(by)
    if source == "raw":
        return df.select(*by, F.lit("raw").alias("statistic"), "value")
    if source != "rolling":
        raise ValueError("source must be 'raw' or 'rolling'")
    if not isinstance(interval, (Rows, Span)):
        raise ValueError("rolling boxes need an interval")
    # the box makes several passes: the windows are computed once, as one wide columnar table
    r = stored_columns(rolling(df, stats, interval, by=by, tie=tie, **rolling_kw).select(*by, *stats), "box-source")
    return r.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in stats])))
