"""Histogram ("PDF"), cumulative histogram ("CDF") and Gaussian density.

Bins follow numpy's ``auto`` rule, which is what the histogram chart uses:
``width = min(max(fd, sqrt/2), sturges)`` with ``fd = 2*IQR*n^(-1/3)``,
``sqrt = range/sqrt(n)``, ``sturges = range/(log2(n)+1)``; ``ceil(range/width)``
equal bins from min to max, the last bin closed; a single distinct value gives
one bin ``[v-0.5, v+0.5]``.  Counting uses the same index rule as numpy
(``floor`` then one-ulp corrections against the edges), so the counts are the
ones numpy gives.

Plan: one aggregate per metric for n/min/max, the exact quartiles, then one
pass that computes the bin of every row (the per-metric table is broadcast
after a row-count check) and a partial+final ``count`` per (metric, bin).  The
bin grid is generated from the per-metric table with ``sequence``, so empty
bins appear with count 0.  The number of bins is at most ``2*sqrt(n)``.

The density is the Gaussian kernel sum on a 200-point grid from min to max
with Scott's bandwidth ``h = sd * n^(-1/5)``, as a binned fast Gauss transform:
values fall into boxes of a tenth of a bandwidth, and a box is kept as 20 numbers,
the sums of ``exp(-s^2 / 2) * s^j`` with ``s = (value - centre) / h``, |s| <= 1/20.
At ``t`` bandwidths from the centre its values' kernels sum up to
``exp(-t^2 / 2) * sum(m_j * t^j / j!)``.  As a kernel is zero in doubles beyond
38.6 bandwidths, |t s| <= 1.95, and what the series leaves out is below
``1.95^20 / 20! * e^1.95 < 2e-12`` of the sum, in the far tails as well, so no box
needs the plain sum.  A value is one record (a partial sum per task and box),
never one per grid point; only boxes meet the grid points that they can reach,
about ``160,000 + boxes`` times per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.operators.quantiles import exact_quantiles, group_bounds
from hpcstats.plans import joins
from hpcstats.plans.joins import join_null_safe, join_small, materialize, observed
from hpcstats.sources.readers import missing_as_null

KDE_POINTS = 200
KERNEL_REACH = 40.0   # bandwidths; beyond 38.6 the Gaussian term underflows to 0.0
BOX = 0.1             # width of a box in bandwidths
TERMS = 20            # moments kept of a box


def _values(df: DataFrame, by: list[str], drop_any_null: bool) -> DataFrame:
    # the charts drop rows with any NULL before counting
    data = missing_as_null(df)
    data = data.na.drop("any") if drop_any_null else data
    return data.select(*by, "value").where(F.col("value").isNotNull())


def bin_layout(df: DataFrame, by=("event",), bins: int | None = None, drop_any_null: bool = True,
               bounds: DataFrame | None = None) -> DataFrame:
    """Per group: n, first/last edge, number of bins (materialised, small).

    ``bounds`` may pass a materialised table with ``_n, _lo, _hi`` per group.
    """
    by = list(by)
    if not by:
        raise ValueError("give at least one grouping column (e.g. 'event')")
    data = _values(df, by, drop_any_null)
    if bounds is None:
        bounds = materialize(group_bounds(data, "value", by), "hist-bounds", {"max_n": F.max("_n")})
    n, lo, hi = F.col("_n"), F.col("_lo"), F.col("_hi")
    ptp = hi - lo
    if bins is None:
        q = exact_quantiles(data, "value", [0.25, 0.75], by=by, names=["_q1", "_q3"], bounds=bounds)
        stats = join_null_safe(bounds, q, by)
        fd = F.lit(2.0) * (F.col("_q3") - F.col("_q1")) * F.pow(n.cast("double"), F.lit(-1.0 / 3.0))
        sqrt_bw = ptp / F.sqrt(n.cast("double"))
        sturges = ptp / (F.log2(n.cast("double")) + F.lit(1.0))
        width = F.least(F.greatest(fd, sqrt_bw / 2), sturges)
        nbins = F.when(width > 0, F.ceil(ptp / width)).otherwise(F.lit(1)).cast("long")
    else:
        stats = bounds
        nbins = F.lit(int(bins)).cast("long")
    same = lo == hi
    layout = stats.select(*by, n.alias("n"),
                          F.when(same, lo - 0.5).otherwise(lo).alias("first_edge"),
                          F.when(same, hi + 0.5).otherwise(hi).alias("last_edge"),
                          nbins.alias("nbins"))
    return materialize(layout, "hist-layout", {"bins": F.sum("nbins")})


def _edge(i: Column) -> Column:
    step = (F.col("last_edge") - F.col("first_edge")) / F.col("nbins")
    return F.when(i >= F.col("nbins"), F.col("last_edge")).otherwise(i * step + F.col("first_edge"))


def bin_index(value: Column) -> Column:
    """numpy's bin index for equal bins, including its edge corrections."""
    v = value
    raw = F.floor((v - F.col("first_edge")) / (F.col("last_edge") - F.col("first_edge")) * F.col("nbins"))
    idx = F.when(raw >= F.col("nbins"), F.col("nbins") - 1).otherwise(raw)
    idx = F.when(v < _edge(idx), idx - 1).otherwise(idx)
    return F.when((v >= _edge(idx + 1)) & (idx != F.col("nbins") - 1), idx + 1).otherwise(idx)


def histogram(df: DataFrame, by=("event",), bins: int | None = None, drop_any_null: bool = True) -> DataFrame:
    """A10: one row per (group, bin): bin, bin_lo, bin_hi, count (empty bins included)."""
    by = list(by)
    layout = bin_layout(df, by, bins, drop_any_null)
    data = _values(df, by, drop_any_null)
    rows = join_small(data, layout, by, cols=[*by, "first_edge", "last_edge", "nbins"])
    counts = rows.groupBy(*by, bin_index(F.col("value")).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = layout.select(*by, "first_edge", "last_edge", "nbins",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("nbins") - 1)).alias("bin"))
    # the counts have at most one row per bin of the grid: a bound known from the layout
    if (observed(layout).get("bins") or 0) <= joins.BROADCAST_MAX_ROWS:
        counts = F.broadcast(counts)
    out = join_null_safe(grid, counts, [*by, "bin"], "left").select(
        *by, "bin",
        _edge(F.col("bin")).alias("bin_lo"), _edge(F.col("bin") + 1).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))
    return out


def cdf(df: DataFrame, by=("event",), bins: int | None = None, drop_any_null: bool = True) -> DataFrame:
    """Running count over the bins of each group (+ fraction of n)."""
    by = list(by)
    h = histogram(df, by, bins, drop_any_null)
    w = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(*by)
    return h.withColumn("cum_count", F.sum("count").over(w)) \
        .withColumn("cum_fraction", F.col("cum_count") / F.sum("count").over(total))


def _box_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, value, lo, hi, h) to boxes: by, lo, hi, h, centre and m, the sums of exp(-s^2/2) * s^j for j < TERMS."""
    width = F.col("h") * BOX
    box = F.floor((F.col("value") - F.col("lo")) / width)
    placed = rows.withColumn("_box", box).withColumn("_s", (F.col("value") - (F.col("lo") + (F.col("_box") + 0.5) * width)) / F.col("h"))
    powers = [F.exp(F.lit(-0.5) * F.col("_s") * F.col("_s"))]
    for _ in range(1, TERMS):
        powers.append(powers[-1] * F.col("_s"))
    sums = placed.groupBy(*by, "lo", "hi", "h", "_box").agg(*[F.sum(p).alias(f"_m{k}") for k, p in enumerate(powers)])
    return sums.select(*by, "lo", "hi", "h", (F.col("lo") + (F.col("_box") + 0.5) * width).alias("centre"), *[f"_m{k}" for k in range(TERMS)])


def _kernel_sum() -> Column:
    """Sum of the kernels of a box's values at distance ``t`` (bandwidths) from its centre, from its moments."""
    total = F.col(f"_m{TERMS - 1}")
    for k in range(TERMS - 1, 0, -1):
        total = F.col(f"_m{k - 1}") + F.col("t") / k * total
    return F.exp(F.lit(-0.5) * F.col("t") * F.col("t")) * total


def kde(df: DataFrame, by=("event",), points: int = KDE_POINTS, drop_any_null: bool = True) -> DataFrame:
    """Gaussian kernel density on ``points`` grid values from min to max.

    Gives ``density`` and ``count_density`` (density * n * bin width, the curve
    drawn over a count histogram).  Groups with sd NULL or 0 give no rows.
    """
    by = list(by)
    if not by:
        raise ValueError("give at least one grouping column (e.g. 'event')")
    data = _values(df, by, drop_any_null)
    v = F.col("value")
    allst = data.groupBy(*by).agg(F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"),
                                  F.stddev_samp(v).alias("sd"))
    allst = materialize(allst, "kde-stats", {"max_n": F.max("_n")})
    layout = bin_layout(df, by, None, drop_any_null, bounds=allst)
    st = allst.where(F.col("sd") > 0).select(
        *by, F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"),
        (F.col("sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("h"))
    # a filter of the checkpointed table: its row count is bounded by the table's
    st._hpcstats_observed = {"rows": observed(allst)["rows"]}
    rows = join_small(data, st, by, cols=[*by, "lo", "hi", "h"])
    step = (F.col("hi") - F.col("lo")) / F.lit(points - 1)
    j = F.col("point")
    x = F.when(j == points - 1, F.col("hi")).otherwise(F.col("lo") + j.cast("double") * step)
    sums = _box_moments(rows, by)
    reach, centre = F.lit(KERNEL_REACH) * F.col("h"), F.col("centre")
    first = F.greatest(F.lit(0), F.floor((centre - reach - F.col("lo")) / step).cast("int") - 1)
    last = F.least(F.lit(points - 1), F.ceil((centre + reach - F.col("lo")) / step).cast("int") + 1)
    spread = sums.select(*by, "centre", "lo", "hi", "h", *[f"_m{k}" for k in range(TERMS)], F.explode(F.sequence(first, F.greatest(first, last))).alias("point"))
    sums = spread.withColumn("t", (x - centre) / F.col("h")).groupBy(*by, "point").agg(F.sum(_kernel_sum()).alias("_s"))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    # every grid point appears, also those no row reaches (density 0)
    grid = st.select(*by, "n", "lo", "hi", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    if observed(allst)["rows"] * points <= joins.BROADCAST_MAX_ROWS:   # at most one sum per grid point
        sums = F.broadcast(sums)
    stacked = join_null_safe(grid, sums, [*by, "point"], "left") \
        .withColumn("_s", F.coalesce(F.col("_s"), F.lit(0.0))).withColumn("x", x)
    binw = (F.col("last_edge") - F.col("first_edge")) / F.col("nbins")
    out = join_small(stacked, layout, by, cols=[*by, binw.alias("bin_width")])
    return out.select(*by, "point", "x", (F.col("_s") / norm).alias("density"),
                      (F.col("_s") / norm * F.col("n") * F.col("bin_width")).alias("count_density"),
                      F.col("h").alias("bandwidth"))
