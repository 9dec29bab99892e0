"""Pearson correlation of two metrics matched on time.

``paired_points`` keeps the first sample (smallest tie key) per (metric,
time) and pairs the two metrics on equal time: one ``groupBy(time)`` with
``min_by`` per metric -- one shuffle, no join, no sort.  Partial aggregation
runs map-side, so a hot timestamp is combined before the shuffle.

``pearson`` reduces the pairs to one row: ``n``, ``r`` and its p-value with
the original guards: fewer than 2 samples in either metric or fewer than 2
common times -> no number (status says why); a constant series -> NULL r
(``covar_pop / (sd_x * sd_y)`` with a safe divide instead of ``corr``).

``pearson_pairs`` does all pairs of a metric list in one plan: the per-time
first values of *all* metrics are built once (one shuffle), then every time
row is spread over the pairs and aggregated per pair in the same pass.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.functions.pvalue import p_value
from hpcstats.sources.readers import missing_as_null


SPREAD_PAIRS = 64


def _first_per_time(df: DataFrame, metrics: list[str], tie: str | None, time_col: str) -> DataFrame:
    """One row per time: for each metric, present flag + value of its first sample."""
    # a sample without a time cannot be matched on time
    data = missing_as_null(df).where(F.col("event").isin(metrics) & F.col(time_col).isNotNull())
    # "first" sample of a time: smallest tie key; without one, a total order over the other
    # columns, so that a recomputed stage picks the same row
    order = F.col(tie) if tie else F.struct(*[F.col(c) for c in sorted(df.columns) if c not in (time_col, "event")])
    aggs = []
    for i, m in enumerate(metrics):
        is_m = F.col("event") == F.lit(m)
        aggs.append(F.max(is_m.cast("int")).alias(f"_has{i}"))
        aggs.append(F.min_by(F.col("value"), F.when(is_m, order)).alias(f"_v{i}"))
    return data.groupBy(F.col(time_col).alias("time")).agg(*aggs)


def paired_points(df: DataFrame, metric_x: str, metric_y: str, tie: str | None = None,
                  time_col: str = "time") -> DataFrame:
    """(time, x, y) for every time both metrics share."""
    if metric_x == metric_y:
        raise ValueError("two different metrics are needed")
    wide = _first_per_time(df, [metric_x, metric_y], tie, time_col)
    return wide.where((F.col("_has0") == 1) & (F.col("_has1") == 1)) \
        .select("time", F.col("_v0").alias("x"), F.col("_v1").alias("y"))


def common_times(df: DataFrame, metric_x: str, metric_y: str, time_col: str = "time") -> DataFrame:
    """The set of times both metrics have."""
    a = df.where((F.col("event") == metric_x) & F.col(time_col).isNotNull()).select(F.col(time_col).alias("time"))
    b = df.where((F.col("event") == metric_y) & F.col(time_col).isNotNull()).select(F.col(time_col).alias("time"))
    return a.intersect(b)


def _pair_stats(wide: DataFrame, pairs: list[tuple[int, int, str, str]]) -> DataFrame:
    """Sums of every pair in one pass: each time row is spread over the pairs by a
    generator and aggregated per pair (map-side partial aggregation; a small plan
    whatever the number of pairs)."""
    rows = F.array(*[F.struct(F.lit(mx).alias("metric_x"), F.lit(my).alias("metric_y"),
                              (F.col(f"_has{i}") == 1).alias("hx"), (F.col(f"_has{j}") == 1).alias("hy"),
                              F.col(f"_v{i}").alias("x"), F.col(f"_v{j}").alias("y"))
                     for i, j, mx, my in pairs])
    spread = wide.select(F.inline(rows))
    both = F.col("hx") & F.col("hy")
    x, y = F.col("x"), F.col("y")
    stats = spread.groupBy("metric_x", "metric_y").agg(
        F.count_if(F.col("hx")).alias("n_x"),
        F.count_if(F.col("hy")).alias("n_y"),
        F.count_if(both).alias("n"),
        F.count_if(both & (x.isNull() | y.isNull())).alias("_n_missing"),
        F.covar_pop(F.when(both, x), F.when(both, y)).alias("_cov"),
        F.stddev_pop(F.when(both & y.isNotNull(), x)).alias("_sx"),
        F.stddev_pop(F.when(both & x.isNotNull(), y)).alias("_sy"))
    # every asked pair has its row, also when no time carries either metric
    asked = wide.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(mx).alias("metric_x"), F.lit(my).alias("metric_y")) for _, _, mx, my in pairs])))
    counts = ["n_x", "n_y", "n", "_n_missing"]
    out = asked.join(F.broadcast(stats), ["metric_x", "metric_y"], "left")   # at most one row per asked pair
    return out.select("metric_x", "metric_y", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
                      "_cov", "_sx", "_sy")


def _block_stats(df: DataFrame, metrics: list[str], pairs: list[tuple[int, int, str, str]], tie: str | None, time_col: str) -> DataFrame:
    """As ``_pair_stats`` for many pairs: co-moments of all pairs from products of matrices per block of time rows."""
    import numpy as np
    import pandas as pd

    data = missing_as_null(df).where(F.col("event").isin(metrics) & F.col(time_col).isNotNull())
    order = F.col(tie) if tie else F.struct(*[F.col(c) for c in sorted(df.columns) if c not in (time_col, "event")])
    place = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(metrics) for x in (m, i)]), F.col("event"))
    firsts = data.groupBy(F.col(time_col).alias("time"), place.alias("i")).agg(F.min_by(F.col("value"), order).cast("double").alias("v"))
    rows = firsts.groupBy("time").agg(F.collect_list("i").alias("at"), F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("vals"))
    m, left, right = len(metrics), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def moments(here, x):
        """Of one block: joint counts, and per (i, j) the mean and square sum of i where both have a value, and the products."""
        has = (~np.isnan(x)).astype(np.float64)
        centre = np.where(has.any(axis=0), x[has.argmax(axis=0), np.arange(m)], 0.0)
        d = np.where(has > 0, x - centre, 0.0)
        n, s = has.T @ has, d.T @ has
        some = np.maximum(n, 1.0)
        return {"both": here.T @ here, "n": n, "mean": centre[:, None] + s / some, "sq": (d * d).T @ has - s * s / some, "co": d.T @ d - s * s.T / some}

    def merged(a, b):
        n = a["n"] + b["n"]
        shift = np.where((a["n"] > 0) & (b["n"] > 0), b["mean"] - a["mean"], 0.0)
        weight = a["n"] * b["n"] / np.maximum(n, 1.0)
        mean = np.where(a["n"] > 0, a["mean"] + shift * b["n"] / np.maximum(n, 1.0), b["mean"])
        return {"both": a["both"] + b["both"], "n": n, "mean": mean, "sq": a["sq"] + b["sq"] + shift * shift * weight,
                "co": a["co"] + b["co"] + shift * shift.T * weight}

    def run(frames):
        total = None
        with np.errstate(invalid="ignore", over="ignore"):
            for frame in frames:
                for start in range(0, len(frame), 2048):
                    at, vals = frame["at"].iloc[start:start + 2048].tolist(), frame["vals"].iloc[start:start + 2048].tolist()
                    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
                    col = np.concatenate(at).astype(np.int64)
                    here, x = np.zeros((len(at), m)), np.full((len(at), m), np.nan)
                    here[row, col], x[row, col] = 1.0, np.concatenate(vals)
                    block = moments(here, x)
                    total = block if total is None else merged(total, block)
        if total is not None:
            alone = np.diag(total["both"])
            yield pd.DataFrame({"k": np.arange(len(left)), "n_x": alone[left].astype(np.int64), "n_y": alone[right].astype(np.int64),
                                "n": total["both"][left, right].astype(np.int64), "ok": total["n"][left, right], "mx": total["mean"][left, right],
                                "my": total["mean"][right, left], "qx": np.maximum(total["sq"][left, right], 0.0),
                                "qy": np.maximum(total["sq"][right, left], 0.0), "co": total["co"][left, right]})

    parts = rows.select("at", "vals").mapInPandas(
        run, "k int, n_x long, n_y long, n long, ok double, mx double, my double, qx double, qy double, co double")
    part = F.struct("ok", "mx", "my", "qx", "qy", "co")
    grouped = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n_x", "n_y", "n")], F.sort_array(F.collect_list(part)).alias("parts"))
    total = F.expr("""
      aggregate(filter(parts, p -> p.ok > 0), named_struct('ok', 0D, 'mx', 0D, 'my', 0D, 'qx', 0D, 'qy', 0D, 'co', 0D), (a, b) -> named_struct(
        'ok', a.ok + b.ok, 'mx', if(a.ok = 0, b.mx, a.mx + (b.mx - a.mx) * b.ok / (a.ok + b.ok)),
        'my', if(a.ok = 0, b.my, a.my + (b.my - a.my) * b.ok / (a.ok + b.ok)),
        'qx', a.qx + b.qx + if(a.ok = 0, 0D, (b.mx - a.mx) * (b.mx - a.mx) * a.ok * b.ok / (a.ok + b.ok)),
        'qy', a.qy + b.qy + if(a.ok = 0, 0D, (b.my - a.my) * (b.my - a.my) * a.ok * b.ok / (a.ok + b.ok)),
        'co', a.co + b.co + if(a.ok = 0, 0D, (b.mx - a.mx) * (b.my - a.my) * a.ok * b.ok / (a.ok + b.ok))))""")
    stats = grouped.select("k", "n_x", "n_y", "n", total.alias("t"))
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(mx).alias("metric_x"), F.lit(my).alias("metric_y")) for k, (_, _, mx, my) in enumerate(pairs)])
    asked = df.sparkSession.range(1).select(F.inline(names))
    out = asked.join(F.broadcast(stats), "k", "left")   # one row per asked pair
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ok = F.col("t.ok")
    return out.select("metric_x", "metric_y", *[count(c).alias(c) for c in ("n_x", "n_y", "n")],
                      (count("n") - F.coalesce(ok, F.lit(0.0)).cast("long")).alias("_n_missing"), F.try_divide(F.col("t.co"), ok).alias("_cov"),
                      F.sqrt(F.try_divide(F.col("t.qx"), ok)).alias("_sx"), F.sqrt(F.try_divide(F.col("t.qy"), ok)).alias("_sy"))


def _finish(stats: DataFrame) -> DataFrame:
    status = (F.when((F.col("n_x") < 2) | (F.col("n_y") < 2), F.lit("insufficient_samples"))
              .when(F.col("n") < 2, F.lit("too_few_common_times"))
              .when(F.col("_n_missing") > 0, F.lit("missing_values"))
              .when((F.col("_sx") == 0) | (F.col("_sy") == 0), F.lit("constant"))
              .otherwise(F.lit("ok")))
    raw = F.try_divide(F.col("_cov"), F.col("_sx") * F.col("_sy"))
    r = F.when(status == "ok", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    out = stats.select("metric_x", "metric_y", "n_x", "n_y", "n", r.alias("correlation"), status.alias("status"))
    return out.withColumn("p_value", F.when(F.col("status") == "ok", p_value(F.col("correlation"), F.col("n"))))


def pearson(df: DataFrame, metric_x: str, metric_y: str, tie: str | None = None,
            time_col: str = "time") -> DataFrame:
    """One row: metric_x, metric_y, n_x, n_y, n, correlation, status, p_value."""
    if metric_x == metric_y:
        raise ValueError("two different metrics are needed")
    wide = _first_per_time(df, [metric_x, metric_y], tie, time_col)
    return _finish(_pair_stats(wide, [(0, 1, metric_x, metric_y)]))


def pearson_pairs(df: DataFrame, metrics: list[str], tie: str | None = None, time_col: str = "time",
                  pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Q18: every pair of ``metrics`` (or the given pairs), one row each."""
    metrics = list(dict.fromkeys(metrics))
    pairs = pairs or list(combinations(metrics, 2))
    pos = {m: i for i, m in enumerate(metrics)}
    placed = [(pos[a], pos[b], a, b) for a, b in pairs]
    if len(placed) > SPREAD_PAIRS:
        return _finish(_block_stats(df, metrics, placed, tie, time_col))
    return _finish(_pair_stats(_first_per_time(df, metrics, tie, time_col), placed))
