"""Registered queries: one Spark plan per operator and the same question in SQL.

Every query reads the shared tables through ``host_view``/``job_view`` (the
whole tables; windows and conditions are the operator under test, not a way
to make the check cheaper).  The SQL texts run on DuckDB with the shared
tables registered as views and compute the answer independently (window
functions, self-joins, series), never by calling this library.

Doubles are rounded on both sides (6 places; densities 9) so that summation
order does not matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.predicates import FilterSpec, Predicate, select_metrics
from hpcstats.functions.rules import MESSAGES, host_rules, job_rules, numeric_message
from hpcstats.functions.text import clean_text, fixed, split_trim, stamp, whole_days
from hpcstats.operators.box import box_outliers, box_source, box_stats
from hpcstats.operators.correlation import common_times, paired_points, pearson, pearson_pairs
from hpcstats.operators.distribution import cdf, histogram, kde
from hpcstats.operators.extract import drop_aux, extract, row_count, series_columns, with_unit
from hpcstats.operators.quality import audit, quarantine
from hpcstats.operators.rolling import rolling
from hpcstats.operators.summary import metric_summary, outside_ratio
from hpcstats.schema import EVENTS, EXITCODES, QUEUES, UNIT_TO_EVENT
from hpcstats.plans.analysis import analyse
from hpcstats.session import ensure_checkpoint_dir
from hpcstats.sources.dirty import host_dirty, job_dirty, samples_dirty, with_dirty_views
from hpcstats.sources.layout import read_host_layout, write_host_layout
from hpcstats.sources.readers import run_sql, union_sources
from hpcstats.sources.splits import split_points, split_read
from hpcstats.sources.sinks import utc_naive
from hpcstats.sources.shared_tables import host_view, job_view, with_views

HOST_WINDOW = ("2024-01-05 00:00:00", "2024-01-10 00:00:00")
JOB_WINDOW = ("1996-01-01 00:00:00", "1996-06-29 00:00:00")
TS = "timestamp '{}'"


def rnd(df: DataFrame, cols, places: int = 6) -> DataFrame:
    """Round the named double columns in place (column order kept)."""
    cols = set(cols)
    return df.select(*[F.round(F.col(c), places).alias(c) if c in cols else F.col(c) for c in df.columns])


def hourly(spark, sf) -> DataFrame:
    """Host samples with time truncated to the hour (ties and shared times)."""
    h = host_view(spark, sf)
    return h.withColumn("time", F.date_trunc("hour", F.col("time")).cast("timestamp_ntz"))


# ---------------------------------------------------------------------------- host extract

def q_host_filter_compare(spark, sf):
    spec = FilterSpec("host", window=HOST_WINDOW, predicates=(
        Predicate("event", "=", "cpuuser"), Predicate("value", ">=", "20.5"), Predicate("host", "!=", "NODE3")))
    return extract(host_view(spark, sf), spec)


def q_host_like(spark, sf):
    spec = FilterSpec("host", columns=("host", "jid", "event", "value"),
                      predicates=(Predicate("host", "LIKE", "NODE1_"), Predicate("jid", "LIKE", "JOB1%")))
    return extract(host_view(spark, sf), spec)


def q_host_in_list(spark, sf):
    spec = FilterSpec("host", columns=("event_id", "time", "host", "value"),
                      predicates=(Predicate("event", "=", "memused"),),
                      in_column="host", in_values="NODE1, NODE2 ,NODE3")
    return extract(host_view(spark, sf), spec)


def q_host_distinct(spark, sf):
    spec = FilterSpec("host", columns=("host", "jid"), window=HOST_WINDOW, distinct=True)
    return extract(host_view(spark, sf), spec)


def q_host_topk(spark, sf):
    spec = FilterSpec("host", order_by=("value", "event_id"), descending=True, limit=25)
    return extract(host_view(spark, sf), spec)


def q_row_count(spark, sf):
    spec = FilterSpec("host", predicates=(Predicate("event", "=", "gpu_usage"), Predicate("value", ">", 50)))
    return row_count(extract(host_view(spark, sf), spec))


def q_raw_series(spark, sf):
    spec = FilterSpec("host", columns=("event_id", "time", "value"), predicates=(Predicate("event", "=", "cpuuser"),),
                      order_by=("time", "event_id"))
    return extract(host_view(spark, sf), spec)


def q_union_sources(spark, sf):
    h = host_view(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    parts = [h.where(F.col("time") < cut), h.where(F.col("time") >= cut)]
    return union_sources(parts).groupBy("event").agg(F.count(F.lit(1)).alias("n_rows"))


def q_unit_lookup(spark, sf):
    return with_unit(host_view(spark, sf).select("event", "unit").distinct(), "dim_unit")


# ---------------------------------------------------------------------------- job extract

def q_job_window(spark, sf):
    spec = FilterSpec.with_default_cap("job", window=JOB_WINDOW,
                                       columns=("jid", "submit_time", "start_time", "end_time", "queue", "nhosts"))
    return extract(job_view(spark, sf), spec)


def q_job_filter_typed(spark, sf):
    spec = FilterSpec("job").add("ncores", "<", "700.5").add("timelimit", ">=", "345600").add("queue", "=", "debug",
                                                                                               normalise=False)
    return extract(job_view(spark, sf), spec)


def q_job_filter_like_in(spark, sf):
    spec = FilterSpec("job", columns=("jid", "username", "account", "runtime"), in_column="account",
                      in_values="GROUP1, GROUP2").add("username", "LIKE", "user1%")
    return extract(job_view(spark, sf), spec)


def q_job_window_in_list(spark, sf):
    spec = FilterSpec.with_default_cap("job", window=JOB_WINDOW, columns=("jid", "start_time", "queue", "ngpus"),
                                       in_column="queue", in_values="debug, highmem",
                                       order_by=("start_time", "jid"), limit=50).add("ngpus", ">=", "4")
    return extract(job_view(spark, sf), spec)


def q_job_distinct_queue(spark, sf):
    return extract(job_view(spark, sf), FilterSpec("job", columns=("queue", "exitcode"), distinct=True))


def q_job_topk(spark, sf):
    spec = FilterSpec("job", columns=("jid", "node_hrs", "nhosts"), order_by=("node_hrs", "jid"),
                      descending=True, limit=20)
    return extract(job_view(spark, sf), spec)


# ---------------------------------------------------------------------------- statistics

def q_metric_summary(spark, sf):
    return rnd(metric_summary(host_view(spark, sf)), ["mean", "median", "std"])


def q_metric_summary_window(spark, sf):
    x = extract(host_view(spark, sf), FilterSpec.with_default_cap("host", window=HOST_WINDOW))
    return rnd(metric_summary(x), ["mean", "median", "std"])


def q_metric_select(spark, sf):
    spec = FilterSpec("host", predicates=(Predicate("unit", "=", "GB/s"),))
    x = extract(host_view(spark, sf), spec)
    return rnd(metric_summary(x, metrics=select_metrics(spec)), ["mean", "median", "std"])


def q_outside_ratio(spark, sf):
    return rnd(outside_ratio(host_view(spark, sf), 50.0), ["ratio_outside", "ratio_inside"])


def _series(spark, sf):
    return host_view(spark, sf).select("event_id", "time", "event", "value")


def _roll(stats, interval, split=True, **kw):
    def q(spark, sf):
        return rnd(rolling(_series(spark, sf), stats, interval, tie="event_id", split=split, **kw), stats)
    return q


def q_rolling_ties(spark, sf):
    h = hourly(spark, sf).select("event_id", "time", "event", "value")
    stats = ["mean", "median", "std"]
    return rnd(rolling(h, stats, Span(2, "Hours"), tie="event_id", ties="row"), stats)


def q_rolling_by_host(spark, sf):
    h = host_view(spark, sf).select("event_id", "time", "event", "host", "value")
    return rnd(rolling(h, ["mean"], Span(6, "Hours"), by=("event", "host"), tie="event_id"), ["mean"])


def q_rolling_count_by_host(spark, sf):
    h = host_view(spark, sf).select("event_id", "time", "event", "host", "value")
    stats = ["mean", "std"]
    return rnd(rolling(h, stats, Rows(3), by=("event", "host"), tie="event_id"), stats)


def q_histogram_fixed_bins(spark, sf):
    return rnd(histogram(host_view(spark, sf), bins=20), ["bin_lo", "bin_hi"])


def q_histogram(spark, sf):
    return rnd(histogram(host_view(spark, sf)), ["bin_lo", "bin_hi"])


def q_cdf(spark, sf):
    return rnd(cdf(host_view(spark, sf)), ["bin_lo", "bin_hi", "cum_fraction"])


def gaps(spark, sf):
    """Samples with missing values (NULL and NaN) and hosts."""
    h, k = host_view(spark, sf), F.col("event_id")
    value = F.when(k % 7 == 0, None).when(k % 11 == 0, float("nan")).otherwise(F.col("value"))
    return h.withColumn("value", value).withColumn("host", F.when(k % 13 != 0, F.col("host")))


GAPS_SQL = """(select event_id, time, case when event_id % 13 <> 0 then host end as host, jid, event, unit,
  case when event_id % 7 = 0 or event_id % 11 = 0 then null else value end as value from host_data)"""


def _totals(df):
    return df.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"),
                                   F.round(F.sum(F.col("value").cast("decimal(18,6)")), 2).cast("double").alias("total"))


def q_split_pieces(spark, sf):
    """The table read in balanced pieces of its time, and put together again."""
    h = host_view(spark, sf)
    points = split_points(h, "time", rows_per_split=max(1, h.count() // 8))
    return _totals(union_sources(split_read(h, "time", points)))


def q_host_layout_window(spark, sf):
    """The table written as partitions of metric and date, hot ones cut by time, and a window of two metrics read back."""
    path = f"{ensure_checkpoint_dir(spark)}/host-layout-{uuid.uuid4().hex}"
    write_host_layout(host_view(spark, sf), path, rows_per_file=200)
    return _totals(read_host_layout(spark, path, HOST_WINDOW, ["cpuuser", "nfs"]))


def q_kde(spark, sf):
    out = kde(host_view(spark, sf))
    return rnd(rnd(out, ["x", "count_density"], 6), ["density", "bandwidth"], 9)


BOX_DOUBLES = ["mean", "q1", "median", "q3", "iqr", "whislo", "whishi", "notch_lo", "notch_hi"]


def q_box_raw(spark, sf):
    return rnd(box_stats(host_view(spark, sf)), BOX_DOUBLES)


def q_box_rolling(spark, sf):
    src = box_source(_series(spark, sf), ["mean", "median", "std"], Span(3, "Hours"), source="rolling",
                     tie="event_id")
    return rnd(box_stats(src, by=["event", "statistic"]), BOX_DOUBLES)


def q_box_outliers(spark, sf):
    out = box_outliers(host_view(spark, sf))
    return rnd(out.select("event_id", "event", "time", "value", "whislo", "whishi"), ["whislo", "whishi"])


def q_paired_points(spark, sf):
    return paired_points(hourly(spark, sf), "cpuuser", "memused", tie="event_id")


def q_common_times(spark, sf):
    return common_times(hourly(spark, sf), "cpuuser", "memused")


def q_pearson(spark, sf):
    return rnd(pearson(hourly(spark, sf), "cpuuser", "memused", tie="event_id"), ["correlation", "p_value"])


def q_pearson_pairs(spark, sf):
    return rnd(pearson_pairs(hourly(spark, sf), EVENTS, tie="event_id"), ["correlation", "p_value"])


# ---------------------------------------------------------------------------- quality and text

def q_quality_audit_host(spark, sf):
    return audit(host_view(spark, sf), host_rules())


def q_quality_audit_job(spark, sf):
    return audit(job_view(spark, sf), job_rules(with_choices=True))


def q_quarantine_job(spark, sf):
    return quarantine(job_view(spark, sf), job_rules(with_choices=True)).select("jid", "failed_rules")


def q_quality_audit_host_dirty(spark, sf):
    return audit(host_dirty(spark, sf), host_rules())


def q_quality_audit_job_dirty(spark, sf):
    return audit(job_dirty(spark, sf), job_rules(with_choices=True))


def q_quarantine_job_dirty(spark, sf):
    return quarantine(job_dirty(spark, sf), job_rules(with_choices=True)).select("jid", "jobname", "failed_rules")


def q_split_trim_dirty(spark, sf):
    return job_dirty(spark, sf).select(F.explode(split_trim("host_list")).alias("node")).groupBy("node") \
        .agg(F.count(F.lit(1)).alias("n_jobs"))


def q_rolling_dirty(spark, sf):
    stats = ["mean", "median", "std"]
    out = rolling(samples_dirty(spark, sf), stats, Span(6, "Hours"), by=("event", "host"), tie="event_id")
    return rnd(out.select("event_id", "event", "host", F.col("big").cast("string").alias("big"), *stats), stats)


def q_rolling_time_days(spark, sf):
    """Spans of days.  Values in another unit: two-decimal ones would make means that are ties of the last place kept."""
    scaled = _series(spark, sf).withColumn("value", F.col("value") * F.lit(1.4142135623730951))
    return rnd(rolling(scaled, ["mean", "std"], Span(5, "Days"), tie="event_id").drop("value"), ["mean", "std"])


# ---------------------------------------------------------------------------- requests, projections, scalar functions

def q_analyse_series(spark, sf):
    return analyse(host_view(spark, sf), ["None"])["series"]


def q_job_filter_big_int(spark, sf):
    """Whole numbers beyond 53 bits, given as text, compare exactly."""
    jobs = job_view(spark, sf).withColumn("ncores", F.substring("jid", 4, 20).cast("long") + F.lit(2 ** 53))
    spec = FilterSpec("job", columns=("jid", "ncores"), predicates=(
        Predicate("ncores", ">=", "9007199254740993"), Predicate("ncores", "<", "9_007_199_254_741_093"), Predicate("ncores", "!=", "9007199254740994.5")))
    return extract(jobs, spec)


def q_job_in_long_list(spark, sf):
    """An IN list of thousands of values: a semi join, no literal per value."""
    spec = FilterSpec("job", columns=("jid", "queue"), in_column="jid", in_values=tuple(f"JOB{i}" for i in range(0, 60_000, 7)))
    return extract(job_view(spark, sf), spec)


def q_drop_aux(spark, sf):
    h = host_view(spark, sf)
    return drop_aux(h.select("*", F.lit("gauge").alias("type"), F.lit(0.5).alias("diff"), F.lit(1.0).alias("arc")))


def q_series_columns(spark, sf):
    return series_columns(host_view(spark, sf), ["event_id"])


def q_parameter_sql(spark, sf):
    return run_sql(spark, "select host, count(*) as n, max(value) as top from samples where event = :event and value > :least group by host",
                   {"event": "block", "least": 10.0}, {"samples": host_view(spark, sf)})


def q_utc_naive(spark, sf):
    """Zoned times (here: two hours east of UTC) become naive UTC in an export."""
    zoned = host_view(spark, sf).select("event_id", F.to_timestamp_ltz(F.concat(F.col("time").cast("string"), F.lit("+02:00"))).alias("seen"))
    return utc_naive(zoned)


def q_time_stamp(spark, sf):
    return host_view(spark, sf).select("event_id", stamp("time").alias("stamp"))


def q_fixed_decimals(spark, sf):
    return host_view(spark, sf).select("event_id", fixed(F.round("value", 1), 2).alias("label"))


def q_whole_days(spark, sf):
    return job_view(spark, sf).select("jid", whole_days("submit_time", "end_time").alias("days"))


def q_clean_text(spark, sf):
    return host_view(spark, sf).select("unit", clean_text("unit").alias("cleaned")).distinct()


def q_split_trim(spark, sf):
    j = job_view(spark, sf)
    return j.select(F.explode(split_trim("host_list")).alias("node")).groupBy("node") \
        .agg(F.count(F.lit(1)).alias("n_jobs"))


QUERIES = {
    "host_filter_compare": q_host_filter_compare,
    "host_like": q_host_like,
    "host_in_list": q_host_in_list,
    "host_distinct": q_host_distinct,
    "host_topk": q_host_topk,
    "row_count": q_row_count,
    "raw_series": q_raw_series,
    "union_sources": q_union_sources,
    "unit_lookup": q_unit_lookup,
    "job_window": q_job_window,
    "job_window_in_list": q_job_window_in_list,
    "job_filter_typed": q_job_filter_typed,
    "job_filter_like_in": q_job_filter_like_in,
    "job_distinct_queue": q_job_distinct_queue,
    "job_topk": q_job_topk,
    "metric_summary": q_metric_summary,
    "metric_summary_window": q_metric_summary_window,
    "metric_select": q_metric_select,
    "outside_ratio": q_outside_ratio,
    "rolling_count_mean": _roll(["mean"], Rows(5)),
    "rolling_count_median": _roll(["median"], Rows(5)),
    "rolling_count_std": _roll(["std"], Rows(5)),
    "rolling_count_plain": _roll(["mean", "median", "std"], Rows(5), split=False),
    "rolling_time_mean": _roll(["mean"], Span(3, "Hours")),
    "rolling_time_median": _roll(["median"], Span(3, "Hours")),
    "rolling_time_std": _roll(["std"], Span(3, "Hours")),
    "rolling_time_plain": _roll(["mean", "median", "std"], Span(3, "Hours"), split=False),
    "rolling_time_ties": q_rolling_ties,
    "rolling_by_host": q_rolling_by_host,
    "rolling_count_long": _roll(["mean", "median", "std"], Rows(700)),
    "rolling_median_days": _roll(["median"], Span(5, "Days")),
    "rolling_median_narrow_cells": _roll(["median", "std"], Span(5, "Days"), target_rows=100),
    "rolling_count_by_host": q_rolling_count_by_host,
    "histogram": q_histogram,
    "histogram_fixed_bins": q_histogram_fixed_bins,
    "cdf": q_cdf,
    "kde": q_kde,
    "box_raw": q_box_raw,
    "box_rolling": q_box_rolling,
    "box_outliers": q_box_outliers,
    "histogram_dirty": lambda spark, sf: rnd(histogram(gaps(spark, sf)), ["bin_lo", "bin_hi"]),
    "cdf_dirty": lambda spark, sf: rnd(cdf(gaps(spark, sf)), ["bin_lo", "bin_hi", "cum_fraction"]),
    "kde_dirty": lambda spark, sf: rnd(rnd(kde(gaps(spark, sf)), ["x", "count_density"], 6), ["density", "bandwidth"], 9),
    "box_raw_dirty": lambda spark, sf: rnd(box_stats(gaps(spark, sf)), BOX_DOUBLES),
    "split_pieces": q_split_pieces,
    "host_layout_window": q_host_layout_window,
    "paired_points": q_paired_points,
    "common_times": q_common_times,
    "pearson": q_pearson,
    "pearson_pairs": q_pearson_pairs,
    "quality_audit_host": q_quality_audit_host,
    "quality_audit_job": q_quality_audit_job,
    "quarantine_job": q_quarantine_job,
    "clean_text": q_clean_text,
    "split_trim": q_split_trim,
    "quality_audit_host_dirty": q_quality_audit_host_dirty,
    "quality_audit_job_dirty": q_quality_audit_job_dirty,
    "quarantine_job_dirty": q_quarantine_job_dirty,
    "split_trim_dirty": q_split_trim_dirty,
    "rolling_dirty": q_rolling_dirty,
    "rolling_time_days": q_rolling_time_days,
    "analyse_series": q_analyse_series,
    "job_filter_big_int": q_job_filter_big_int,
    "job_in_long_list": q_job_in_long_list,
    "drop_aux": q_drop_aux,
    "series_columns": q_series_columns,
    "parameter_sql": q_parameter_sql,
    "utc_naive": q_utc_naive,
    "time_stamp": q_time_stamp,
    "fixed_decimals": q_fixed_decimals,
    "whole_days": q_whole_days,
}


# ============================================================================ SQL side

def _ts(s: str) -> str:
    return TS.format(s)


METRICS_SQL = "(values " + ", ".join(f"('{e}', '{u}', {i})" for i, (u, e) in
                                      enumerate(UNIT_TO_EVENT.items())) + ") as m(event, unit, pos)"
# metric order of the validator list (used for pair order)
EVENT_POS_SQL = "(values " + ", ".join(f"('{e}', {i})" for i, e in enumerate(EVENTS)) + ") as ep(event, pos)"


def _summary_sql(where: str = "", metrics=None) -> str:
    m = METRICS_SQL if metrics is None else \
        "(values " + ", ".join(f"('{e}', '{u}', 0)" for u, e in UNIT_TO_EVENT.items() if e in metrics) + \
        ") as m(event, unit, pos)"
    return with_views(f"""
, s as (select event, count(value) as n, avg(value) as mean, quantile_cont(value, 0.5) as median,
               stddev_samp(value) as std from host_data {where} group by event)
select m.event, m.unit, coalesce(s.n, 0) as n, round(s.mean, 6) as mean, round(s.median, 6) as median,
       round(s.std, 6) as std
from {m} left join s on m.event = s.event""")


def _rolling_rows_sql(stats, n=5) -> str:
    frame = f"partition by event order by time, event_id rows between {n - 1} preceding and current row"
    fn = {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_samp(value)"}
    cols = ", ".join(f"round(case when count(value) over w >= {n} then {fn[s]} over w end, 6) as {s}" for s in stats)
    return with_views(f"select event_id, time, event, value, {cols} from host_data window w as ({frame})")


def _rolling_span_sql(stats, micros, by="event", extra="") -> str:
    frame = f"partition by {by} order by epoch_us(time) range between {micros - 1} preceding and current row"
    fn = {"mean": "avg(value)", "median": "quantile_cont(value, 0.5)", "std": "stddev_samp(value)"}
    cols = ", ".join(f"round({fn[s]} over w, 6) as {s}" for s in stats)
    return with_views(f"select event_id, time, event, {extra}value, {cols} from host_data window w as ({frame})")


def _bins_sql(source: str, bins: int | None = None) -> str:
    """CTEs v (values), lay (layout), hist (histogram) on top of `source` rows (event, value)."""
    nb = ("case when w > 0 then cast(ceil((hi - lo) / w) as bigint) else 1 end" if bins is None
          else f"cast({int(bins)} as bigint)")
    return f"""
, v as ({source})
, st as (select event, count(*) as n, min(value) as lo, max(value) as hi,
                quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from v group by event)
, wd as (select *, least(greatest(2.0 * (q3 - q1) * pow(cast(n as double), -1.0 / 3.0),
                                  (hi - lo) / sqrt(cast(n as double)) / 2),
                         (hi - lo) / (log2(cast(n as double)) + 1.0)) as w from st)
, lay as (select event, n,
                 case when lo = hi then lo - 0.5 else lo end as fe,
                 case when lo = hi then hi + 0.5 else hi end as le,
                 {nb} as nb from wd)
, b1 as (select v.event, v.value, l.fe, l.le, l.nb, (l.le - l.fe) / l.nb as step,
                least(cast(floor((v.value - l.fe) / (l.le - l.fe) * l.nb) as bigint), l.nb - 1) as i1
         from v join lay l on v.event = l.event)
, b2 as (select *, case when value < (case when i1 >= nb then le else i1 * step + fe end)
                        then i1 - 1 else i1 end as i2 from b1)
, b3 as (select event, case when value >= (case when i2 + 1 >= nb then le else (i2 + 1) * step + fe end)
                             and i2 != nb - 1 then i2 + 1 else i2 end as bin from b2)
, cnt as (select event, bin, count(*) as c from b3 group by event, bin)
, grid as (select event, fe, le, nb, unnest(range(0, nb)) as bin from lay)
, hist as (select g.event, g.bin,
                  case when g.bin >= g.nb then g.le else g.bin * ((g.le - g.fe) / g.nb) + g.fe end as bin_lo,
                  case when g.bin + 1 >= g.nb then g.le else (g.bin + 1) * ((g.le - g.fe) / g.nb) + g.fe end as bin_hi,
                  coalesce(c.c, 0) as count
           from grid g left join cnt c on g.event = c.event and g.bin = c.bin)"""


NOT_NULL_ROW = ("event_id is not null and time is not null and host is not null and jid is not null and "
                "event is not null and unit is not null and value is not null")


def _box_sql(source: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    on = " and ".join(f"x.{c} = y.{c}" for c in keys)
    on_f = on.replace("x.", "f.").replace("y.", "v.")
    return f"""
, v as ({source})
, q as (select {k}, count(*) as n, avg(value) as mean, quantile_cont(value, 0.25) as q1,
               quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from v group by {k})
, f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lo_f, q3 + 1.5 * (q3 - q1) as hi_f from q)
, wk as (select {", ".join("f." + c for c in keys)}, max(case when v.value <= f.hi_f then v.value end) as hi_in,
                min(case when v.value >= f.lo_f then v.value end) as lo_in
         from f join v on {on_f} group by {", ".join("f." + c for c in keys)})
, b as (select f.*, case when wk.hi_in is null or wk.hi_in < f.q3 then f.q3 else wk.hi_in end as whishi,
               case when wk.lo_in is null or wk.lo_in > f.q1 then f.q1 else wk.lo_in end as whislo
        from f join wk on {on.replace("x.", "f.").replace("y.", "wk.")})
, o as (select {", ".join("b." + c for c in keys)}, count(*) as n_out from b join v on {on.replace("x.", "b.").replace("y.", "v.")}
        where v.value < b.whislo or v.value > b.whishi group by {", ".join("b." + c for c in keys)})
select {", ".join("b." + c for c in keys)}, b.n, round(b.mean, 6) as mean, round(b.q1, 6) as q1,
       round(b.median, 6) as median, round(b.q3, 6) as q3, round(b.iqr, 6) as iqr,
       round(b.whislo, 6) as whislo, round(b.whishi, 6) as whishi,
       round(b.median - 1.57 * b.iqr / sqrt(cast(b.n as double)), 6) as notch_lo,
       round(b.median + 1.57 * b.iqr / sqrt(cast(b.n as double)), 6) as notch_hi,
       coalesce(o.n_out, 0) as n_outliers
from b left join o on {on.replace("x.", "b.").replace("y.", "o.")}"""


def _pvalue_sql(src: str, keys: list[str]) -> str:
    """CTE `pv` (keys..., p): two-sided Student-t tail by the finite series for whole
    degrees of freedom (Abramowitz & Stegun 26.7.3/26.7.4), from r and n of `src`."""
    k = ", ".join(keys)
    jk = " and ".join(f"s.{c} = t.{c}" for c in keys)
    return f"""
, pin as (select {k}, n - 2 as nu, abs(r) as s, 1 - r * r as c2 from {src} where r is not null and n > 2)
, terms as (select {k}, nu, s, c2, unnest(range(0, cast(greatest(nu, 2) / 2 as bigint))) as j from pin)
, tsum as (select {k}, nu, s, c2,
                  sum(case when nu % 2 = 0 and j <= (nu - 2) / 2
                           then exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(c2, j)
                           when nu % 2 = 1 and j <= (nu - 3) / 2
                           then exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow(c2, j)
                           else 0 end) as acc
           from terms group by {k}, nu, s, c2)
, pv as (select {k}, case when s >= 1 then 0.0
                          when nu % 2 = 0 then 1 - s * acc
                          when nu = 1 then 1 - 2 * asin(s) / pi()
                          else 1 - 2 / pi() * (asin(s) + s * sqrt(c2) * acc) end as p
         from tsum)
, pv2 as (select s.*, case when s.n = 2 then 1.0 else t.p end as p_value from {src} s left join pv t on {jk})"""


def _pearson_sql(pairs_sql: str) -> str:
    return with_views(f"""
, h as (select event_id, date_trunc('hour', time) as t, event, value from host_data)
, f as (select event, t, arg_min(value, event_id) as v from h group by event, t)
, cnt as (select event, count(*) as n from f group by event)
, pairs as ({pairs_sql})
, j as (select p.mx, p.my, count(*) as n, covar_pop(fa.v, fb.v) as cov, stddev_pop(fa.v) as sx,
               stddev_pop(fb.v) as sy,
               count(*) filter (where fa.v is null or fb.v is null) as miss
        from pairs p join f fa on fa.event = p.mx join f fb on fb.event = p.my and fb.t = fa.t group by p.mx, p.my)
, st as (select p.mx, p.my, coalesce(ca.n, 0) as n_x, coalesce(cb.n, 0) as n_y, coalesce(j.n, 0) as n,
                j.cov, j.sx, j.sy, coalesce(j.miss, 0) as miss
         from pairs p left join cnt ca on ca.event = p.mx left join cnt cb on cb.event = p.my
              left join j on j.mx = p.mx and j.my = p.my)
, st2 as (select *, case when n_x < 2 or n_y < 2 then 'insufficient_samples'
                         when n < 2 then 'too_few_common_times'
                         when miss > 0 then 'missing_values'
                         when sx = 0 or sy = 0 then 'constant' else 'ok' end as status from st)
, rr as (select *, case when status = 'ok' then greatest(-1.0, least(1.0, cov / (sx * sy))) end as r from st2)
{_pvalue_sql("rr", ["mx", "my"])}
select mx as metric_x, my as metric_y, n_x, n_y, n, round(r, 6) as correlation, status,
       round(case when status = 'ok' then p_value end, 6) as p_value
from pv2""")


def _quarantine_body(table: str, columns: str) -> str:
    return (f"select {columns}, failed_rules from (select {columns}, list_filter([" +
            ", ".join(f"case when coalesce({fail}, false) then '{name}' end" for name, _, _, fail in _job_checks()) +
            f"], lambda x: x is not null) as failed_rules from {table}) where len(failed_rules) > 0")


def _split_trim_sql(table: str) -> str:
    return (f"select {_trim_sql('x')} as node, count(*) as n_jobs "
            f"from (select unnest(string_split(host_list, ',')) as x from {table}) group by 1")


def _audit_body(table: str, checks: list[tuple[str, str, str, str]]) -> str:
    parts = []
    for name, column, message, fail in checks:
        msg = message.replace("'", "''")
        parts.append(f"select '{name}' as rule, '{column}' as column, count(*) as n_checked, "
                     f"count(*) filter (where coalesce({fail}, false)) as n_failed, '{msg}' as message from {table}")
    return "\n union all ".join(parts)


def _audit_sql(table: str, checks: list[tuple[str, str, str, str]]) -> str:
    return with_views(_audit_body(table, checks))


# the whitespace Python's strip()/float() remove, as an RE2 class
WS_RE2 = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_RE2}+|{WS_RE2}+$', '', 'g')"


def _list_fail(col: str, prefix: str) -> str:
    return (f"not list_bool_and(list_transform(string_split(cast({col} as varchar), ','), "
            f"lambda x: regexp_full_match(upper({_trim_sql('x')}), '{prefix}[0-9]+')))")


FLOAT_RE2 = (f"{WS_RE2}*[+-]?(?:(?:[0-9](?:_?[0-9])*\\.(?:[0-9](?:_?[0-9])*)?|\\.[0-9](?:_?[0-9])*"
             f"|[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|(?i:inf|infinity|nan)){WS_RE2}*")


def _num_fail(col: str) -> str:
    return f"not regexp_full_match(cast({col} as varchar), '{FLOAT_RE2}')"


def _in_fail(col: str, values) -> str:
    return f"not ({col} in ({', '.join(repr(v) for v in values)}))"


def _host_checks():
    return [("event_choice", "event", MESSAGES["event"], _in_fail("event", EVENTS)),
            ("host_format", "host", MESSAGES["host"], _list_fail("host", "NODE")),
            ("jid_format", "jid", MESSAGES["jid"], _list_fail("jid", "JOB")),
            ("unit_choice", "unit", MESSAGES["unit"], _in_fail("unit", list(UNIT_TO_EVENT))),
            ("value_numeric", "value", MESSAGES["value"], _num_fail("value"))]


def _job_checks():
    return [("jid_format", "jid", MESSAGES["jid"], _list_fail("jid", "JOB")),
            *[(f"{c}_numeric", c, numeric_message(c), _num_fail(c)) for c in ("ncores", "ngpus", "nhosts", "timelimit")],
            ("account_format", "account", MESSAGES["account"], _list_fail("account", "GROUP")),
            ("username_format", "username", MESSAGES["username"], _list_fail("username", "USER")),
            ("host_list_format", "host_list", MESSAGES["host_list"], _list_fail("host_list", "NODE")),
            ("jobname_format", "jobname", MESSAGES["jobname"], _list_fail("jobname", "JOBNAME")),
            ("queue_choice", "queue", "queue must be one of: " + ", ".join(QUEUES), _in_fail("queue", QUEUES)),
            ("exitcode_choice", "exitcode", "exitcode must be one of: " + ", ".join(EXITCODES),
             _in_fail("exitcode", EXITCODES))]


def oracle() -> dict[str, str]:
    hw = f"time between {_ts(HOST_WINDOW[0])} and {_ts(HOST_WINDOW[1])}"
    jw = f"start_time between {_ts(JOB_WINDOW[0])} and {_ts(JOB_WINDOW[1])}"
    all_pairs = (f"select a.event as mx, b.event as my from {EVENT_POS_SQL.replace('ep(', 'a(')} "
                 f"join {EVENT_POS_SQL.replace('ep(', 'b(')} on a.pos < b.pos")
    roll3 = _rolling_span_sql(["mean", "median", "std"], 3 * 3_600_000_000)
    # the rolling values are rounded in roll3; the box must see unrounded ones
    # (means from decimal sums: exact, so a quartile that is a tie of the last place kept does not follow the order of summation)
    roll3_raw = roll3.replace("round(avg(value) over w, 6)", "avg(cast(value as decimal(18, 6))) over w") \
        .replace("round(quantile_cont(value, 0.5) over w, 6)", "quantile_cont(value, 0.5) over w") \
        .replace("round(stddev_samp(value) over w, 6)", "stddev_samp(value) over w")
    rolling_src = (f"select event, stat as statistic, val as value from ({roll3_raw}) r "
                   "unpivot (val for stat in (mean, median, std)) where val is not null")
    hist = _bins_sql(f"select event, value from host_data where {NOT_NULL_ROW}")
    texts = {
        "host_filter_compare": with_views(
            f"select * from host_data where event = 'cpuuser' and value >= 20.5 and host != 'NODE3' and {hw}"),
        "host_like": with_views(
            "select host, jid, event, value from host_data where host like 'NODE1_' and jid like 'JOB1%'"),
        "host_in_list": with_views(
            "select event_id, time, host, value from host_data where event = 'memused' "
            "and host in ('NODE1', 'NODE2', 'NODE3')"),
        "host_distinct": with_views(f"select distinct host, jid from host_data where {hw}"),
        "host_topk": with_views(
            "select * from host_data order by value desc nulls first, event_id desc nulls first limit 25"),
        "row_count": with_views(
            "select count(*) as row_count from host_data where event = 'gpu_usage' and value > 50"),
        "raw_series": with_views(
            "select event_id, time, value from host_data where event = 'cpuuser' order by time, event_id"),
        "union_sources": with_views("select event, count(*) as n_rows from host_data group by event"),
        "unit_lookup": with_views("""
select distinct event, unit, case event when 'cpuuser' then 'CPU %' when 'gpu_usage' then 'GPU %'
       when 'memused' then 'GB:memused' when 'memused_minus_diskcache' then 'GB:memused_minus_diskcache'
       when 'block' then 'GB/s' when 'nfs' then 'MB/s' end as dim_unit
from host_data"""),
        "job_window_in_list": with_views(
            f"select jid, start_time, queue, ngpus from job_data where ngpus >= 4 and {jw} "
            "and queue in ('debug', 'highmem') order by start_time asc nulls last, jid asc nulls last limit 50"),
        "rolling_count_by_host": with_views("""
select event_id, time, event, host, value,
       round(case when count(value) over w >= 3 then avg(value) over w end, 6) as mean,
       round(case when count(value) over w >= 3 then stddev_samp(value) over w end, 6) as std
from host_data window w as (partition by event, host order by time, event_id rows between 2 preceding and current row)"""),
        "histogram_fixed_bins": with_views(_bins_sql(f"select event, value from host_data where {NOT_NULL_ROW}", 20)
                                           + """
select event, bin, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, count from hist"""),
        "job_window": with_views(
            f"select jid, submit_time, start_time, end_time, queue, nhosts from job_data where {jw}"),
        "job_filter_typed": with_views(
            "select * from job_data where ncores < 700.5 and timelimit >= 345600 and queue = 'debug'"),
        "job_filter_like_in": with_views(
            "select jid, username, account, runtime from job_data where username like 'USER1%' "
            "and account in ('GROUP1', 'GROUP2')"),
        "job_distinct_queue": with_views("select distinct queue, exitcode from job_data"),
        "job_topk": with_views(
            "select jid, node_hrs, nhosts from job_data order by node_hrs desc nulls first, jid desc nulls first "
            "limit 20"),
        "metric_summary": _summary_sql(),
        "metric_summary_window": _summary_sql(f"where {hw}"),
        "metric_select": _summary_sql("where unit = 'GB/s'", metrics=["block"]),
        "outside_ratio": with_views(f"""
, s as (select event, count(*) as n_rows, count(*) filter (where abs(value) > 50.0) as n_outside
        from host_data group by event)
select m.event, m.unit, coalesce(s.n_rows, 0) as n_rows, coalesce(s.n_outside, 0) as n_outside,
       round(s.n_outside / s.n_rows, 6) as ratio_outside, round(1 - s.n_outside / s.n_rows, 6) as ratio_inside
from {METRICS_SQL} left join s on m.event = s.event"""),
        "rolling_count_mean": _rolling_rows_sql(["mean"]),
        "rolling_count_median": _rolling_rows_sql(["median"]),
        "rolling_count_std": _rolling_rows_sql(["std"]),
        "rolling_count_plain": _rolling_rows_sql(["mean", "median", "std"]),
        "rolling_time_mean": _rolling_span_sql(["mean"], 3 * 3_600_000_000),
        "rolling_time_median": _rolling_span_sql(["median"], 3 * 3_600_000_000),
        "rolling_time_std": _rolling_span_sql(["std"], 3 * 3_600_000_000),
        "rolling_time_plain": roll3,
        "rolling_count_long": _rolling_rows_sql(["mean", "median", "std"], 700),
        "rolling_median_days": _rolling_span_sql(["median"], 5 * 24 * 3_600_000_000),
        "rolling_median_narrow_cells": _rolling_span_sql(["median", "std"], 5 * 24 * 3_600_000_000),
        "rolling_time_ties": with_views("""
, h as (select event_id, date_trunc('hour', time) as time, event, value from host_data)
select a.event_id, a.time, a.event, a.value, round(avg(b.value), 6) as mean,
       round(quantile_cont(b.value, 0.5), 6) as median, round(stddev_samp(b.value), 6) as std
from h a join h b on a.event = b.event and b.time > a.time - interval 2 hour
     and (b.time < a.time or (b.time = a.time and b.event_id <= a.event_id))
group by a.event_id, a.time, a.event, a.value"""),
        "rolling_by_host": _rolling_span_sql(["mean"], 6 * 3_600_000_000, by="event, host", extra="host, "),
        "histogram": with_views(hist + """
select event, bin, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, count from hist"""),
        "cdf": with_views(hist + """
select event, bin, round(bin_lo, 6) as bin_lo, round(bin_hi, 6) as bin_hi, count,
       cast(sum(count) over (partition by event order by bin rows between unbounded preceding and current row)
            as bigint) as cum_count,
       round(sum(count) over (partition by event order by bin rows between unbounded preceding and current row)
             / sum(count) over (partition by event), 6) as cum_fraction
from hist"""),
        "kde": with_views(hist + """
, ks as (select event, count(*) as n, min(value) as lo, max(value) as hi, stddev_samp(value) as sd
         from v group by event having stddev_samp(value) > 0)
, kh as (select *, sd * pow(cast(n as double), -0.2) as h from ks)
, kg as (select event, n, lo, hi, h, j,
                case when j = 199 then hi else lo + j * ((hi - lo) / 199) end as x
         from kh, range(0, 200) as t(j))
, kd as (select kg.event, kg.j, kg.x, kg.n, kg.h,
                sum(exp(-0.5 * pow((kg.x - v.value) / kg.h, 2))) as s
         from kg join v on kg.event = v.event group by kg.event, kg.j, kg.x, kg.n, kg.h)
select kd.event, cast(kd.j as integer) as point, round(kd.x, 6) as x,
       round(kd.s / (kd.n * kd.h * sqrt(2 * pi())), 9) as density,
       round(kd.s / (kd.n * kd.h * sqrt(2 * pi())) * kd.n * ((l.le - l.fe) / l.nb), 6) as count_density,
       round(kd.h, 9) as bandwidth
from kd join lay l on kd.event = l.event"""),
        "box_raw": with_views(_box_sql("select event, value from host_data where value is not null", ["event"])),
        "box_rolling": with_views(_box_sql(rolling_src, ["event", "statistic"])),
        "box_outliers": with_views(
            _box_sql("select event, value from host_data where value is not null", ["event"])
            .split("\nselect b.event, b.n")[0] + """
select h.event_id, h.event, h.time, h.value, round(b.whislo, 6) as whislo, round(b.whishi, 6) as whishi
from host_data h join b on h.event = b.event
where h.value is not null and (h.value < b.whislo or h.value > b.whishi)"""),
        "paired_points": with_views("""
, h as (select event_id, date_trunc('hour', time) as t, event, value from host_data)
, a as (select t, arg_min(value, event_id) as x from h where event = 'cpuuser' group by t)
, b as (select t, arg_min(value, event_id) as y from h where event = 'memused' group by t)
select a.t as time, a.x, b.y from a join b on a.t = b.t"""),
        "common_times": with_views("""
select date_trunc('hour', time) as time from host_data where event = 'cpuuser'
intersect
select date_trunc('hour', time) as time from host_data where event = 'memused'"""),
        "pearson": _pearson_sql("select 'cpuuser' as mx, 'memused' as my"),
        "pearson_pairs": _pearson_sql(all_pairs),
        "quality_audit_host": _audit_sql("host_data", _host_checks()),
        "quality_audit_job": _audit_sql("job_data", _job_checks()),
        "quarantine_job": with_views(_quarantine_body("job_data", "jid")),
        "clean_text": with_views(
            "select distinct unit, regexp_replace(unit, '[^a-zA-Z0-9,]', '', 'g') as cleaned from host_data"),
        "split_trim": with_views(_split_trim_sql("job_data")),
        "quality_audit_host_dirty": with_dirty_views(_audit_body("host_dirty", _host_checks())),
        "quality_audit_job_dirty": with_dirty_views(_audit_body("job_dirty", _job_checks())),
        "quarantine_job_dirty": with_dirty_views(_quarantine_body("job_dirty", "jid, jobname")),
        "split_trim_dirty": with_dirty_views(_split_trim_sql("job_dirty")),
        "rolling_dirty": with_dirty_views("""
select event_id, event, host, cast(big as varchar) as big, round(avg(v) over w, 6) as mean, round(quantile_cont(v, 0.5) over w, 6) as median,
       round(stddev_samp(v) over w, 6) as std
from (select *, case when isfinite(value) then value end as v from samples_dirty)
window w as (partition by event, host order by epoch_us(time) range between 21599999999 preceding and current row)"""),
        "rolling_time_days": with_views("""
select event_id, time, event, round(avg(v) over w, 6) as mean, round(stddev_samp(v) over w, 6) as std
from (select *, value * 1.4142135623730951 as v from host_data)
window w as (partition by event order by epoch_us(time) range between 431999999999 preceding and current row)"""),
        "analyse_series": with_views("select event_id, time, host, jid, event, unit, value from host_data"),
        "job_filter_big_int": with_views(
            "select jid, n as ncores from (select jid, cast(substr(jid, 4) as bigint) + 9007199254740992 as n from job_data) "
            "where n >= 9007199254740993 and n < 9007199254741093"),
        "job_in_long_list": with_views("select jid, queue from job_data where cast(substr(jid, 4) as bigint) % 7 = 0 "
                                       "and cast(substr(jid, 4) as bigint) < 60000"),
        "drop_aux": with_views("select event_id, time, host, jid, event, unit, value from host_data"),
        "series_columns": with_views("select time, event, value, event_id from host_data"),
        "parameter_sql": with_views("select host, count(*) as n, max(value) as top from host_data where event = 'block' and value > 10 group by host"),
        "utc_naive": with_views("select event_id, time - interval 2 hours as seen from host_data"),
        "time_stamp": with_views("select event_id, strftime(time, '%Y-%m-%d-%H-%M-%S') as stamp from host_data"),
        "fixed_decimals": with_views("select event_id, printf('%.2f', round(value, 1)) as label from host_data"),
        "whole_days": with_views("select jid, cast(floor((epoch_us(end_time) - epoch_us(submit_time)) / 86400000000) as bigint) as days from job_data"),
    }
    plain = "select event, value from host_data where"
    for name in ("histogram", "cdf", "kde", "box_raw"):   # the same questions over rows with gaps
        assert plain in texts[name]
        texts[f"{name}_dirty"] = texts[name].replace(plain, f"select event, value from {GAPS_SQL} gaps where")
    whole = "select event, count(*) as n, count(value) as n_values, cast(round(sum(cast(value as decimal(18, 6))), 2) as double) as total from host_data"
    texts["split_pieces"] = with_views(whole + " group by event")
    texts["host_layout_window"] = with_views(f"{whole} where event in ('cpuuser', 'nfs') and {hw} group by event")
    return texts
