"""The whole analysis request as one call.

``analyse(samples, stats=[...], interval=..., metrics=..., threshold=...)``
returns a dict of DataFrames, one per result table (multi-pass tables compute
their small inputs while the plan is built), for *all* chosen
metrics at once (the original loops metric by metric and statistic by
statistic; here each table is one plan grouped by metric):

* ``series``     the raw samples of the metrics (what the charts draw, Q17); the
                 statistic ``None``, the default choice, asks for nothing else
* ``summary``    mean/median/std per metric (interval None)
* ``rolling``    one column per statistic (interval Rows/Span)
* ``histogram``  "PDF" counts, plus ``kde`` for the density curve
* ``cdf``        running counts
* ``outside``    ratio outside ``threshold``
* ``box``        box summary of the rolling outputs, or of the raw values

``explain(df)`` gives the plan text (the query preview of the original).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.predicates import FilterSpec, select_metrics
from hpcstats.operators.box import box_source, box_stats
from hpcstats.operators.distribution import cdf, histogram, kde
from hpcstats.operators.extract import drop_aux
from hpcstats.operators.rolling import STATS, rolling
from hpcstats.operators.summary import metric_summary, outside_ratio, slice_metrics
from hpcstats.plans.joins import stored_columns

# Statistic names offered to the user.
STAT_NAMES = {"Mean": "mean", "Median": "median", "Standard Deviation": "std", "PDF": "pdf", "CDF": "cdf",
              "Ratio of Data Outside Threshold": "outside"}


def _names(stats) -> list[str]:
    out = []
    for s in [stats] if stats is None or isinstance(stats, str) else stats:
        if s in (None, "None"):   # the raw series only
            continue
        name = STAT_NAMES.get(s, s)
        if name not in (*STATS, "pdf", "cdf", "outside"):
            raise ValueError(f"unknown statistic {s!r}")
        out.append(name)
    return out


def analyse(samples: DataFrame, stats=("mean", "median", "std"), interval=None, metrics=None,
            spec: FilterSpec | None = None, threshold: float | None = None, tie: str | None = None,
            by=("event",), **rolling_kw) -> dict[str, DataFrame]:
    names = _names(stats)
    if metrics is None:
        metrics = select_metrics(spec)
    data = slice_metrics(drop_aux(samples), metrics)
    basic = [s for s in names if s in STATS]
    out: dict[str, DataFrame] = {"series": data}
    if basic:
        if isinstance(interval, (Rows, Span)):
            keep = list(dict.fromkeys(c for c in ("time", "event", *by, "value", *([tie] if isinstance(tie, str) else tie or ())) if c))
            # computed once: the rolling table is returned and also feeds the box passes
            out["rolling"] = stored_columns(rolling(data.select(*keep), basic, interval, by=by, tie=tie, **rolling_kw), "rolling")
            src = _rolling_box_source(out["rolling"], basic, by)
        elif interval is None:
            out["summary"] = metric_summary(data, metrics, basic)
            src = box_source(data, source="raw", by=by)
        else:
            raise ValueError("interval must be None, Rows(n) or Span(n, unit)")
        out["box"] = box_stats(src, by=[*by, "statistic"])
    if "pdf" in names:
        out["histogram"] = histogram(data)
        out["kde"] = kde(data)
    if "cdf" in names:
        out["cdf"] = cdf(data)
    if "outside" in names:
        if threshold is None:
            raise ValueError("the outside ratio needs a threshold")
        out["outside"] = outside_ratio(data, threshold, metrics)
    return out


def _rolling_box_source(rolled: DataFrame, basic: list[str], by) -> DataFrame:
    from pyspark.sql import functions as F
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in basic]))
    return rolled.select(*by, rows)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (what the query preview shows)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
