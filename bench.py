"""Headline timings: prints one JSON line.

Runs the main operators on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and writes each result to Spark's ``noop`` sink,
so the whole plan runs without collecting anything.  One untimed warm-up
query starts the JVM code paths and the Python workers; then each query runs
``$BENCH_REPEAT`` times (default 3) and the best time is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hpcstats.functions.intervals import Rows, Span  # noqa: E402
from hpcstats.operators.rolling import rolling  # noqa: E402
from hpcstats.plans import catalog  # noqa: E402
from hpcstats.session import build_session  # noqa: E402
from hpcstats.sources.shared_tables import host_view  # noqa: E402


def _rolling_6h(stat):
    def q(spark, sf):
        return rolling(host_view(spark, sf).select("event_id", "time", "event", "value"), [stat],
                       Span(6, "Hours"), tie="event_id")
    return q


def _rolling_rows(stat, n=50):
    def q(spark, sf):
        return rolling(host_view(spark, sf).select("event_id", "time", "event", "value"), [stat],
                       Rows(n), tie="event_id")
    return q


BENCH = {
    "host_filter_compare": catalog.q_host_filter_compare,
    "host_topk": catalog.q_host_topk,
    "job_filter_typed": catalog.q_job_filter_typed,
    "metric_summary": catalog.q_metric_summary,
    "outside_ratio": catalog.q_outside_ratio,
    "rolling_6h_mean": _rolling_6h("mean"),
    "rolling_6h_median": _rolling_6h("median"),
    "rolling_50rows_std": _rolling_rows("std"),
    "rolling_time_ties": catalog.q_rolling_ties,
    "histogram": catalog.q_histogram,
    "kde": catalog.q_kde,
    "box_raw": catalog.q_box_raw,
    "pearson_pairs": catalog.q_pearson_pairs,
    "quality_audit_job": catalog.q_quality_audit_job,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or list(BENCH)
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    # warm-up, untimed: JIT of the common code paths and the Python worker pool
    for warm in ("metric_summary", "rolling_6h_median"):
        BENCH[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            BENCH[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": f"total_best_of_{repeat}", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
