"""The two tables of the data model, derived from the shared test tables.

`events` becomes ``host_data`` (one sample per row) and `orders` becomes
``job_data`` (one job per row).  The same derivation is given as SQL text
(``HOST_DATA_SQL`` / ``JOB_DATA_SQL``) so that an independent engine can
check every operator on identical input.  `event_id` is kept as the unique
tie key of a sample; it is not part of the product schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hpcstats.sources.readers import conform_host, conform_job

# event_type of the shared `events` table -> (event, unit) of the data model
EVENT_TYPE_MAP = {
    "click": ("cpuuser", "CPU %"),
    "view": ("memused", "GB:memused"),
    "purchase": ("block", "GB/s"),
    "signup": ("nfs", "MB/s"),
    "error": ("gpu_usage", "GPU %"),
}

# orders.o_orderpriority -> queue; orders.o_orderstatus -> exitcode/state
PRIORITY_QUEUE = {"1-URGENT": "debug", "2-HIGH": "highmem", "3-MEDIUM": "wholenode",
                  "4-NOT SPECIFIED": "shared"}
STATUS_EXIT = {"F": "COMPLETED", "O": "TIMEOUT"}


def _case(col: str, mapping: dict, default=None):
    expr = None
    for key, value in mapping.items():
        cond = F.col(col) == F.lit(key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr if default is None else expr.otherwise(F.lit(default))


def host_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = ev.select(
        F.col("event_id"),
        F.col("ts").alias("time"),
        F.concat(F.lit("NODE"), (F.col("user_id") % 20 + 1).cast("string")).alias("host"),
        F.concat(F.lit("JOB"), (F.col("user_id") + 1).cast("string")).alias("jid"),
        _case("event_type", {k: v[0] for k, v in EVENT_TYPE_MAP.items()}).alias("event"),
        _case("event_type", {k: v[1] for k, v in EVENT_TYPE_MAP.items()}).alias("unit"),
        F.col("value"),
    )
    return conform_host(df)


def job_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    hours = F.col("o_orderkey") % 24
    span = 1 + F.col("o_custkey") % 48
    width = 1 + F.col("o_orderkey") % 16
    df = o.select(
        F.concat(F.lit("JOB"), F.col("o_orderkey").cast("string")).alias("jid"),
        day.alias("submit_time"),
        (day + F.make_dt_interval(hours=hours)).alias("start_time"),
        (day + F.make_dt_interval(hours=hours + span)).alias("end_time"),
        (span * 3600).cast("double").alias("runtime"),
        F.lit(96.0 * 3600).alias("timelimit"),
        (span * width).cast("double").alias("node_hrs"),
        width.cast("long").alias("nhosts"),
        (128 * width).cast("long").alias("ncores"),
        F.when(F.col("o_orderkey") % 10 == 0, 4).otherwise(0).cast("long").alias("ngpus"),
        F.concat(F.lit("USER"), F.col("o_custkey").cast("string")).alias("username"),
        F.concat(F.lit("GROUP"), (F.col("o_custkey") % 25).cast("string")).alias("account"),
        _case("o_orderpriority", PRIORITY_QUEUE, "standard").alias("queue"),
        _case("o_orderstatus", STATUS_EXIT, "FAILED").alias("state"),
        F.concat(F.lit("JOBNAME"), (F.col("o_orderkey") % 97).cast("string")).alias("jobname"),
        _case("o_orderstatus", STATUS_EXIT, "FAILED").alias("exitcode"),
        F.concat(F.lit("NODE"), (F.col("o_orderkey") % 20 + 1).cast("string")).alias("host_list"),
    )
    return conform_job(df)


# The same two derivations as SQL (DuckDB dialect), for independent checks.
HOST_DATA_SQL = """
select event_id, ts as time,
  concat('NODE', cast(user_id % 20 + 1 as varchar)) as host,
  concat('JOB', cast(user_id + 1 as varchar)) as jid,
  case event_type when 'click' then 'cpuuser' when 'view' then 'memused' when 'purchase' then 'block'
                  when 'signup' then 'nfs' when 'error' then 'gpu_usage' end as event,
  case event_type when 'click' then 'CPU %' when 'view' then 'GB:memused' when 'purchase' then 'GB/s'
                  when 'signup' then 'MB/s' when 'error' then 'GPU %' end as unit,
  case when isnan(value) then null else value end as value
from events
"""

JOB_DATA_SQL = """
select concat('JOB', cast(o_orderkey as varchar)) as jid,
  cast(o_orderdate as timestamp) as submit_time,
  cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 24 as bigint)) as start_time,
  cast(o_orderdate as timestamp) + to_hours(cast(o_orderkey % 24 + 1 + o_custkey % 48 as bigint)) as end_time,
  cast((1 + o_custkey % 48) * 3600 as double) as runtime,
  cast(96 * 3600 as double) as timelimit,
  cast((1 + o_custkey % 48) * (1 + o_orderkey % 16) as double) as node_hrs,
  cast(1 + o_orderkey % 16 as bigint) as nhosts,
  cast(128 * (1 + o_orderkey % 16) as bigint) as ncores,
  cast(case when o_orderkey % 10 = 0 then 4 else 0 end as bigint) as ngpus,
  concat('USER', cast(o_custkey as varchar)) as username,
  concat('GROUP', cast(o_custkey % 25 as varchar)) as account,
  case o_orderpriority when '1-URGENT' then 'debug' when '2-HIGH' then 'highmem' when '3-MEDIUM' then 'wholenode'
                       when '4-NOT SPECIFIED' then 'shared' else 'standard' end as queue,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'TIMEOUT' else 'FAILED' end as state,
  concat('JOBNAME', cast(o_orderkey % 97 as varchar)) as jobname,
  case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'TIMEOUT' else 'FAILED' end as exitcode,
  concat('NODE', cast(o_orderkey % 20 + 1 as varchar)) as host_list
from orders
"""


def with_views(body: str) -> str:
    """Prefix a query on host_data/job_data with the two derivations."""
    return f"with host_data as ({HOST_DATA_SQL}), job_data as ({JOB_DATA_SQL})\n{body}"
