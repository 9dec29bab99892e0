"""Schemas of the two tables and the fixed value lists of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the source data model exactly.
# ---------------------------------------------------------------------------

# Metric dimension, unit -> event, in the order the metrics are offered.
UNIT_TO_EVENT = {
    "CPU %": "cpuuser",
    "GPU %": "gpu_usage",
    "GB:memused": "memused",
    "GB:memused_minus_diskcache": "memused_minus_diskcache",
    "GB/s": "block",
    "MB/s": "nfs",
}
# Allowed `event` values, in the order the validator lists them.
EVENTS = ["cpuuser", "block", "memused", "memused_minus_diskcache", "gpu_usage", "nfs"]
# Allowed `unit` values, in the order the validator lists them.
UNITS = ["CPU %", "GPU %", "GB:memused", "GB:memused_minus_diskcache", "GB/s", "MB/s"]
# Offered `queue` values.
QUEUES = ["standard", "wholenode", "shared", "highmem", "gpu", "benchmarking", "wide", "debug", "gpu-debug"]
# Offered `exitcode` values.
EXITCODES = ["TIMEOUT", "COMPLETED", "CANCELLED", "FAILED", "NODE_FAIL"]
# Comparison operators offered for both tables.
OPERATORS = ["=", "!=", "<", ">", "<=", ">=", "LIKE"]
# Largest time window in days (None = no cap).
MAX_DAYS_HOSTS = 5
MAX_DAYS_JOBS = 180
# Host columns that are dropped before statistics.
AUX_HOST_COLUMNS = ["type", "diff", "arc"]
# Export file name stamp.
EXPORT_TIME_FORMAT = "%Y-%m-%d-%H-%M-%S"

EVENT_TO_UNIT = {event: unit for unit, event in UNIT_TO_EVENT.items()}

HOST_SCHEMA = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("host", T.StringType()),
    T.StructField("jid", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

HOST_OPTIONAL = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("diff", T.DoubleType()),
    T.StructField("arc", T.DoubleType()),
])

JOB_SCHEMA = T.StructType([
    T.StructField("jid", T.StringType()),
    T.StructField("submit_time", T.TimestampNTZType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("runtime", T.DoubleType()),
    T.StructField("timelimit", T.DoubleType()),
    T.StructField("node_hrs", T.DoubleType()),
    T.StructField("nhosts", T.LongType()),
    T.StructField("ncores", T.LongType()),
    T.StructField("ngpus", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("account", T.StringType()),
    T.StructField("queue", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("jobname", T.StringType()),
    T.StructField("exitcode", T.StringType()),
    T.StructField("host_list", T.StringType()),
])

JOB_COLUMNS = [f.name for f in JOB_SCHEMA.fields]
HOST_COLUMNS = [f.name for f in HOST_SCHEMA.fields]


def metric_dimension(spark):
    """The six-row unit/event table (a static dimension, always broadcast)."""
    rows = [(unit, event) for unit, event in UNIT_TO_EVENT.items()]
    return spark.createDataFrame(rows, "unit string, event string")
