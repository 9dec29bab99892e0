"""Row-level operators on a stream of new sample files (Structured Streaming).

The original reads one bounded query at a time; host samples, however, keep
arriving.  Everything that works row by row -- conforming the schema,
NaN -> NULL, the filter part of an extract (conditions, window, IN list), the
column rules with quarantine -- is a stateless plan and runs unchanged on a
streaming DataFrame.  Statistics over whole series stay batch jobs over the
written table (`hpcstats.operators`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.functions.predicates import FilterSpec
from hpcstats.functions.rules import Rule
from hpcstats.operators.quality import failed_rules
from hpcstats.schema import HOST_SCHEMA
from hpcstats.sources.readers import conform_host


def read_host_stream(spark: SparkSession, path: str, schema: T.StructType = HOST_SCHEMA, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """New files under ``path`` as a streaming host-sample frame (schema given, never inferred)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return conform_host(reader.load(path))


def filter_stream(stream: DataFrame, spec: FilterSpec) -> DataFrame:
    """The filter and projection part of an extract on a stream.

    ORDER BY, LIMIT and DISTINCT need the whole input; they are refused here.
    """
    if spec.order_by or spec.limit or spec.distinct:
        raise ValueError("ORDER BY, LIMIT and DISTINCT need a batch extract")
    cond = spec.condition(stream.schema)
    out = stream.where(cond) if cond is not None else stream
    cols = list(spec.columns)
    return out if "*" in cols else out.select(*cols)


def split_by_rules(stream: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(passing rows, quarantined rows with the names of the failed rules)."""
    present = [r for r in rules if r.column in stream.columns]
    tagged = stream.withColumn("failed_rules", failed_rules(present))
    return (tagged.where(F.size("failed_rules") == 0).drop("failed_rules"),
            tagged.where(F.size("failed_rules") > 0))


def write_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True,
                 partition_by=None):
    """Append a stream to files; the checkpoint folder makes restarts exactly-once."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
