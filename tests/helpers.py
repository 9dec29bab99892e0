"""Shared by the core tests: paths of the shared tables and small host-shaped frames."""

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def host_frame(spark, rows, extra_cols=""):
    """rows of (event_id, time, event, value) -> host-shaped frame."""
    from pyspark.sql import functions as F
    from hpcstats.sources.readers import conform_host
    df = spark.createDataFrame(rows, "event_id long, time string, event string, value double" + extra_cols)
    df = df.withColumn("time", F.to_timestamp_ntz("time")) \
        .withColumn("host", F.lit("NODE1")).withColumn("jid", F.lit("JOB1")) \
        .withColumn("unit", F.lit("CPU %"))
    return conform_host(df)
