"""Spark session helpers.

The library never builds its own cluster settings into operators; it only reads
what the session says.  ``build_session`` is for tests, the bench and the
examples; on a cluster the caller brings a session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC so that naive timestamps mean the same
# thing in Spark, DuckDB and pandas; AQE for runtime coalescing, skew-join
# splitting and small-side broadcast decisions made on real sizes.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpointed small tables are deleted once no DataFrame refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hpcstats", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (``local[*]`` by default)."""
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("HPCSTATS_MASTER", "local[*]"))
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("HPCSTATS_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach (HDFS, object store); we use it as it is.  Only when it is unset
    *and* the master is local (tests, bench) do we make a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; multi-pass operators need a shared folder")
    folder = tempfile.mkdtemp(prefix="hpcstats-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()
