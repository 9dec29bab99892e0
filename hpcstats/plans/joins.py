"""Small-table plumbing: materialise per-group tables, join them back safely.

Per-group statistics (counts, bounds, quartiles) are tiny next to the samples
but are used by a second pass over the samples.  Two rules apply:

* the small table is computed once into the session's shared checkpoint
  folder (survives executor loss, cuts lineage);
* it is broadcast only after its row count was checked; above the bound the
  join is a salted shuffle join: every key of the big side is spread over
  ``JOIN_SALTS`` partitions by a hash of the row (deterministic, so a
  recomputed stage agrees), and the small side is copied once per salt by a
  generator, so a hot key (one metric may hold a third of all rows) never
  lands in one task, whatever the session's AQE settings.  (Rows equal in
  every column share a salt; sample rows carry a unique tie key.)
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hpcstats.session import ensure_checkpoint_dir

# A per-group row is a few longs/doubles (< 200 bytes): 500k rows stay < 100 MB.
BROADCAST_MAX_ROWS = 500_000
JOIN_SALTS = 32


def materialize(df: DataFrame, label: str = "t", observe: dict | None = None) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder (reliable checkpoint).

    One job computes and writes it; later plans read the checkpoint instead of
    recomputing the lineage, and a lost executor does not lose it.  The row
    count (and any ``observe`` metrics, name -> aggregate Column) is collected
    by the same job and kept on the result (``observed(df)``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation(f"hpcstats-{label}-{uuid.uuid4().hex[:12]}")
    metrics = [F.count(F.lit(1)).alias("rows")] + [c.alias(k) for k, c in (observe or {}).items()]
    out = df.observe(obs, *metrics).checkpoint(eager=True)
    out._hpcstats_observed = dict(obs.get)
    return out


def stored_columns(df: DataFrame, label: str = "t") -> DataFrame:
    """Write a sample-sized table once as Parquet in the shared checkpoint folder and read it back.

    For tables that several passes read: columnar, compressed, and each pass
    reads the columns it needs (a checkpoint keeps whole rows).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame) -> dict:
    """Metrics gathered while ``df`` was materialised ({} for other frames)."""
    return getattr(df, "_hpcstats_observed", {})


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Row-count check of a small side: known from materialisation, else a bounded count."""
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    rows = observed(df).get("rows")
    if rows is None:
        rows = df.limit(max_rows + 1).count()
    return rows <= max_rows


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", cols=None,
               max_rows: int | None = None) -> DataFrame:
    """Join a big frame with a small per-group table; broadcast only if checked small.

    ``cols`` selects the columns of ``small`` to bring along (after the check,
    so a materialised table keeps its known row count).
    """
    small_enough = is_small(small, BROADCAST_MAX_ROWS if max_rows is None else max_rows)
    side = small.select(*cols) if cols is not None else small
    keys = [on] if isinstance(on, str) else list(on)
    if small_enough:
        return join_null_safe(big, F.broadcast(side), keys, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(JOIN_SALTS))
    salted_big = big.withColumn("_salt", salt)
    salted_side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(JOIN_SALTS - 1).cast("long"))))
    return join_null_safe(salted_big, salted_side, [*keys, "_salt"], how).drop("_salt")


def join_null_safe(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL: a NULL group key is a group like any other.

    The columns are those of a join by name: the keys once (from the left).
    """
    keys = [on] if isinstance(on, str) else list(on)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
