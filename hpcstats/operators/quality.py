"""Data-quality audit and quarantine over whole tables.

``audit`` checks every rule in one pass (one ``count_if`` per rule in a
single aggregate with map-side partial aggregation) and returns one row per
rule.  ``quarantine`` returns the failing rows with the names of the rules
they fail; ``passing`` the rest.  Both are plain filters: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hpcstats.functions.rules import Rule


def audit(df: DataFrame, rules: list[Rule]) -> DataFrame:
    present = [r for r in rules if r.column in df.columns]
    if not present:
        raise ValueError("no rule applies to these columns")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    aggs += [F.count_if(~r.check).alias(f"_f{i}") for i, r in enumerate(present)]
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column"),
                              F.col("_rows").alias("n_checked"), F.col(f"_f{i}").alias("n_failed"),
                              F.lit(r.message).alias("message"))
                     for i, r in enumerate(present)])
    return df.agg(*aggs).select(F.inline(rows))


def failed_rules(rules: list[Rule]):
    names = F.array(*[F.when(~r.check, F.lit(r.name)) for r in rules])
    return F.filter(names, lambda x: x.isNotNull())


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    present = [r for r in rules if r.column in df.columns]
    return df.withColumn("failed_rules", failed_rules(present)).where(F.size("failed_rules") > 0)


def passing(df: DataFrame, rules: list[Rule]) -> DataFrame:
    present = [r for r in rules if r.column in df.columns]
    cond = F.lit(True)
    for r in present:
        cond = cond & r.check
    return df.where(cond)
