"""Exact quantiles per group that do not put a whole group into one task.

Linear interpolation between order statistics (the rule of pandas/numpy
`median`/`percentile` and SQL `quantile_cont`): for ``n`` values and
probability ``p``, ``pos = p*(n-1)``; the answer is
``v[floor(pos)] + (v[ceil(pos)] - v[floor(pos)]) * (pos - floor(pos))``.

Small groups (every group at most ``in_memory_rows`` values) use Spark's
exact ``percentile`` aggregate, all probabilities in one.  Bigger groups are
solved by refinement, which is exact and keeps every task bounded:

1. per group ``n`` (one aggregate);
2. a value range that holds wanted ranks is split at ``splits`` of its own
   approximate quantiles (``percentile_approx``, mergeable summaries), every
   split value being a bucket of its own.  Rows are counted per bucket
   (partial aggregation; a hot group is spread over all map tasks), and ranks
   come from these counts, so nothing approximate reaches the answer;
3. a rank that falls on a split value is solved; the others go on with the
   open range between two split values, which holds about a ``splits``-th of
   the rows, until at most ``rank_rows`` are left.  These are ranked by a
   window whose partitions hold at most ``rank_rows`` rows.

Splits are values of the data and lie by count, not by distance: infinities
and extreme magnitudes are values like any other, and every round narrows a
range at least by its own split values.  NULL group keys form a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.plans.joins import join_null_safe, join_small, materialize, observed
from hpcstats.sources.readers import nan_to_null

IN_MEMORY_ROWS = 2_000_000
RANK_ROWS = 1_000_000
SPLITS = 256


def _prob_name(p: float) -> str:
    return "q_" + ("%g" % p).replace(".", "_")


def group_bounds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, min and max of the non-null values per group."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | tuple = (),
                    names: list[str] | None = None, bounds: DataFrame | None = None,
                    in_memory_rows: int = IN_MEMORY_ROWS, rank_rows: int = RANK_ROWS,
                    splits: int = SPLITS) -> DataFrame:
    """One row per group: ``by`` columns + one column per probability.

    ``bounds`` may pass an already materialised ``group_bounds`` table.
    Groups without non-null values do not appear.
    """
    by = list(by)
    names = list(names) if names else [_prob_name(p) for p in probs]
    if len(names) != len(probs) or any(not 0.0 <= p <= 1.0 for p in probs):
        raise ValueError("one name per probability, each in [0, 1]")
    base = df.select(*by, nan_to_null(value).alias("_v")).where(F.col("_v").isNotNull())
    key = by
    if not by:
        base = base.withColumn("_g", F.lit(0))
        key = ["_g"]
    if bounds is None:
        bounds = materialize(group_bounds(base, "_v", key), "bounds", {"max_n": F.max("_n")})
    biggest = observed(bounds).get("max_n") if "max_n" in observed(bounds) else bounds.agg(F.max("_n")).first()[0]
    if not by and "_g" not in bounds.columns:
        bounds = bounds.withColumn("_g", F.lit(0))
    if biggest is None:  # no values at all: empty result with the right schema
        empty = bounds.select(*key, *[F.lit(None).cast("double").alias(n) for n in names]).limit(0)
        return empty.drop("_g") if not by else empty
    if biggest <= in_memory_rows:
        found = base.groupBy(*key).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
        out = found.select(*key, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
        return out.drop("_g") if not by else out

    # ---- refinement: state per wanted rank: open range (_lo, _hi) (NULL: no bound), values below it and in it
    prob_rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(i).alias("i")) for i, p in enumerate(probs)])
    per_prob = (bounds.select(*key, "_n", F.explode(prob_rows).alias("_pp"))
                .withColumn("_pos", F.col("_pp.p") * (F.col("_n") - 1))
                .select(*key, F.col("_pp.i").alias("_i"), "_n", "_pos", F.floor("_pos").alias("_klo"), F.ceil("_pos").alias("_khi")))
    per_prob = materialize(per_prob, "probs")
    none = F.lit(None).cast("double")
    pending = materialize(per_prob.select(*key, "_n", F.explode(F.array("_klo", "_khi")).alias("_k")).distinct().select(
        *key, "_k", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_cnt")), "rank-state")
    rng = [*key, "_lo", "_hi"]          # ranks of a group that share a value range share the work
    inside = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    solved = []

    def rows_of(state: DataFrame, label: str) -> DataFrame:
        ranges = materialize(state.select(*rng).distinct(), label)
        return join_small(base, ranges, key).where(inside)

    while not pending.isEmpty():
        small = pending.where(F.col("_cnt") <= rank_rows)
        if not small.isEmpty():
            ranked = rows_of(small, "rank-ranges").withColumn("_rn", F.row_number().over(Window.partitionBy(*rng).orderBy("_v")))
            want = small.select(*rng, "_k", (F.col("_k") - F.col("_below") + 1).alias("_rn"))
            hits = join_small(ranked, materialize(want, "rank-wanted"), [*rng, "_rn"])
            solved.append(materialize(hits.select(*key, "_k", F.col("_v").alias("_ans")), "ranked"))
        big = pending.where(F.col("_cnt") > rank_rows)
        if big.isEmpty():
            break
        rows = rows_of(big, "split-ranges")
        points = F.array(*[F.lit((i + 1) / (splits + 1)) for i in range(splits)])
        cuts = materialize(rows.groupBy(*rng).agg(F.sort_array(F.array_distinct(F.percentile_approx("_v", points, 20 * splits))).alias("_cuts")), "cuts")
        # bucket 2i: between cuts i-1 and i; bucket 2i+1: cut i itself
        under = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        bucket = 2 * under + F.array_contains("_cuts", F.col("_v")).cast("int")
        counts = join_small(rows, cuts, rng).groupBy(*rng, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*rng).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_prev", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        counts = materialize(join_null_safe(counts, cuts, rng), "split-counts")
        at = F.col("_below") + F.col("_prev")
        hit = join_null_safe(big.select(*rng, "_k", "_below"), counts, rng).where((at <= F.col("_k")) & (F.col("_k") < at + F.col("_c")))
        i = F.floor(F.col("_b") / 2).cast("int")
        found = materialize(hit.select(
            *key, "_k", F.when(F.col("_b") % 2 == 1, F.get("_cuts", i)).alias("_ans"),
            F.when(i > 0, F.get("_cuts", i - 1)).otherwise(F.col("_lo")).alias("_lo2"),
            F.coalesce(F.get("_cuts", i), F.col("_hi")).alias("_hi2"), at.alias("_below"), F.col("_c").alias("_cnt")), "rank-state")
        solved.append(found.where(F.col("_ans").isNotNull()).select(*key, "_k", "_ans"))
        pending = found.where(F.col("_ans").isNull()).select(*key, "_k", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), "_below", "_cnt")
    answers = reduce(DataFrame.unionByName, solved)
    lo_v = answers.select(*key, F.col("_k").alias("_klo"), F.col("_ans").alias("_vlo"))
    hi_v = answers.select(*key, F.col("_k").alias("_khi"), F.col("_ans").alias("_vhi"))
    both = join_null_safe(join_null_safe(per_prob, lo_v, [*key, "_klo"]), hi_v, [*key, "_khi"])
    # as the aggregate does: no arithmetic where both ranks are one value (infinities)
    value = F.when((F.col("_klo") == F.col("_khi")) | (F.col("_vlo") == F.col("_vhi")), F.col("_vlo")).otherwise(
        (F.col("_khi") - F.col("_pos")) * F.col("_vlo") + (F.col("_pos") - F.col("_klo")) * F.col("_vhi"))
    out = both.withColumn("_q", value).groupBy(*key).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])
    return out.drop("_g") if not by else out
