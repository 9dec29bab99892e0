"""Rolling mean / median / standard deviation.

``rolling(df, stats, interval, by=('event',), tie=None, ties='peers')`` adds one
column per statistic to every sample row; all other columns pass unchanged.

* ``Rows(n)``: frame = the current row and the ``n-1`` before it in
  ``(time, tie)`` order; the value is NULL unless all ``n`` rows carry a value.
* ``Span(w)``: frame = rows with ``t - w < time <= t``; NULL only when the frame
  holds no value.  ``ties='peers'`` lets all rows of one timestamp see the same
  frame; ``ties='row'`` keeps only rows up to the current one (row order by
  ``tie``), as a row-by-row rolling does.

A NULL, NaN or infinite ``value`` is a missing one (pandas' rolling sees
infinities as missing, too); times are wall-clock and do not depend on the
session's zone; a NULL group key is a group of its own.  The result does not
depend on the sizes, which only choose the plan.

Scale.  A plain window partitioned by metric puts a whole metric in one task,
and a sliding frame is recomputed for every row.  Instead every row has a key on
an axis (its time, or its number within the group), enters at its key and leaves
``w`` later.  The axis is cut into *cells* of a power of two, of which each is
narrowed until at most ``2 * target`` rows enter or leave in it; a hot hour gets
cells of minutes or seconds, the quiet rest keeps wide ones.  A row's frame is

* the rows that entered in its cell up to it,
* those of the rows leaving in its cell that leave later than it, and
* the *core*: rows that entered before the cell and leave behind it, the same
  for all rows of a cell.

The first two are in the cell's task (a copy of each row goes to the cell where
it leaves).  The core is a run of whole (entering cell, leaving cell) groups:

* mean and std: their moments (n, mean, M2) are attached to the O(log) dyadic
  nodes that cover the cells between, and a cell gathers those of its ancestors.
  Everything is merged, nothing subtracted, so values that left leave no error.
* median: rank search over sorted cells.  A frame in the cell differs from the
  core by as many rows as enter or leave there, so its median is among the core's
  values around the middle rank.  Evenly spaced samples of the groups' sorted
  value arrays bound that range from both sides; each group sends the values
  inside it and the numbers below and above.  In the cell, pandas' rolling runs
  over (leaving rows, middle of the core, entering rows), a bounded array,
  however long the frame.  As a cell looks at every group of its core, a target
  that cuts a frame into more than ``FRAME_CELLS`` cells is raised (up to
  ``MEDIAN_TARGET_ROWS``).

Row numbers come without a global sort: rows per time bucket of about a million
rows -> running offsets on that small table -> ``row_number`` inside the bucket.
Mean and std over few rows (``SHORT_FRAME``) are plain sliding frames over chunks
of row numbers with the ``n-1`` previous rows as halo.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hpcstats.functions.intervals import Rows, Span
from hpcstats.functions.text import wall_micros
from hpcstats.plans.joins import join_null_safe, join_small, materialize, observed, stored_columns
from hpcstats.sources.readers import missing_as_null

STATS = ("mean", "median", "std")
SPLIT_FACTOR = "auto"
TARGET_BUCKET_ROWS = 1_000_000   # rows per window partition that the cells aim at
MEDIAN_TARGET_ROWS = 250_000     # the same for cells that a Python worker holds
MIN_BUCKET_ROWS = 1_000
SHORT_FRAME = 256                # mean/std over so many rows: sliding frames, recomputed per row
SAMPLES = 256                    # of each sorted group's values, to bound the middle of a core
FRAME_CELLS = 64                 # cells a frame may cover, as every cell looks at the groups of all
CHUNK_ROWS = 1_000_000
HOUR = 3_600_000_000
MAX_BUCKET_MICROS = 30 * 24 * HOUR
WIDEST = 62                      # a cell of 2 ** 62 holds a whole group


VALUE = "_finite"                # the value that statistics see: NULL unless finite


def _agg(stat: str, value: Column) -> Column:
    if stat == "mean":
        return F.avg(value)
    if stat == "median":
        return F.percentile(value, F.lit(0.5))  # `median` is refused in ordered windows
    if stat == "std":
        return F.stddev_samp(value)
    raise ValueError(f"unknown statistic {stat!r}; choose from {STATS}")


def _micros(col: str = "time") -> Column:
    return wall_micros(col)


def rolling(df: DataFrame, stats=("mean",), interval=None, by=("event",), tie: str | None = None,
            ties: str = "peers", split: bool = True, split_factor=SPLIT_FACTOR,
            chunk_rows: int = CHUNK_ROWS, target_rows: int = TARGET_BUCKET_ROWS, engine: str = "auto") -> DataFrame:
    stats = [stats] if isinstance(stats, str) else list(stats)
    for s in stats:
        _agg(s, F.col("value"))  # validate names early
    by = list(by)
    if ties not in ("peers", "row"):
        raise ValueError("ties must be 'peers' or 'row'")
    if engine not in ("auto", "spark", "pandas"):
        raise ValueError("engine must be 'auto', 'spark' or 'pandas'")
    if not isinstance(interval, (Rows, Span)):
        raise ValueError("interval must be Rows(n) or Span(n, unit)")
    df = missing_as_null(df)
    tie = tie_columns(df, by, tie)
    names = df.columns
    # a sample without a time belongs to no frame: its statistics are NULL
    timeless = df.where(F.col("time").isNull()).select(*names, *[F.lit(None).cast("double").alias(s) for s in stats])
    v = F.col("value").cast("double")
    df = df.where(F.col("time").isNotNull()).withColumn(VALUE, F.when(F.abs(v) < float("inf"), v))
    if isinstance(interval, Rows):
        out = _rolling_rows(df, stats, interval.n, by, tie, chunk_rows, target_rows)
    else:
        w = interval.micros
        out = axis = df.withColumn(KEY, _micros())
        moments = [s for s in stats if s != "median"]
        if moments:
            out = _axis_moments(out, plan_cells(axis, by, w, target_rows, wide=False), moments, w, by, tie, ties).drop(COUNT)
        if "median" in stats:
            cells = plan_cells(axis, by, w, min(target_rows, MEDIAN_TARGET_ROWS), wide=True, frame_cells=FRAME_CELLS)
            out = _axis_median(out, axis, cells, w, by, tie, ties)
    return out.select(*names, *stats).unionByName(timeless)


def tie_columns(df: DataFrame, by, tie) -> list[str]:
    """Order among rows of one timestamp: the given tie key, else every other column.

    A total order keeps results the same when a lost stage is recomputed
    (rows equal in every column are interchangeable)."""
    if isinstance(tie, str):
        return [tie]
    if tie:
        return list(tie)
    return sorted(c for c in df.columns if c not in ("time", VALUE) and c not in by)


# ---- bucket sizing -------------------------------------------------------------

def peak_hourly(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: the largest number of rows in one clock hour and all rows (cheap partial aggregates)."""
    hb = F.floor(_micros() / HOUR)
    hourly = df.groupBy(*by, hb.alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    return hourly.groupBy(*by).agg(F.max("_c").alias("_peak"), F.sum("_c").alias("_rows"))


def bucket_target(spark, total_rows: int, target_rows: int = TARGET_BUCKET_ROWS) -> int:
    """Rows per bucket: at most ``target_rows``; small inputs still give ~4 buckets per core
    (but buckets of at least ``MIN_BUCKET_ROWS`` rows)."""
    slots = max(1, spark.sparkContext.defaultParallelism)
    return int(min(target_rows, max(MIN_BUCKET_ROWS, total_rows // (4 * slots))))


def bucket_widths(df: DataFrame, by: list[str], min_us: int, target_rows: int = TARGET_BUCKET_ROWS,
                  max_us: int = MAX_BUCKET_MICROS) -> DataFrame:
    """Per group a bucket width (micros): about ``bucket_target`` rows at the group's peak
    hourly rate, never less than ``min_us`` and (if larger) never more than ``max_us``.
    A hot group gets narrow buckets, a sparse one wide buckets.  Columns: by, _bw, _rows."""
    peak = materialize(peak_hourly(df, by), "hourly-peaks",
                       {"total": F.sum("_rows"), "max_peak": F.max("_peak"), "min_peak": F.min("_peak")})
    target = bucket_target(df.sparkSession, observed(peak).get("total") or 0, target_rows)
    per_us = F.col("_peak").cast("double") / F.lit(float(HOUR))
    width = F.floor(F.lit(float(target)) / per_us)
    width = F.least(width, F.lit(max(max_us, min_us)))
    width = F.greatest(width, F.lit(min_us))
    if min_us > 0:
        width = F.ceil(width / F.lit(min_us)) * F.lit(min_us)   # whole multiples of the span
    out = peak.select(*by, width.cast("long").alias("_bw"), "_rows")
    obs = dict(observed(peak), target=target)   # one row per group, as `peak`
    if obs.get("min_peak"):
        # the sparsest group has the widest buckets: an upper bound of every width
        widest = float(target) * HOUR / obs["min_peak"]
        obs["max_width"] = max(min_us, min(int(widest) + 1, max(max_us, min_us))) + max(min_us, 1)
    out._hpcstats_observed = obs
    return out


def with_row_index(df: DataFrame, by: list[str], tie: list[str],
                   target_rows: int = TARGET_BUCKET_ROWS, widths: DataFrame | None = None) -> DataFrame:
    """Add ``_idx``: 0-based position of each row in its group in (time, tie) order.

    No global sort: the time axis of each group is cut into buckets of about
    ``target_rows`` rows (from the peak hourly rate), rows per bucket are
    counted, the running offsets are computed on that small table, and
    ``row_number`` runs per bucket.
    """
    widths = widths if widths is not None else bucket_widths(df, by, 1, target_rows)
    keyed = join_small(df, widths, by, cols=[*by, "_bw"]) \
        .withColumn("_hb", F.floor(_micros() / F.col("_bw"))).drop("_bw")
    counts = keyed.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_cnt"))
    ow = Window.partitionBy(*by).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(ow), F.lit(0)))
                          .drop("_cnt"), "row-offsets")
    order = [F.col("time")] + [F.col(c) for c in tie]
    rw = Window.partitionBy(*by, "_hb").orderBy(*order)
    joined = join_small(keyed, offsets, [*by, "_hb"])
    return joined.withColumn("_idx", F.col("_off") + F.row_number().over(rw) - 1).drop("_hb", "_off")


# ---- cells of an axis -----------------------------------------------------------------

KEY, LG = "_key", "_width"          # a row's place on the axis, and its base cell's width as a power of two


@dataclass(frozen=True)
class Cells:
    """How the axis is cut: base cells of width 2 ** ``base`` (or per group, ``widths``: by, LG), narrower ones (by, _base, _sub) in hot base cells."""

    base: int
    widths: DataFrame | None
    splits: DataFrame | None
    finest: int
    target: int

    def on(self, df: DataFrame, by: list[str]) -> DataFrame:
        """``df`` with every row's base width LG."""
        return df.withColumn(LG, F.lit(self.base)) if self.widths is None else join_small(df, self.widths, by)


def _start(key: Column, lg) -> Column:
    """Where the key's cell of width 2 ** lg begins."""
    lg = F.lit(lg) if isinstance(lg, int) else lg
    return F.call_function("shiftleft", F.call_function("shiftright", key, lg), lg)


def plan_cells(df: DataFrame, by: list[str], w: int, target_rows: int, wide: bool, frame_cells: int | None = None) -> Cells:
    """Cut the axis so that at most ``2 * target`` rows enter or leave in a cell (rows with one key cannot be parted).

    Base cells are the largest power of two up to ``w`` wide; with ``wide``, at least ``w``, and more for groups with few
    rows a span.  With ``frame_cells``, the target is raised until a full frame has about so many cells.
    """
    base = (w - 1).bit_length() if wide else w.bit_length() - 1
    ends = F.explode(F.array(F.col(KEY), F.col(KEY) + F.lit(w))).alias("_at")
    counted = F.count(F.lit(1)).alias("_n")
    events = df.select(*by, ends)
    counts = events.groupBy(*by, _start(F.col("_at"), base).alias("_base")).agg(counted)
    if wide:
        peaks = materialize(counts.groupBy(*by).agg(F.sum("_n").alias("_e"), F.max("_n").alias("_n"), (F.max("_base") - F.min("_base")).alias("_x")),
                            "cell-peaks", {"events": F.sum("_e"), "most": F.max("_n")})
        seen = observed(peaks)
    else:
        seen = counts.agg(F.sum("_n").alias("events"), F.max("_n").alias("most")).first().asDict()
    target = bucket_target(df.sparkSession, (seen["events"] or 0) // 2, target_rows)
    if frame_cells:
        # the core's parts are one per cell of the frame: so many narrow cells would cost the square of the frame's rows
        target = max(target, min(MEDIAN_TARGET_ROWS, (seen["most"] or 0) // (2 * frame_cells)))
    bound, cells, unsure = 2 * target, Cells(base, None, None, base, target), False
    if wide:
        # as many base cells in one as fit where the group is fullest; if it is far emptier elsewhere, as many as fit on the whole
        power = lambda x: F.least(F.lit(WIDEST), F.greatest(F.lit(base), F.floor(F.log2(x)).cast("int")))
        sure = power(F.lit(float(1 << base) * target) / F.col("_n"))
        mean = power((F.col("_x") + F.lit(float(1 << base))) * target / F.col("_e"))
        lg = F.when(F.col("_e") <= target, F.lit(WIDEST)).when(mean > sure + 2, mean).otherwise(sure)
        widths = materialize(peaks.select(*by, lg.alias(LG), ((F.col("_e") > target) & (mean > sure + 2)).alias("_unsure")), "cell-widths",
                             {"lowest": F.min(LG), "unsure": F.max(F.col("_unsure").cast("int"))})
        seen_widths = observed(widths)
        widths = widths.drop("_unsure")
        widths._hpcstats_observed = seen_widths
        unsure = bool(seen_widths.get("unsure"))
        cells = replace(cells, widths=widths, finest=seen_widths.get("lowest") or base)
    if (seen["most"] or 0) <= bound and not unsure:
        return cells
    narrower = lambda lg, n: F.greatest(F.lit(0), F.col(lg) - F.ceil(F.log2(F.col(n) / target)).cast("int"))
    based = cells.on(events, by).withColumn("_base", _start(F.col("_at"), F.col(LG)))
    hot = based.groupBy(*by, LG, "_base").agg(counted).where(F.col("_n") > bound)
    splits = materialize(hot.select(*by, "_base", narrower(LG, "_n").alias("_sub")), "cell-splits", {"lowest": F.min("_sub")})
    more = not splits.isEmpty()
    if not more:
        return cells
    while more:
        inside = join_small(based, splits, [*by, "_base"])
        most = (inside.groupBy(*by, "_base", "_sub", _start(F.col("_at"), F.col("_sub"))).agg(counted)
                .groupBy(*by, "_base", "_sub").agg(F.max("_n").alias("_n")))
        new = F.when(F.col("_n") > bound, narrower("_sub", "_n")).otherwise(F.col("_sub"))
        splits = materialize(most.select(*by, "_base", new.alias("_sub"), (new < F.col("_sub")).alias("_more")), "cell-splits",
                             {"lowest": F.min("_sub"), "more": F.max(F.col("_more").cast("int"))})
        more = bool(observed(splits).get("more"))
    return replace(cells, splits=splits, finest=min(cells.finest, observed(splits)["lowest"]))


def row_cells(lg: int) -> Cells:
    """Cells over row numbers: 2 ** lg rows each."""
    return Cells(lg, None, None, lg, 1 << lg)


def _located(df: DataFrame, cells: Cells, by: list[str], w: int) -> DataFrame:
    """Rows with the cell where they enter (_j, width 2 ** _jg) and the start of the one where they leave (_l)."""
    df = cells.on(df, by)
    for name, key in (("_j", F.col(KEY)), ("_l", F.col(KEY) + F.lit(w))):
        lg = f"{name}g"
        df = df.withColumn(name, _start(key, F.col(LG))).withColumn(lg, F.col(LG))
        if cells.splits is not None:
            side = cells.splits.select(*by, F.col("_base").alias(name), F.col("_sub").alias("_narrow"))
            side._hpcstats_observed = observed(cells.splits)
            df = join_small(df, side, [*by, name], "left").withColumn(lg, F.coalesce("_narrow", lg)).drop("_narrow")
            df = df.withColumn(name, _start(key, F.col(lg)))
    return df.drop(LG)


def _end(start: str, lg: str) -> Column:
    return F.col(start) + F.call_function("shiftleft", F.lit(1).cast("long"), F.col(lg))


def _nodes(x: str, y: str, finest: int, top: int) -> Column:
    """The dyadic nodes (lv, no) that cover [x, y), both multiples of 2 ** finest: at most two per level."""
    return F.expr(f"""
      aggregate(sequence({finest}, {top}),
        named_struct('x', shiftright({x}, {finest}), 'y', shiftright({y}, {finest}), 'out', cast(array() as array<struct<lv:int,no:bigint>>)),
        (s, k) -> named_struct('x', shiftright(s.x + 1, 1), 'y', shiftright(s.y, 1), 'out', concat(s.out,
            if(s.x < s.y and s.x % 2 <> 0, array(named_struct('lv', k, 'no', s.x)), cast(array() as array<struct<lv:int,no:bigint>>)),
            if(s.x < s.y and s.y % 2 <> 0, array(named_struct('lv', k, 'no', s.y - 1L)), cast(array() as array<struct<lv:int,no:bigint>>)))),
        s -> s.out)""")


def _cored(groups: DataFrame, cells: DataFrame, by: list[str], w: int, finest: int, group_cols, cell_cols) -> tuple[DataFrame, DataFrame]:
    """(groups by node, cells by node): a group (_j, _jg, _l) covers the cells (_cell, _cg) that share a node with it."""
    top = w.bit_length()
    covered = groups.withColumn("_x", _end("_j", "_jg")).where("_x < _l").select(
        *by, *group_cols, F.explode(_nodes("_x", "_l", finest, top)).alias("_n")).select(*by, *group_cols, "_n.lv", "_n.no")
    above = cells.where(F.col("_cg") <= top).select(*by, *cell_cols, F.explode(F.sequence(F.col("_cg"), F.lit(top))).alias("lv"), "_cell").withColumn(
        "no", F.call_function("shiftright", F.col("_cell"), F.col("lv")))
    return covered, above.select(*by, *cell_cols, "lv", "no")


# ---- moments ----------------------------------------------------------------------------

def _split(v: Column) -> tuple[Column, Column]:
    """A value as a multiple of 2**-20 and the rest: sums of the former are exact for usual magnitudes,
    so the mean does not depend on how a frame is cut into parts."""
    coarse = F.when(F.abs(v) < 2.0 ** 32, F.rint(v * 2.0 ** 20) / 2.0 ** 20).otherwise(v)
    return coarse, v - coarse


def _moments(v: Column, w, std: bool) -> dict[str, Column]:
    """Count, the two sums, and (for std) the sum of squares about the mean, over a window."""
    n = F.count(v).over(w)
    out = {"n": n} | {f"s{i}": F.coalesce(F.sum(x).over(w), F.lit(0.0)) for i, x in enumerate(_split(v))}
    if std:
        out["q"] = F.coalesce(F.var_pop(v).over(w), F.lit(0.0)) * n
    return out


def _merge(a: dict, b: dict) -> dict:
    """Moments of two disjoint sets of values, merged."""
    out = {k: a[k] + b[k] for k in ("n", "s0", "s1")}
    if "q" in a:
        mean = lambda x: (x["s0"] + x["s1"]) / F.greatest(x["n"], F.lit(1)).cast("double")
        d = mean(b) - mean(a)
        out["q"] = a["q"] + b["q"] + d * d * a["n"] * b["n"] / F.greatest(out["n"], F.lit(1)).cast("double")
    return out


NOTHING = "named_struct('n', 0L, 's0', 0D, 's1', 0D, 'q', 0D)"


def _folded(parts: str) -> Column:
    """Moments of the union of disjoint sets: an array of (n, s0, s1, q), merged in a fixed order."""
    return F.expr(f"""
      aggregate(sort_array({parts}), {NOTHING}, (a, b) -> named_struct(
        'n', a.n + b.n, 's0', a.s0 + b.s0, 's1', a.s1 + b.s1,
        'q', a.q + b.q + if(a.n = 0, 0D, pow((b.s0 + b.s1) / b.n - (a.s0 + a.s1) / a.n, 2) * a.n * b.n / (a.n + b.n))))""")


def _core_moments(rows: DataFrame, cells: Cells, by, w: int) -> DataFrame:
    """(by, _cell, _between): moments of the core of every cell that has one."""
    v = F.col(VALUE)
    coarse, fine = _split(v)
    part = F.struct(F.count(v).alias("n"), F.sum(coarse).alias("s0"), F.sum(fine).alias("s1"), (F.var_pop(v) * F.count(v)).alias("q"))
    across = rows.where(v.isNotNull() & (_end("_j", "_jg") < F.col("_l")))
    groups = across.groupBy(*by, "_j", "_jg", "_l").agg(part.alias("_part"))
    if cells.splits is None and cells.finest == w.bit_length() - 1:
        # cells of more than half a span: a row's two cells have one cell between them at most
        return groups.select(*by, _end("_j", "_jg").alias("_cell"), F.col("_part").alias("_between"))
    groups = materialize(groups, "cell-groups")
    own = materialize(rows.select(*by, F.col("_j").alias("_cell"), F.col("_jg").alias("_cg")).distinct(), "own-cells")
    covered, above = _cored(groups, own, by, w, cells.finest, ["_part"], ["_cell"])
    nodes = covered.groupBy(*by, "lv", "no").agg(F.collect_list("_part").alias("_parts")).select(*by, "lv", "no", _folded("_parts").alias("_part"))
    met = join_null_safe(above, nodes, [*by, "lv", "no"])
    return materialize(met.groupBy(*by, "_cell").agg(F.collect_list("_part").alias("_parts")).select(*by, "_cell", _folded("_parts").alias("_between")), "cores")


def _axis_moments(df: DataFrame, cells: Cells, stats, w: int, by, tie, ties) -> DataFrame:
    """``df`` with mean and std over frames of ``w`` on the axis (see the module's text)."""
    names = df.columns
    rows, v, std = _located(df, cells, by, w), F.col(VALUE), "std" in stats
    own = F.col("_kind") == 1
    both = rows.withColumn("_kind", F.explode(F.array(F.lit(1), F.lit(2)))).where(own | v.isNotNull())
    entering = both.select(
        *by, *[F.when(own, F.col(c)).alias(c) for c in names if c not in by and c != VALUE],
        F.when(own, F.col("_j")).otherwise(F.col("_l")).alias("_cell"), F.when(own, F.col(KEY)).otherwise(F.col(KEY) + F.lit(w)).alias("_at"),
        "_kind", VALUE)
    core = _core_moments(rows, cells, by, w).select(*by, "_cell", F.lit(-(1 << 62)).cast("long").alias("_at"), F.lit(0).alias("_kind"), "_between")
    entering = entering.unionByName(core, allowMissingColumns=True)
    part = Window.partitionBy(*by, "_cell")
    up = part.orderBy("_at", "_kind", *(tie if ties == "row" else ()))
    upto = up.rowsBetween(Window.unboundedPreceding, 0) if ties == "row" else part.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    behind = part.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    first = _moments(F.when(F.col("_kind") == 1, v), upto, std)
    last = _moments(F.when(F.col("_kind") == 2, v), behind, std)
    middle = F.first(F.col("_between"), ignorenulls=True).over(upto)
    parts = entering.select(*names, "_kind", *[x.alias(f"_{p}{k}") for p, m in (("a", first), ("c", last)) for k, x in m.items()],
                            middle.alias("_b")).where("_kind = 1")
    a, c = ({k: F.col(f"_{p}{k}") for k in first} for p in "ac")
    b = {k: F.coalesce(F.col(f"_b.{k}"), F.lit(0 if k == "n" else 0.0)) for k in first}
    m = _merge(_merge(a, b), c)
    n, mean, m2 = m["n"], (m["s0"] + m["s1"]) / F.greatest(m["n"], F.lit(1)).cast("double"), m.get("q", F.lit(0.0))
    out = {"mean": F.when(n > 0, mean), "std": F.when(n > 1, F.sqrt(m2 / F.greatest(n - 1, F.lit(1)).cast("double")))}
    return parts.select(*names, *[out[s].alias(s) for s in stats], n.alias(COUNT))


COUNT = "_present"               # values in the frame


def _rolling_rows(df, stats, n, by, tie, chunk_rows, target_rows):
    names = df.columns
    widths = bucket_widths(df, by, 1, target_rows)
    out = axis = with_row_index(df, by, tie, widths=widths)
    target = max(1, min(int(chunk_rows), observed(widths)["target"]))
    moments = [s for s in stats if s != "median"]
    if moments and n <= SHORT_FRAME:
        # every row goes to its chunk; the last n-1 rows of a chunk also to the next one
        chunk = max(8 * n, target)
        bucket = F.floor(F.col("_idx") / chunk)
        targets = F.when((F.col("_idx") % chunk) >= chunk - (n - 1), F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
        both = out.withColumn("_cell", F.explode(targets)).withColumn("_own", F.col("_cell") == bucket)
        w = Window.partitionBy(*by, "_cell").orderBy("_idx").rowsBetween(-(n - 1), 0)
        full = F.count(F.col(VALUE)).over(w) >= n
        out = both.select(*names, "_idx", "_own", *[F.when(full, _agg(s, F.col(VALUE)).over(w)).alias(s) for s in moments]).where("_own").drop("_own")
    elif moments:
        lg = min(n.bit_length() - 1, (2 * target).bit_length() - 1)
        out = _axis_moments(out.withColumn(KEY, F.col("_idx")), row_cells(lg), moments, n, by, [], "peers")
        out = out.select(*names, "_idx", *[F.when(F.col(COUNT) >= n, F.col(s)).alias(s) for s in moments])
    if "median" in stats:
        lg = (2 * min(target, MEDIAN_TARGET_ROWS)).bit_length() - 1
        out = _axis_median(out.withColumn(KEY, F.col("_idx")), axis.withColumn(KEY, F.col("_idx")), row_cells(lg), n, by, [], "peers")
        out = out.withColumn("median", F.when(F.col(COUNT) >= n, F.col("median")))
    return out


# ---- medians ----------------------------------------------------------------------------

def _axis_median(df: DataFrame, axis: DataFrame, cells: Cells, w: int, by, tie, ties) -> DataFrame:
    """``df`` with the median over frames of ``w`` on the axis (see the module's text); ``axis``: its rows as they came, for the core."""
    names = df.columns
    rows, own = _located(df, cells, by, w), F.col("_kind") == 1
    both = rows.withColumn("_kind", F.explode(F.array(F.lit(1), F.lit(2)))).where(own | (F.col(VALUE).isNotNull() & (F.col("_j") != F.col("_l"))))
    both = both.select(
        *by, *[F.when(own, F.col(c)).alias(c) for c in names if c not in by and c not in (VALUE, KEY)], VALUE, KEY, "_kind",
        F.when(own, F.col("_j")).otherwise(F.col("_l")).alias("_cell"))
    if ties == "row":
        both = both.withColumn("_place", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(KEY, *tie)))
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("median", T.DoubleType()), T.StructField(COUNT, T.LongType())])
    solve = _solver(names, w, ties)
    if cells.finest >= (w - 1).bit_length():  # no cell is narrower than a span, so no row enters before one and leaves behind it
        return both.groupBy(*by, "_cell").applyInArrow(lambda t: solve(t, None), schema)
    ids = materialize(axis.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()), "group-ids")
    core = _core_middles(join_small(_located(axis, cells, by, w), ids, by), w, cells.finest)
    return join_small(both, ids, by).groupBy("_g", "_cell").cogroup(core.groupBy("_g", "_cell")).applyInArrow(solve, schema)


def _solver(names: list[str], w: int, ties: str):
    """Medians of one cell's rows: an Arrow table of entering (kind 1) and leaving rows, and the core's parts or None."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa
    from pandas.api.indexers import BaseIndexer

    class Given(BaseIndexer):
        """Windows [start, end) that were worked out before."""

        def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
            return self.start, self.end

    def rolled(values, start, end):
        """Median of values[start:end], both rising; pandas wants as many values as windows."""
        extra = len(values) - len(start)
        if extra > 0:
            start, end = (np.concatenate([np.zeros(extra, dtype=np.int64), x]) for x in (start, end))
        else:
            values = np.concatenate([values, np.full(-extra, np.nan)])
        indexer = Given(start=start.astype(np.int64), end=end.astype(np.int64))
        return pd.Series(values).rolling(indexer, min_periods=1).median().to_numpy()[max(extra, 0):]

    def solve(table: pa.Table, core) -> pa.Table:
        kind, key = table.column("_kind").to_numpy(), table.column(KEY).to_numpy()
        order = np.argsort(table.column("_place").to_numpy() if ties == "row" else key, kind="stable")
        own_at, gone_at = order[kind[order] == 1], order[kind[order] == 2]
        own, gone = table.take(pa.array(own_at)), table.take(pa.array(gone_at))
        value = own.column(VALUE).to_numpy(zero_copy_only=False).astype("float64")
        at, leave = key[own_at], key[gone_at] + w
        there = ~np.isnan(value)
        middle, present = np.zeros(0), 0
        if core is not None and len(core):
            middle = np.concatenate([np.asarray(x, dtype="float64") for x in core.column("slice").to_pylist()])
            below, above = (int(np.sum(core.column(c).to_numpy())) for c in ("below", "above"))
            present = len(middle) + below + above
            # as many of the lowest as of the highest values may go: the median stays; the rest stand in as extremes
            most = np.finfo("float64").max
            middle = np.concatenate([middle, np.full(abs(below - above), -most if below > above else most)])
        before = len(leave) + len(middle)
        counted = np.concatenate([[0], np.cumsum(there)])
        upto = np.searchsorted(at, at, side="right") if ties == "peers" else np.arange(1, len(at) + 1)
        left, own_left = np.searchsorted(leave, at, side="right"), counted[np.searchsorted(at, at - w, side="right")]
        start = np.where(own_left > 0, before + own_left, left)   # a row that entered here leaves after all that entered before
        values = np.concatenate([gone.column(VALUE).to_numpy(zero_copy_only=False).astype("float64"), middle, value[there]])
        res = rolled(values, start, before + counted[upto])
        n = len(leave) - left + present + counted[upto] - own_left
        return own.select(names).append_column("median", pa.array(np.where(n > 0, res, np.nan), pa.float64(), from_pandas=True)).append_column(
            COUNT, pa.array(n, pa.int64()))

    return solve


def _core_middles(rows: DataFrame, w: int, finest: int) -> DataFrame:
    """(_g, _cell, slice, below, above), a row per group in the cell's core: its sorted values around the core's middle and how many lie beside them.

    The slices of a cell together hold every value that is the median of any of the cell's frames.
    """
    import numpy as np
    import pandas as pd

    rows = rows.select("_g", "_j", "_jg", "_l", VALUE, KEY)
    across = rows.where(F.col(VALUE).isNotNull() & (_end("_j", "_jg") < F.col("_l")))
    groups = stored_columns(across.groupBy("_g", "_j", "_jg", "_l").agg(F.sort_array(F.collect_list(VALUE)).alias("vals")), "sorted-groups")
    # how many rows enter or leave in a cell: so far a frame's middle rank can be from the core's
    moved = rows.select("_g", F.explode(F.array(F.struct(F.col("_j").alias("_cell"), F.col("_jg").alias("_cg")),
                                                F.struct(F.col("_l").alias("_cell"), F.lit(None).cast("int").alias("_cg")))).alias("c"))
    own = materialize(moved.groupBy("_g", "c._cell").agg(F.max("c._cg").alias("_cg"), F.count(F.lit(1)).alias("moved")).where("_cg is not null"), "own-cells")
    covered, above = _cored(groups.select("_g", "_j", "_jg", "_l"), own, ["_g"], w, finest, ["_j", "_l"], ["_cell", "moved"])
    met = materialize(covered.join(above, ["_g", "lv", "no"]).select("_g", "_j", "_l", "_cell", "moved"), "cores")
    n = F.size("vals").cast("long")
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES)), lambda k: F.floor(k * (n - 1) / SAMPLES).cast("int"))
    sampled = groups.select("_g", "_j", "_l", n.alias("n"), F.transform(places, lambda p: F.get("vals", p)).alias("sample"))

    def bounds(frame: pd.DataFrame) -> pd.DataFrame:
        """Values between which the median of every frame of the cell must lie, by the samples of its groups."""
        total, room = int(frame["n"].sum()), int(frame["moved"].iloc[0]) + 2
        candidates = np.unique(np.concatenate(frame["sample"].tolist()))
        most_below, least_upto = np.zeros(len(candidates), dtype=np.int64), np.zeros(len(candidates), dtype=np.int64)
        for size, sample in zip(frame["n"], frame["sample"]):
            place = np.arange(SAMPLES + 1) * (size - 1) // SAMPLES
            first = np.searchsorted(sample, candidates, side="left")    # values below a candidate: at most those up to the next sample
            most_below += np.where(first <= SAMPLES, place[np.minimum(first, SAMPLES)], size)
            last = np.searchsorted(sample, candidates, side="right")    # values up to it: at least those up to the sample before
            least_upto += np.where(last > 0, place[np.maximum(last - 1, 0)] + 1, 0)
        low, high = np.flatnonzero(most_below <= total // 2 - room), np.flatnonzero(least_upto >= total // 2 + room + 1)
        return pd.DataFrame({"_g": frame["_g"].iloc[:1], "_cell": frame["_cell"].iloc[:1],
                             "lo": [candidates[low[-1]] if len(low) else -np.inf], "hi": [candidates[high[0]] if len(high) else np.inf]})

    limits = met.join(sampled, ["_g", "_j", "_l"]).select("_g", "_cell", "moved", "n", "sample").groupBy("_g", "_cell").applyInPandas(
        bounds, "_g long, _cell long, lo double, hi double")
    asked = met.join(limits, ["_g", "_cell"]).groupBy("_g", "_j", "_l").agg(F.collect_list(F.struct("_cell", "lo", "hi")).alias("asked"))

    def slices(frames):
        for frame in frames:
            for g, vals, asked in frame.itertuples(index=False, name=None):
                out = []
                for r in asked:
                    a, b = np.searchsorted(vals, r["lo"], side="left"), np.searchsorted(vals, r["hi"], side="right")
                    out.append((g, r["_cell"], vals[a:b], a, len(vals) - b))
                yield pd.DataFrame(out, columns=["_g", "_cell", "slice", "below", "above"])

    return groups.join(asked, ["_g", "_j", "_l"]).select("_g", "vals", "asked").mapInPandas(
        slices, "_g long, _cell long, slice array<double>, below long, above long")
