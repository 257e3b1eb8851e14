"""Windows of many sizes and steps from one scan: streams are cut into panes, and panes are put together to windows.

A pane is a run of so many rows as divide all sizes and steps. What it keeps can be merged: means and variances, extrema,
sums over differences, its first and last value, the difference to the pane before. Rows are copied into no window; what
is multiplied by size / step is panes.

A stream may hold most of the rows: places in it are counted within runs of its order and then added up, and panes are
exchanged by themselves, so that no task gets a whole stream.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Runs into which all rows are cut by the first order column, for counting.
RUNS = 256


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "pos", runs: int = RUNS) -> DataFrame:
    """df with the place of each row in its stream, from 0; the first column of order is a number or a time.

    Runs are cut at quantiles of that column: a stream's rows of one run are numbered in one task, and the counts of the
    runs before, a row for each stream and run that it has, are added.
    """
    lead = F.col(order[0])
    kind = df.schema[order[0]].dataType.simpleString()
    number = F.unix_micros(lead.cast("timestamp")) if kind.startswith("timestamp") else lead
    cuts = df.select(F.percentile_approx(number, [i / runs for i in range(1, runs)], 20 * runs)).first()[0] or []
    steps = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    placed = df.withColumn("_run", F.size(F.filter(steps, lambda c: c < number)) if cuts else F.lit(0))
    own = Window.partitionBy(*keys, "_run").orderBy(*order)
    counts = placed.groupBy(*keys, "_run").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = placed.withColumn("_within", F.row_number().over(own) - 1)
    same = F.col("_run").eqNullSafe(F.col("_r"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return within.join(before, same).withColumn(out, F.col("_before") + F.col("_within")).drop("_run", "_r", "_before", "_within", *[f"_k{i}" for i in range(len(keys))])


def pane_of(candidates: list[tuple[int, int]]) -> int:
    """The rows of a pane that serves all (size, step)."""
    return gcd(*[n for pair in candidates for n in pair])


def panes(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    """(keys, pane, n, mean, var, low, high, energy, ...) of runs of `rows` rows; rows without a value are left out before they are counted.

    The last pane of a stream may have fewer. edge is the difference of a pane's first value to the last one before it.
    """
    placed = numbered(df.where(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("_x")), keys, order)
    pane, last = F.floor(F.col("pos") / rows), F.col("pos") % rows == rows - 1
    both = placed.select(*keys, "pos", "_x", F.explode(F.when(last, F.array(F.struct(pane.alias("pane"), F.lit(True).alias("own")), F.struct((pane + 1).alias("pane"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(pane.alias("pane"), F.lit(True).alias("own"))))).alias("_to"))
    step = both.select(*keys, "pos", "_x", "_to.*").withColumn("_d", F.col("_x") - F.lag("_x").over(Window.partitionBy(*keys, "pane").orderBy("pos")))
    first = F.col("pos") == F.col("pane") * rows
    x, d = F.when(F.col("own"), F.col("_x")), F.when(F.col("own") & ~first, F.col("_d"))
    centred = (F.col("pos") - F.col("pane") * rows).cast("double") - (rows - 1) / 2
    return step.groupBy(*keys, "pane").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.min(x).alias("low"), F.max(x).alias("high"), F.sum(x * x).alias("energy"),
        F.coalesce(F.sum(F.abs(d)), F.lit(0.0)).alias("ways"), F.max(F.abs(d)).alias("way"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("steps"), F.sum(centred * x).alias("lean"),
        F.min_by(x, F.when(F.col("own"), F.col("pos"))).alias("first"), F.max_by(x, F.when(F.col("own"), F.col("pos"))).alias("last"), F.max(F.when(F.col("own") & first, F.col("_d"))).alias("edge"),
    ).where("n > 0")


def combine(cut: DataFrame, keys: list[str], rows: int, candidates: list[tuple[int, int]]) -> DataFrame:
    """(keys, size, step, window_index, the eleven descriptors) of all whole windows of each (size, step) from panes().

    The same as describing each window's rows. A window has at least two rows.
    """
    full = cut.where(F.col("n") == rows)
    each = [F.struct(F.lit(size).alias("size"), F.lit(step).alias("step")) for size, step in dict.fromkeys(candidates)]
    first_row = F.col("pane") * rows
    low = F.greatest(F.ceil((first_row + rows - F.col("size")) / F.col("step")), F.lit(0))
    high = F.floor(first_row / F.col("step"))
    spread = full.withColumn("_c", F.explode(F.array(*each))).select("*", "_c.*").withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    met = spread.withColumn("window_index", F.explode(F.sequence("_low", "_high"))).withColumn("_from", F.col("window_index") * F.col("step") == first_row)
    edge = F.when(~F.col("_from"), F.col("edge"))
    centre = (first_row - F.col("window_index") * F.col("step")).cast("double")
    merged = met.groupBy(*keys, "size", "step", "window_index").agg(
        F.count("*").alias("_panes"), F.avg("mean").alias("mean"), (F.avg("var") + F.var_pop("mean")).alias("_var"), F.min("low").alias("min"), F.max("high").alias("max"), F.sum("energy").alias("energy"),
        (F.sum("ways") + F.coalesce(F.sum(F.abs(edge)), F.lit(0.0))).alias("_ways"), F.greatest(F.max("way"), F.max(F.abs(edge))).alias("_way"), (F.sum("steps") + F.coalesce(F.sum(edge * edge), F.lit(0.0))).alias("_steps"),
        F.sum("lean").alias("_lean"), F.covar_pop(centre, "mean").alias("_cov"), F.min_by("first", "pane").alias("_first"), F.max_by("last", "pane").alias("_last"),
    ).where(F.col("_panes") * rows == F.col("size"))
    size = F.col("size")
    way = (F.col("_last") - F.col("_first")) / (size - 1)
    return merged.select(
        *keys, "size", "step", "window_index", "mean", F.sqrt("_var").alias("std"), "min", "max", (F.col("max") - F.col("min")).alias("peak_to_peak"), "energy",
        (F.col("_ways") / (size - 1)).alias("mean_abs_diff"), F.coalesce("_way", F.lit(0.0)).alias("max_abs_diff"), F.col("_steps").alias("diff_energy"),
        F.sqrt(F.greatest(F.col("_steps") / (size - 1) - way * way, F.lit(0.0))).alias("std_diff"), ((F.col("_lean") + size * F.col("_cov")) * 12 / (size.cast("double") * (size.cast("double") * size - 1))).alias("slope"),
    )


def describe_all(df: DataFrame, keys: list[str], order: list[str], value: str, candidates: list[tuple[int, int]]) -> DataFrame:
    """combine() of panes() as large as the candidates allow."""
    if any(size < 2 or step < 1 for size, step in candidates):
        raise ValueError("windows have two rows at least, and steps one")
    rows = pane_of(candidates)
    return combine(panes(df, keys, order, value, rows), keys, rows, candidates)
