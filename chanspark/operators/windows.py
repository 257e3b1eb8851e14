"""Hopping windows over counts of rows, and what describes each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chanspark.functions.naming import DESCRIPTORS


def window_counts(df: DataFrame, keys: list[str], size: int, step: int) -> DataFrame:
    """(keys, rows, windows): how many whole windows a stream has."""
    n = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return n.withColumn("windows", F.when(F.col("rows") >= size, F.floor((F.col("rows") - size) / step) + 1).otherwise(0).cast("long"))


def hop(df: DataFrame, keys: list[str], order: list[str], size: int, step: int) -> DataFrame:
    """Each row once for every window it is in: pos, window_index, start_packet, end_packet_exclusive.

    Windows start at 0, step, 2 step, ... and are whole; what no whole window covers is left out. A row's windows follow
    from its place, so there is no range join: rows grow by size / step.
    """
    w = Window.partitionBy(*keys)
    placed = df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    low = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("pos") / step), F.floor((F.col("_n") - size) / step))
    own = placed.where(F.col("_n") >= size).withColumn("_low", low).withColumn("_high", high).where(F.col("_low") <= F.col("_high"))
    out = own.withColumn("window_index", F.explode(F.sequence("_low", "_high"))).drop("_n", "_low", "_high")
    start = F.col("window_index") * step
    return out.withColumn("start_packet", start).withColumn("end_packet_exclusive", start + size)


def describe(windowed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, window_index, the eleven descriptors) of hop()'s rows. Differences start anew in each window.

    A window of one row has no differences and no slope: they are 0. What a window of more rows lacks values for is null.
    """
    own = Window.partitionBy(*keys, "window_index").orderBy("pos")
    x, d = F.col(value).cast("double"), F.col("_d")
    known = lambda c: F.coalesce(c, F.when(F.count("*") == 1, 0.0))
    step = windowed.withColumn("_d", x - F.lag(x).over(own))
    return step.groupBy(*keys, "window_index").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("peak_to_peak"),
        F.sum(x * x).alias("energy"), known(F.avg(F.abs(d))).alias("mean_abs_diff"), known(F.max(F.abs(d))).alias("max_abs_diff"),
        known(F.sum(d * d)).alias("diff_energy"), known(F.stddev_pop(d)).alias("std_diff"), known(F.regr_slope(x, F.col("pos").cast("double"))).alias("slope"),
    )


def feature_vectors(described: DataFrame, keys: list[str], channel: str | None = None) -> DataFrame:
    """(keys, window_index, features, sample_id): descriptors as one vector, by channel and then in their order."""
    own = F.array(*DESCRIPTORS)
    if channel is None:
        wide = described.select(*keys, "window_index", own.alias("features"))
    else:
        others = [k for k in keys if k != channel]
        listed = described.groupBy(*others, "window_index").agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), own.alias("f")))).alias("all"))
        wide, keys = listed.select(*others, "window_index", F.flatten(F.transform("all", lambda r: r["f"])).alias("features")), others
    # A number that follows from the keys alone, so that no order of all windows is needed; it tells apart, it doesn't count.
    return wide.withColumn("sample_id", F.xxhash64(*keys, "window_index"))


def label_summary(windowed: DataFrame, keys: list[str], label: str) -> DataFrame:
    """(keys, window_index, dominant, purity, labels): the most frequent label (the first in order of equals), its share, all labels."""
    counts = windowed.groupBy(*keys, "window_index", label).agg(F.count("*").alias("n"))
    best = F.struct(F.col("n"), F.col(label))
    listed = counts.groupBy(*keys, "window_index").agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.array_sort(F.collect_list(best)).alias("each"))
    dominant = F.array_min(F.transform(F.filter("each", lambda e: e["n"] == F.col("top")), lambda e: e[label]))
    return listed.select(*keys, "window_index", dominant.alias("dominant"), (F.col("top") / F.col("all")).alias("purity"), F.array_join(F.array_sort(F.transform("each", lambda e: e[label])), "|").alias("labels"))
