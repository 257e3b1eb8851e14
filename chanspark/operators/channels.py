"""Statistics of channels, z-scores, correlation and the pruning of redundant channels.

Work is on long rows (channel, x); the number of channels is that of the vectors, some hundred, and never grows with the
number of packets. What is broadcast or collected has one row a channel, or one a pair of channels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_STD = 1e-6


def stats(long: DataFrame, *keys: str, min_std: float = MIN_STD) -> DataFrame:
    """(keys, channel, n, mean, variance, std, min, max, informative); population moments."""
    return long.groupBy(*keys, "channel").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    ).withColumn("informative", F.col("std") > min_std)


def stage_summary(of_stage: DataFrame, stage: str = "stage") -> DataFrame:
    """(stage, channels, zero_std, informative, min_std, median_std, max_std) of stats() by stage."""
    return of_stage.groupBy(stage).agg(
        F.count("*").alias("channels"), F.count_if(F.col("std") == 0).alias("zero_std"), F.count_if("informative").alias("informative"),
        F.min("std").alias("min_std"), F.percentile("std", F.lit(0.5)).alias("median_std"), F.max("std").alias("max_std"),
    )


def above(values: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n): how many values lie above each threshold, in one pass."""
    counted = values.agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(value) > t).alias("n")) for t in thresholds]).alias("each"))
    return counted.select(F.inline("each"))


def fit_zscore(long: DataFrame, min_std: float = MIN_STD) -> DataFrame:
    """The scaler: (channel, mean, std, informative)."""
    return stats(long, min_std=min_std).select("channel", "mean", "std", "informative")


def apply_zscore(long: DataFrame, scaler: DataFrame, eps: float = 0.0) -> DataFrame:
    """long with column z. With eps every channel stays; without, those that aren't informative go."""
    own = scaler if eps else scaler.where("informative")
    return long.join(F.broadcast(own.select("channel", "mean", "std")), "channel").withColumn("z", (F.col("x") - F.col("mean")) / (F.col("std") + eps)).drop("mean", "std")


def correlations(wide: DataFrame, array: str, channels: int) -> DataFrame:
    """(a, b, r): the absolute Pearson correlation of every two channels, a < b; undefined ones are 0.

    One pass: each task adds up the products of its vectors as matrices, in batches, and gives one row a pair of
    channels, so what is exchanged grows with the tasks and not with the packets. Vectors of another length or with a
    value that isn't finite are left out.
    """
    names = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(channels), np.zeros((channels, channels))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, channels)
            x = x[np.isfinite(x).all(axis=1)]
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        a, b = np.triu_indices(channels, 1)
        square = np.diag(products)
        columns = [a, b, np.full(len(a), n), sums[a], sums[b], square[a], square[b], products[a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    own = wide.where((F.size(array) == channels) & F.forall(array, lambda v: v.isNotNull())).select(F.col(array).cast("array<double>"))
    total = own.mapInArrow(run, "a long, b long, n long, sa double, sb double, saa double, sbb double, sab double").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names[2:]])
    spread = (F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n"))
    r = F.abs(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(spread)
    return total.where("n > 0").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.when(spread > 0, r).otherwise(0.0).alias("r"))


def prune(pairs: DataFrame, candidates: list[int], threshold: float) -> list[int]:
    """Channels to keep, ascending: each whose correlation with every kept one is below the threshold. One row a pair is collected."""
    if threshold >= 1 or len(candidates) < 2:
        return sorted(candidates)
    near = {(r["a"], r["b"]) for r in pairs.where(F.col("r") >= threshold).select("a", "b").collect()}
    kept: list[int] = []
    for c in sorted(candidates):
        if not any((k, c) in near for k in kept):
            kept.append(c)
    return kept


def occurrence(ranking: DataFrame, top: int) -> DataFrame:
    """(channel, n, mean_score, max_score, features): channels among the `top` best features of (feature_index, channel, name, score, rank)."""
    return ranking.where(F.col("rank") <= top).groupBy("channel").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("features")
    )


def modal_length(df: DataFrame, keys: list[str], length: str, order: list[str]) -> DataFrame:
    """(keys, modal, n): the most frequent length, of equally frequent ones that which comes first."""
    each = df.groupBy(*keys, length).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return each.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, F.col(length).alias("modal"), "n")


def admission(files: DataFrame, labels: list[str], least: int, expected: int) -> DataFrame:
    """files (label, session, quadrant, packets, modal) with rejection_reason (the first that holds, or null) and accepted."""
    reason = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(labels), "label")
        .when(F.col("session").isNull() | F.col("quadrant").isNull(), "path")
        .when(F.coalesce("packets", F.lit(0)) == 0, "empty")
        .when(F.col("modal").isNull(), "vectors")
        .when(F.col("modal") != expected, "length")
        .when(F.col("packets") < least, "packets")
    )
    return files.withColumn("rejection_reason", reason).withColumn("accepted", F.col("rejection_reason").isNull())
