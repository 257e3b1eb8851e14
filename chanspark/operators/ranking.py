"""Fisher ranking of channels and features, and top-k selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12


def channels_long(df: DataFrame, array: str, *keep: str) -> DataFrame:
    """One row a channel: (keep..., channel, x); null arrays give none."""
    return df.select(*keep, F.posexplode(array).alias("channel", "x")).withColumn("x", F.col("x").cast("double"))


def fisher_scores(long: DataFrame, label: str, feature: str, value: str, eps: float = EPS) -> DataFrame:
    """(feature, score): spread of the class means around the mean, over spread within classes, both weighted by class size.

    Two aggregates: by feature and class (partial sums before the shuffle), then by feature. Rows of null value are left out.
    """
    by_class = long.where(F.col(value).isNotNull()).groupBy(feature, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    by_class = by_class.withColumn("n", F.col("n").cast("double"))
    total = Window.partitionBy(feature)
    spread = by_class.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(total) / F.sum("n").over(total))
    return spread.groupBy(feature).agg(
        (F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) / (F.sum(F.col("n") * F.col("v")) + F.lit(eps))).alias("score")
    )


def top_k(scores: DataFrame, k: int, by: Column | None = None, tie: str = "channel") -> DataFrame:
    """The k best rows with their 1-based rank; ties go to the smaller tie column."""
    by = F.col("score") if by is None else by
    best = scores.orderBy(by.desc(), F.col(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(by.desc(), F.col(tie))))
