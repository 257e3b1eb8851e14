"""Splits by groups: stratified holdouts, leave-one-group-out, quotas. All are exact and repeat with the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def stratified(groups: DataFrame, strata: list[str], group: str, share: float, order: Column | None = None, seed: int = 0) -> DataFrame:
    """groups (one row a group, such as a file) with column part, test or train.

    Of each stratum's n groups the first max(1, n share rounded half to even) in order (by default of a seeded hash) are
    the test part, n - 1 at most: a stratum with one group is all train.
    """
    own = Window.partitionBy(*strata)
    rank = F.row_number().over(own.orderBy(order if order is not None else seeded(seed, group), group))
    n = F.count(F.lit(1)).over(own)
    size = F.least(F.greatest(F.lit(1), F.bround(n * share).cast("int")), n - 1)
    return groups.withColumn("part", F.when(rank <= size, "test").otherwise("train"))


def leave_one_out(rows: DataFrame, field: str) -> DataFrame:
    """(held_out, train, test): rows of each split in which one value of field is held out; null is a value."""
    n = rows.groupBy(field).agg(F.count("*").alias("test"))
    return n.select(F.col(field).alias("held_out"), (rows.agg(F.count("*")).scalar() - F.col("test")).alias("train"), "test")


def hold_out(rows: DataFrame, field: str, value) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the rows of one value of field held out; filters only."""
    same = F.col(field).eqNullSafe(F.lit(value))
    return rows.where(~same), rows.where(same)


def mixed_groups(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, labels): groups whose rows don't all have one label, which must not be split."""
    return rows.groupBy(group).agg(F.count_distinct(label).alias("labels")).where("labels > 1")


def quota(rows: DataFrame, group: str, most: int, order: Column) -> DataFrame:
    """At most about `most` rows, of each group its share (at least one), the first in order: a sampling operator."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    every = rows.agg(F.count("*")).scalar()
    shares = sizes.withColumn("_q", F.greatest(F.lit(1), F.bround(F.lit(most) * F.col("_n") / every).cast("int"))).select(F.col(group).alias("_g"), "_q")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.join(shares, F.col(group).eqNullSafe(F.col("_g"))).where(F.col("_r") <= F.col("_q")).drop("_g", "_q", "_r")
