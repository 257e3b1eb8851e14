"""Choosing among candidates: budgets, policies, fallbacks and merged summaries. Candidates are few and aggregated before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_budgets(specs: DataFrame, budgets: list[int], name: str = "name") -> DataFrame:
    """Every candidate once for each budget top_k, its name followed by _top and the budget."""
    each = specs.withColumn("top_k", F.explode(F.array(*map(F.lit, budgets))))
    return each.withColumn(name, F.concat(F.col(name), F.lit("_top"), F.col("top_k").cast("string")))


def first_by(candidates: DataFrame, *order: Column) -> DataFrame:
    """The candidate that comes first; an order should end with a key that tells all apart."""
    return candidates.orderBy(*order).limit(1)


def valid_or_all(candidates: DataFrame, valid: Column) -> DataFrame:
    """The valid candidates, or all of them where none is valid."""
    return candidates.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_any", F.max("_valid").over(Window.partitionBy(F.lit(0)))).where(F.col("_valid") | ~F.col("_any")).drop("_valid", "_any")


def compact(candidates: DataFrame, family: str, metrics: list[str], within: float, order: list[Column]) -> DataFrame:
    """Of each family the first in order of those that lie within a distance of the family's best row in all metrics.

    The best row has the largest first metric, then the largest second one.
    """
    best = candidates.groupBy(F.col(family).alias("_family")).agg(F.max(F.struct(*[F.col(m) for m in metrics])).alias("_best"))
    near = candidates.join(best, F.col(family) == F.col("_family"))
    for m in metrics:
        near = near.where(F.col(m) >= F.col(f"_best.{m}") - within)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(*order))).where("_r = 1").drop("_r", "_family", "_best")


def merged(summaries: list[DataFrame], keys: list[str], metrics: list[str], name: str = "name", source: str = "source") -> DataFrame:
    """(keys, the means of the metrics' means, the first name, all sources) of summaries of the same candidates."""
    whole = summaries[0]
    for s in summaries[1:]:
        whole = whole.unionByName(s)
    sources = F.array_join(F.array_sort(F.collect_set(source)), "|").alias(f"{source}s")
    return whole.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.min(name).alias(name), sources)


def change(candidates: DataFrame, order: str, value: str, out: str = "change") -> DataFrame:
    """The difference to the candidate before; null in the first."""
    return candidates.withColumn(out, F.col(value) - F.lag(value).over(Window.orderBy(order)))
