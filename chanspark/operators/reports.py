"""Tables as text, and lookups between summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands in a table's cell for a missing value.
MISSING = ""


def cell(value: Column, kind: str, decimals: int) -> Column:
    """A value as text: fractions with so many decimals, bars escaped, line ends as spaces, nothing for null and NaN."""
    if kind in ("double", "float"):
        number = F.round(value.cast("double"), decimals)
        text = F.when(~F.isnan(value), F.format_string(f"%.{decimals}f", number))
    else:
        text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\|", r"\\|"), r"[\r\n]+", " ")
    return F.coalesce(text, F.lit(MISSING))


def markdown(table: DataFrame, order: list[Column], decimals: int = 4, most: int | None = None) -> DataFrame:
    """(line, text): a table in Markdown, whose head is lines 0 and 1; rows follow in order, of which `most` are shown.

    A report's table: its rows are numbered in one task, so it should be a summary.
    """
    from pyspark.sql import Window

    spark = table.sparkSession
    shown = table if most is None else table.orderBy(*order).limit(most)
    cells = [cell(F.col(f"`{f.name}`"), f.dataType.simpleString(), decimals) for f in table.schema.fields]
    bar = lambda parts: F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))
    rows = shown.select((F.row_number().over(Window.orderBy(*order)) + 1).cast("int").alias("line"), bar(cells).alias("text"))
    head = spark.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "| " + " | ".join(["---"] * len(table.columns)) + " |")], "line int, text string")
    return head.union(rows)


def lookup(summary: DataFrame, classes: DataFrame, keys: list[str], wanted: object, metric: str, out: str) -> DataFrame:
    """summary with a metric of one class, from a table by keys and class; null where the class has no row."""
    own = classes.where(F.col("class") == F.lit(wanted)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(metric).alias(out))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return summary.join(own, same, "left").drop(*[f"_{k}" for k in keys])
