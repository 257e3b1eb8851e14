"""Whole rows exchanged once into runs of ascending or descending doc_id, with a copy of each run's neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import part_of, partitions, splitters


def by_doc_id(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs with column `_part`, in that partition of which doc_id ascends from part to part; null doc_ids come first.

    The cuts are quantiles of doc_id, so that parts have about as many rows whatever the ids; rows that share a doc_id
    share a part. Only the narrow id column is read to find them, and the rows move once.
    """
    parts = parts or partitions(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    cuts = splitters(docs, key, parts)
    return docs.withColumn("_part", part_of(key, cuts).cast("int")).repartitionById(len(cuts) + 1, F.col("_part"))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """by_doc_id, where each part also has a copy of the rows that come after its last one in descending order.

    Column `_halo` is true for the copies: the rows with the largest doc_id of the next lower part that has rows, and
    in the lowest part those with the largest doc_id of all. A copy is made of one doc_id a part.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long")
    cuts = splitters(docs, key, parts or partitions(spark))
    placed = docs.withColumn("_part", part_of(key, cuts).cast("int"))
    tops = sorted(placed.select("_part", key.alias("_key")).groupBy("_part").agg(F.max("_key").alias("top")).collect())  # one row a part
    goal = [(r["top"], after["_part"]) for r, after in zip(tops, tops[1:] + tops[:1], strict=True)]
    copies = spark.createDataFrame(goal, "_top long, _also int")
    found = placed.join(F.broadcast(copies), key.eqNullSafe(F.col("_top")), "left")
    both = F.when(F.col("_also") != F.col("_part"), F.array("_part", "_also")).otherwise(F.array("_part"))
    spread = found.withColumn("_to", F.explode(both)).withColumn("_halo", F.col("_to") != F.col("_part"))
    return spread.drop("_part", "_top", "_also").withColumnRenamed("_to", "_part").repartitionById(len(cuts) + 1, F.col("_part"))
