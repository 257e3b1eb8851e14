"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.llm.common import cut

#: Links of a partition, about: few links are not dealt over many.
LINKS = 100_000


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b").alias("v"), F.col("a").alias("u")))


def _star(sides: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours of v on the smallest of v and its neighbours: the larger ones (large), or the smaller ones and v itself."""
    least = sides.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    # The minimum is an aggregate with map-side combining; the join after it may be split where v is a hub.
    joined = sides.join(least, "v")
    if large:
        out = joined.where(F.col("u") > F.col("v")).select(F.col("m").alias("a"), F.col("u").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("u").alias("b")).union(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs (or of structs, by their order), in any order and repeated at will, to (node, root): root is the smallest node that node reaches.

    Nodes that no link names are left out, as are links from a node to itself or to null. Each round writes its links
    to the shared folder; the number of rounds grows with the logarithm of the number of nodes.
    """
    links = cut(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before, parts = state, -(-state["n"] // LINKS)  # a round makes no more links than it has
        larger = cut(_star(_both_ways(links), large=True).coalesce(parts))
        links = cut(_star(larger.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")), large=False).coalesce(parts))
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return roots.union(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
