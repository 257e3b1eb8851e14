"""Queries of joins, sets and selection over the business tables: what file tables and results tables go through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.operators import metrics
from chanspark.plans.catalogue import register, table


@register("SELECT n_name, c_mktsegment, count(*) AS files FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("files"))  # before the join
    return counts.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment", "files")


@register("SELECT o_orderstatus, count(*) AS files, CAST(sum(n) AS BIGINT) AS packets, count(*) FILTER (n >= 4) AS long_files FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1")
def packet_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").join(packets, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("files"), F.sum("n").alias("packets"), F.count_if(F.col("n") >= 4).alias("long_files"))


@register("SELECT o_orderkey, coalesce(n, 0) AS packets, coalesce(rate, 0.0) AS rate FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, round(avg(l_discount), 6) AS rate FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def left_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("rate"))
    joined = table(spark, sf_dir, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("packets"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("SELECT n_nationkey AS key, n_name AS name, NULL::INTEGER AS parent FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return nations.unionByName(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("parent")), allowMissingColumns=True)


@register("SELECT n_nationkey AS key FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select("c_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key")).exceptAll(present.distinct())


@register("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new ' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation")
def upsert_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "nation")
    new = index.where("n_nationkey < 5").withColumn("n_name", F.concat(F.lit("new "), F.col("n_name")))
    return metrics.upsert(index, new, "n_nationkey")


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.head_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@register("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS A, count(*) FILTER (l_returnflag = 'N') AS N, count(*) FILTER (l_returnflag = 'R') AS R FROM lineitem GROUP BY l_linestatus")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1))).na.fill(0)


@register("""
WITH f AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS a FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS evaluations, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6) AS std FROM f GROUP BY ALL
""")
def two_level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("a"))
    return inner.groupBy("l_returnflag").agg(F.count("*").alias("evaluations"), F.round(F.avg("a"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("a"), F.lit(0.0)), 6).alias("std"))


@register("SELECT p_brand, count(DISTINCT l_suppkey) AS seeds, count(*) AS n, round(avg(l_quantity), 6) AS mean_rank, round(count(DISTINCT l_suppkey) / (SELECT count(DISTINCT l_suppkey) FROM lineitem), 8) AS selection_rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    runs = lines.agg(F.count_distinct("l_suppkey").alias("runs"))
    by = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count_distinct("l_suppkey").alias("seeds"), F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_rank"))
    return by.select("p_brand", "seeds", "n", "mean_rank", F.round(F.col("seeds") / runs.scalar(), 8).alias("selection_rate"))
