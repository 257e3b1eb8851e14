"""Queries of metrics, summaries, splits, models and the state machine.

Documents and labels stand for windows and predictions: quality is the true class, toxic the predicted one, n_chars a
score; customers of the business tables stand for files, market segments for classes, nations for quadrants.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.operators import metrics, models, splits, windows
from chanspark.plans.catalogue import register, table
from chanspark.streaming import machine


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the document they are of."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


S = "s AS (SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id))"
CLASSES = """
n AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL),
k AS (SELECT t AS class FROM n UNION SELECT p FROM n),
c AS (SELECT class, coalesce((SELECT sum(n) FROM n WHERE t = class), 0) AS support, coalesce((SELECT sum(n) FROM n WHERE p = class), 0) AS predicted, coalesce((SELECT sum(n) FROM n WHERE t = class AND p = class), 0) AS hits FROM k),
m AS (SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hits AS BIGINT) AS hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hits / (support + predicted) END AS f1 FROM c)
"""


@register("SELECT quality AS true_class, toxic AS predicted_class, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 8) AS share FROM labels GROUP BY quality, toxic")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("share", F.round("share", 8))


@register("SELECT quality AS true_class, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1, count(*) FILTER (toxic = 2) AS predicted_2 FROM labels WHERE quality IN (0, 1, 2) GROUP BY ALL")
def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_wide(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1, 2])


@register(f"WITH {CLASSES} SELECT class, support, predicted, hits, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM m")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.per_class(table(spark, sf_dir, "labels"), "quality", "toxic")
    return found.select("class", "support", "predicted", "hits", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@register(f"""
WITH {CLASSES} SELECT round(sum(hits) / sum(support), 8) AS accuracy, round(avg(precision), 8) AS macro_precision, round(avg(recall), 8) AS macro_recall, round(avg(f1), 8) AS macro_f1,
  round(sum(f1 * support) / sum(support), 8) AS weighted_f1, round(avg(f1) FILTER (support > 0), 8) AS supported_f1 FROM m
""")
def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.overall(metrics.per_class(table(spark, sf_dir, "labels"), "quality", "toxic"))
    return found.select(*[F.round(c, 8).alias(c) for c in found.columns])


@register(f"""
WITH {S}, r AS (SELECT quality, avg(k) OVER (PARTITION BY n_chars) AS rank FROM (SELECT *, row_number() OVER (ORDER BY n_chars) AS k FROM s)),
c AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n, sum(rank) FILTER (quality = 1) AS sr FROM r)
SELECT p AS positives, n AS negatives, round((sr - p * (p + 1) / 2) / (p * n), 8) AS auc FROM c
""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(scored(spark, sf_dir), F.col("quality") == 1, "n_chars").withColumn("auc", F.round("auc", 8))


@register(f"""
WITH {S}, g AS (SELECT n_chars, count(*) AS n, count(*) FILTER (quality = 1) AS p FROM s GROUP BY n_chars),
c AS (SELECT p, sum(n) OVER w AS cn, sum(p) OVER w AS cp FROM g WINDOW w AS (ORDER BY n_chars DESC))
SELECT CAST(sum(p) AS BIGINT) AS positives, round(sum(p * cp / cn) / sum(p), 8) AS average_precision FROM c
""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir), F.col("quality") == 1, "n_chars").withColumn("average_precision", F.round("average_precision", 8))


@register(f"WITH {S} SELECT source, lang, count(*) AS support, count(*) FILTER (quality = toxic) AS correct, round(count(*) FILTER (quality = toxic) / count(*), 8) AS accuracy FROM s GROUP BY ALL")
def group_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by(scored(spark, sf_dir), "quality", "toxic", "source", "lang").withColumn("accuracy", F.round("accuracy", 8))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy_by(scored(spark, sf_dir), "quality", "toxic", "lang", "source")


RUNS = f"{S}, r AS (SELECT lang, source, count(*) AS support, count(*) FILTER (quality = toxic) / count(*) AS accuracy FROM s GROUP BY ALL)"


@register(f"WITH {RUNS} SELECT lang, round(avg(accuracy), 8) AS accuracy_mean, round(stddev_pop(accuracy), 8) AS accuracy_std, round(avg(support), 8) AS support_mean, round(stddev_pop(support), 8) AS support_std FROM r GROUP BY lang")
def summary_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summarise(_runs(spark, sf_dir), ["lang"], ["accuracy", "support"])
    return found.select("lang", *[F.round(c, 8).alias(c) for c in found.columns[1:]])


@register(f"WITH {RUNS} SELECT lang, round(avg(accuracy), 8) AS accuracy_mean, round(coalesce(stddev_samp(accuracy), 0), 8) AS accuracy_std FROM r GROUP BY lang")
def summary_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summarise(_runs(spark, sf_dir), ["lang"], ["accuracy"], ddof=1)
    return found.select("lang", *[F.round(c, 8).alias(c) for c in found.columns[1:]])


@register(f"WITH {RUNS} SELECT source, lang, support, round(accuracy, 8) AS accuracy FROM r ORDER BY accuracy, support, source, lang LIMIT 10")
def worst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).orderBy("accuracy", "support", "source", "lang").limit(10).select("source", "lang", "support", F.round("accuracy", 8).alias("accuracy"))


@register("""
WITH c AS (SELECT o_orderpriority AS name, round(avg(o_totalprice), 4) AS score, round(stddev_pop(o_totalprice), 4) AS std, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT name FROM c WHERE score >= (SELECT max(score) FROM c) - 2000 ORDER BY n DESC, std, name LIMIT 1)
SELECT name, score, std, n, name IN (SELECT name FROM w) AS selected_by_policy, CAST(row_number() OVER (ORDER BY name IN (SELECT name FROM w) DESC, score DESC, std, name) AS INTEGER) AS position FROM c
""")
def policy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"), F.count("*").alias("n"))
    return metrics.by_policy(candidates, "score", 2000, [F.desc("n"), F.asc("std")], [F.desc("score"), F.asc("std")], "name")


FILES = "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")


@register("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer)
SELECT c_custkey, CASE WHEN r <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'test' ELSE 'train' END AS part FROM r
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified(files(spark, sf_dir), ["c_mktsegment", "c_nationkey"], "c_custkey", 0.2, order=F.col("c_custkey")).select("c_custkey", "part")


@register("SELECT c_nationkey AS held_out, CAST((SELECT count(*) FROM customer) - count(*) AS BIGINT) AS train, count(*) AS test FROM customer GROUP BY ALL")
def leave_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leave_one_out(files(spark, sf_dir), "c_nationkey")


@register("SELECT c_nationkey, count(DISTINCT c_mktsegment) AS labels FROM customer GROUP BY ALL HAVING count(DISTINCT c_mktsegment) > 1")
def mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.mixed_groups(files(spark, sf_dir), "c_nationkey", "c_mktsegment")


@register("""
WITH q AS (SELECT c_nationkey, greatest(1, round_even(300 * count(*) / sum(count(*)) OVER (), 0)) AS q FROM customer GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
SELECT c_custkey, c_nationkey FROM r JOIN q USING (c_nationkey) WHERE r <= q
""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.quota(files(spark, sf_dir), "c_nationkey", 300, F.col("c_custkey")).select("c_custkey", "c_nationkey")


@register("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 2")
def quick_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.head_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 2).select("c_mktsegment", "c_custkey")


#: A small tree over (quantity, discount, price) of line items.
TREE = models.Node(feature=0, threshold=24.0, left=models.Node(feature=1, threshold=0.05, left=models.Node("A"), right=models.Node("B")), right=models.Node(feature=2, threshold=40000.0, left=models.Node("C"), right=models.Node("D")))


@register("""
SELECT label, count(*) AS n FROM (SELECT CASE WHEN l_quantity <= 24 THEN CASE WHEN l_discount <= 0.05 THEN 'A' ELSE 'B' END ELSE CASE WHEN l_extendedprice <= 40000 THEN 'C' ELSE 'D' END END AS label FROM lineitem) GROUP BY label
""")
def tree_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount", "l_extendedprice").alias("f"))
    return rows.select(models.tree_column(TREE, "f").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@register()
def tree_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of an exact tree that tells return flags by quantity, discount, tax and line number."""
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("f"), F.col("l_returnflag").alias("y"))
    root = models.fit_tree(rows, "f", "y", 4, max_depth=3)
    return spark.createDataFrame(models.nodes(root), "node long, depth int, feature int, threshold double, label string, is_leaf boolean")


@register("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id, r.label, list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, r.vec_id AS other FROM q JOIN embeddings r ON q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS k FROM d),
v AS (SELECT vec_id, label, count(*) AS n FROM k WHERE k <= 5 GROUP BY ALL)
SELECT vec_id, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS f FROM v) WHERE f = 1
""")
def nearest_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = table(spark, sf_dir, "embeddings")
    return models.nearest_vote(every.where("vec_id % 20 = 0"), every, "vec_id", "embedding", "label", 5)


@register("SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 8) AS weight FROM embeddings GROUP BY label")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.balanced_weights(table(spark, sf_dir, "embeddings"), "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("weight"), 8).alias("weight"))


@register("SELECT event_id, CASE WHEN value < 100 THEN 'empty' WHEN event_type = 'purchase' THEN 'movement' ELSE 'static_presence' END AS predicted FROM events")
def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("value") < 100, "empty").otherwise("presence")
    second = F.when(F.col("event_type") == "purchase", "movement").otherwise("static_presence")
    return table(spark, sf_dir, "events").select("event_id", models.two_stage(first, second, "empty").alias("predicted"))


@register()
def forest_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics of a forest on the held-out vectors; the split is by key, so that it repeats."""
    every = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features"))
    split = splits.stratified(every, ["label"], "vec_id", 0.2)
    model = models.estimator("extra_trees", numTrees=20, maxDepth=6).fit(split.where("part = 'train'"))
    return metrics.per_class(model.transform(split.where("part = 'test'")), "label", "prediction")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as windows of a stream with class probabilities that follow from their value, and an expected state."""
    v = F.col("value") / 500
    scores = F.array(F.greatest(1 - v, F.lit(0.0)), F.lit(0.4), v * v)
    df = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", scores.alias("p"))
    expected = F.when(F.col("event_type") == "purchase", "movement").when(F.col("event_type") == "view", "empty").otherwise("static_presence")
    return df.select("user_id", "ts", "event_id", expected.alias("expected"), *[F.col("p")[k].alias(c) for k, c in enumerate(machine.PROBABILITIES)])


@register()
def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.replay(probabilities(spark, sf_dir), "user_id", ["ts", "event_id"], machine.config([0.2, 0.3, 0.5]), ["event_id", "expected"])


@register()
def state_machine_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine.judge(state_machine(spark, sf_dir), "expected", "user_id")


@register()
def state_machine_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a grid of smoothing, confirmations and least probabilities."""
    grid = [(w, n, p, d, q) for w in ([1.0], [0.3, 0.7], [0.2, 0.3, 0.5]) for n in (1, 2) for p in (0.5, 0.55, 0.6) for d in (1, 2, 3) for q in (0.5, 0.55, 0.6, 0.65)]
    candidates = {k: machine.config(w, normal={t: (n, p) for t in machine.NORMAL}, direct={t: (d, q) for t in machine.DIRECT}) for k, (w, n, p, d, q) in enumerate(grid)}
    return machine.tune(probabilities(spark, sf_dir), "user_id", ["ts", "event_id"], "expected", candidates)


@register()
def window_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packets to predictions: hopping windows, descriptors, an exact tree, and its accuracy by window label."""
    events = table(spark, sf_dir, "events").withColumn("positive", (F.col("event_type") == "purchase").cast("int"))
    hopped = windows.hop(events, ["user_id"], ["ts", "event_id"], 20, 5)
    truth = hopped.groupBy("user_id", "window_index").agg(F.when(F.sum("positive") >= 5, 1).otherwise(0).alias("label"))
    rows = windows.feature_vectors(windows.describe(hopped, ["user_id"], "value"), ["user_id"]).join(truth, ["user_id", "window_index"])
    root = models.fit_tree(rows, "features", "label", 11, max_depth=2)
    return metrics.per_class(rows.select("label", models.tree_column(root, "features").alias("prediction")), "label", "prediction")
