"""Queries of the experiment suite's stages: windows of many sizes, ensembles, complexity, the grid of models and its tables.

Vectors of embeddings stand for feature rows (vec_id for files, label for classes), streams of events for recordings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.functions import naming
from chanspark.operators import complexity, ensembles, folds, grid, metrics, models, panes, splits
from chanspark.plans.catalogue import register, table
from chanspark.plans.sensor import KEYS, ORDER, W, events
from chanspark.sources import shared

#: Sizes and steps of windows, in packets.
CANDIDATES = [(10, 5), (20, 5), (20, 10), (30, 5), (40, 10), (60, 15), (80, 20), (100, 25)]
_C = ", ".join(f"({s}, {t})" for s, t in CANDIDATES)


@register(f"""
WITH c(size, step) AS (VALUES {_C}),
p AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT user_id, size, step, unnest(range(0, (n - size) // step + 1)) AS window_index FROM (SELECT DISTINCT user_id, n FROM p), c WHERE n >= size),
hop AS (SELECT p.*, size, step, window_index FROM p JOIN k ON p.user_id = k.user_id AND pos >= window_index * step AND pos < window_index * step + size),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY user_id, size, step, window_index ORDER BY pos) AS d FROM hop)
SELECT user_id, size, step, window_index, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) AS peak_to_peak, round(sum(value * value), 4) AS energy,
  round(avg(abs(d)), 6) AS mean_abs_diff, round(max(abs(d)), 6) AS max_abs_diff, round(sum(d * d), 4) AS diff_energy, round(stddev_pop(d), 6) AS std_diff, round(regr_slope(value, pos), 6) AS slope
FROM d GROUP BY user_id, size, step, window_index
""")
def pane_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors of all windows of eight sizes from one scan."""
    found = panes.describe_all(events(spark, sf_dir), KEYS, ORDER, "value", CANDIDATES)
    exact = ("min", "max")
    return found.select("user_id", "size", "step", "window_index", *[F.col(c) if c in exact else F.round(c, 4 if "energy" in c else 6).alias(c) for c in naming.DESCRIPTORS])


@register(f"SELECT event_id, row_number() OVER ({W}) - 1 AS pos FROM events")
def stream_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places within streams, counted without a task that holds a stream."""
    return panes.numbered(events(spark, sf_dir), KEYS, ORDER).select("event_id", "pos")


def _vectors(spark: SparkSession, sf_dir: str, seed: int = 1) -> DataFrame:
    every = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    order = F.pmod(F.col("vec_id") * 7919 + seed * 104729, F.lit(1000003))
    return splits.stratified(every, ["label"], "vec_id", 0.2, order)


@register()
def extra_trees_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics of extremely randomised trees on held-out vectors."""
    rows = _vectors(spark, sf_dir)
    model = ensembles.fit_extra_trees(rows.where("part = 'train'"), "features", "label", 64, trees=20, max_depth=6, seed=1)
    return metrics.per_class(model.predict(rows.where("part = 'test'"), "features"), "label", "prediction")


@register()
def boosting_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics of gradient boosting of all classes on held-out vectors."""
    rows = _vectors(spark, sf_dir)
    model = ensembles.fit_boosting(rows.where("part = 'train'"), "features", "label", 64, rounds=3, max_depth=2, bins=32)
    return metrics.per_class(model.predict(rows.where("part = 'test'"), "features"), "label", "prediction")


#: A tree over (quantity, discount, price, tax) whose leaves lie at different depths.
_N = models.Node
UNEVEN = _N(feature=0, threshold=10.0, left=_N("A"), right=_N(feature=2, threshold=30000.0, left=_N(feature=1, threshold=0.03, left=_N("B"), right=_N(feature=0, threshold=20.0, left=_N("C"), right=_N("A"))), right=_N("D")))


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ensembles.Forest]:
    rows = table(spark, sf_dir, "lineitem").select(F.array("l_quantity", "l_discount", "l_extendedprice", "l_tax").alias("f"))
    return rows, complexity.of_tree(UNEVEN, ["A", "B", "C", "D"], 4)


@register("""
SELECT 1 AS actual_tree_count, 9 AS actual_node_count, 4 AS actual_max_depth, 3 AS used_feature_count,
  round(avg(CASE WHEN l_quantity <= 10 THEN 1 WHEN l_extendedprice > 30000 THEN 2 WHEN l_discount <= 0.03 THEN 3 ELSE 4 END), 8) AS mean_comparisons_per_prediction FROM lineitem
""")
def model_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, forest = _lines(spark, sf_dir)
    return complexity.of_forest(forest, rows, "f").withColumn("mean_comparisons_per_prediction", F.round("mean_comparisons_per_prediction", 8))


@register("""
WITH l AS (SELECT CASE WHEN l_quantity <= 10 THEN [1, 2] WHEN l_extendedprice > 30000 THEN [1, 3, 7] WHEN l_discount <= 0.03 THEN [1, 3, 6, 12] WHEN l_quantity <= 20 THEN [1, 3, 6, 13, 26] ELSE [1, 3, 6, 13, 27] END AS path FROM lineitem)
SELECT 0 AS tree, node, count(*) AS rows FROM (SELECT unnest(path)::BIGINT AS node FROM l) GROUP BY node
""")
def node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many line items go through each node of a tree."""
    rows, forest = _lines(spark, sf_dir)
    return complexity.routed(forest, rows, "f")


@register("""
SELECT tree, node, depth, feature, threshold::DOUBLE AS threshold, is_leaf FROM (VALUES (0, 1, 0, 0, 10.0, false), (0, 2, 1, NULL, NULL, true), (0, 3, 1, 2, 30000.0, false), (0, 6, 2, 1, 0.03, false), (0, 7, 2, NULL, NULL, true), (0, 12, 3, NULL, NULL, true), (0, 13, 3, 0, 20.0, false), (0, 26, 4, NULL, NULL, true), (0, 27, 4, NULL, NULL, true)) t(tree, node, depth, feature, threshold, is_leaf)
WHERE node IN (SELECT unnest(CASE WHEN l_quantity <= 10 THEN [1, 2] WHEN l_extendedprice > 30000 THEN [1, 3, 7] WHEN l_discount <= 0.03 THEN [1, 3, 6, 12] WHEN l_quantity <= 20 THEN [1, 3, 6, 13, 26] ELSE [1, 3, 6, 13, 27] END) FROM lineitem)
""")
def reached_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a tree's nodes, of those that a line item reaches."""
    rows, forest = _lines(spark, sf_dir)
    reached = complexity.routed(forest, rows, "f").select("tree", "node")
    return forest.nodes(spark).join(reached, ["tree", "node"]).select("tree", "node", "depth", "feature", "threshold", "is_leaf")


SEEDS = [1, 2]
SPECS = [grid.Spec("stump", "tree", "decision_tree", {"max_depth": 1}, 1), grid.Spec("trees", "extra_trees", "extra_trees", {"trees": 5, "max_depth": 4}, 12)]
_FOLDERS: dict[tuple[str, str], str] = {}


def _grid(spark: SparkSession, sf_dir: str) -> grid.Grid:
    """The grid over the vectors; a session does its runs once, for whichever table is asked for first."""
    folder = _FOLDERS.setdefault((spark.sparkContext.applicationId, sf_dir), shared.new_folder(spark, "grid"))
    found = grid.Grid(spark, folder, list(range(10)))

    def prepare(seed: int) -> grid.Split:
        rows = _vectors(spark, sf_dir, seed)
        return grid.Split(rows.select("part", F.col("vec_id").alias("group"), F.col("vec_id").alias("window_id"), F.col("label").cast("int").alias("label"), "features"), 64, 64)

    found.run(SEEDS, SPECS, 1, 1, prepare)
    return found


SPLIT = """
seeds AS (SELECT unnest([1, 2]) AS seed),
s AS (SELECT seed, vec_id, label, embedding, row_number() OVER (PARTITION BY seed, label ORDER BY (vec_id * 7919 + seed * 104729) % 1000003, vec_id) AS r, count(*) OVER (PARTITION BY seed, label) AS n FROM embeddings, seeds),
p AS (SELECT *, r <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS test FROM s),
l AS (SELECT seed, vec_id, label, test, generate_subscripts(embedding, 1) - 1 AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM p),
c AS (SELECT seed, f, label, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM l WHERE NOT test GROUP BY ALL),
t AS (SELECT seed, f, sum(n * m) / sum(n) AS mean FROM c GROUP BY ALL),
fs AS (SELECT seed, f, sum(n * (m - mean) * (m - mean)) / (sum(n * v) + 1e-8) AS score FROM c JOIN t USING (seed, f) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, f) AS rank FROM fs)
"""
#: A tree of one split on the best feature: its threshold, what each side says, and what that gives for the held-out vectors.
STUMP = SPLIT + """,
x AS (SELECT l.* FROM l JOIN ranked USING (seed, f) WHERE rank = 1),
val AS (SELECT seed, x, label, count(*) AS n FROM x WHERE NOT test GROUP BY ALL),
dist AS (SELECT seed, x, lead(x) OVER (PARTITION BY seed ORDER BY x) AS nx FROM (SELECT DISTINCT seed, x FROM val)),
cand AS (SELECT seed, x, (x + nx) / 2 AS threshold FROM dist WHERE nx IS NOT NULL),
side AS (SELECT cand.seed, threshold, cand.x AS upto, label, sum(n) FILTER (val.x <= cand.x) AS l, sum(n) FILTER (val.x > cand.x) AS r FROM cand JOIN val USING (seed) GROUP BY ALL),
cost AS (SELECT seed, threshold, round(sum(l) - sum(coalesce(l, 0)::DOUBLE ** 2) / sum(l) + sum(r) - sum(coalesce(r, 0)::DOUBLE ** 2) / sum(r), 9) AS cost FROM side GROUP BY ALL),
best AS (SELECT seed, threshold FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cost, threshold) AS k FROM cost) WHERE k = 1),
leaf AS (SELECT seed, x <= threshold AS low, label, count(*) AS n FROM x JOIN best USING (seed) WHERE NOT test GROUP BY ALL),
says AS (SELECT seed, low, label AS says FROM (SELECT *, row_number() OVER (PARTITION BY seed, low ORDER BY n DESC, label) AS k FROM leaf) WHERE k = 1),
told AS (SELECT x.seed, vec_id, label AS true_class, says AS predicted_class FROM x JOIN best USING (seed) JOIN says ON says.seed = x.seed AND says.low = (x.x <= threshold) WHERE test),
pairs AS (SELECT seed, a.i AS true_class, b.i AS predicted_class FROM seeds, range(10) a(i), range(10) b(i)),
conf AS (SELECT pairs.*, count(vec_id) AS count FROM pairs LEFT JOIN told USING (seed, true_class, predicted_class) GROUP BY ALL),
cls AS (SELECT seed, i AS class, sum(count) FILTER (true_class = i) AS support, sum(count) FILTER (predicted_class = i) AS guessed, sum(count) FILTER (true_class = i AND predicted_class = i) AS hits, sum(count) AS n FROM conf, range(10) c(i) GROUP BY ALL),
met AS (SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision, hits / support AS recall, 2 * hits / (support + guessed) AS f1, (1 + hits / support - (guessed - hits) / (n - support)) / 2 AS roc_auc,
  CASE WHEN guessed > 0 THEN hits / guessed * hits / support ELSE 0 END + (1 - hits / support) * support / n AS average_precision FROM cls)
"""


@register(f"WITH {SPLIT} SELECT seed, CAST(rank AS INTEGER) AS rank, CAST(f AS INTEGER) AS feature_index, round(score, 8) AS fisher_score FROM ranked WHERE rank <= 12")
def grid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that a model of twelve takes, of each seed's training rows."""
    return _grid(spark, sf_dir).selection().where("model_name = 'trees'").select("seed", "rank", "feature_index", F.round("fisher_score", 8).alias("fisher_score"))


@register(f"WITH {STUMP} SELECT seed, vec_id AS window_id, CAST(true_class AS INTEGER) AS true_class, CAST(predicted_class AS INTEGER) AS predicted_class, true_class = predicted_class AS correct FROM told")
def grid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).predictions().where("model_name = 'stump'").select("seed", "window_id", "true_class", "predicted_class", "correct")


@register(f"WITH {STUMP} SELECT seed, CAST(true_class AS INTEGER) AS true_class, CAST(predicted_class AS INTEGER) AS predicted_class, count FROM conf")
def grid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).confusion().where("model_name = 'stump'").select("seed", "true_class", "predicted_class", "count")


@register(f"WITH {STUMP} SELECT seed, CAST(class AS INTEGER) AS class, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, CAST(support AS BIGINT) AS support, round(roc_auc, 8) AS roc_auc, round(average_precision, 8) AS average_precision FROM met")
def grid_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")]
    return _grid(spark, sf_dir).per_class().where("model_name = 'stump'").select("seed", "class", *rounded, "support", F.round("roc_auc", 8).alias("roc_auc"), F.round("average_precision", 8).alias("average_precision"))


@register(f"""
WITH {STUMP}, train AS (SELECT seed, count(*) FILTER (NOT test) AS train_windows, count(*) FILTER (test) AS test_windows FROM p GROUP BY seed)
SELECT seed, train_windows, test_windows, round(sum(hits) / sum(support), 8) AS accuracy, round(avg(f1) FILTER (support + guessed > 0), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1,
  round(avg(roc_auc), 8) AS roc_auc_ovr_macro, round(sum(roc_auc * support) / sum(support), 8) AS roc_auc_ovr_weighted, round(avg(average_precision), 8) AS average_precision_macro, round(sum(average_precision * support) / sum(support), 8) AS average_precision_weighted,
  1 AS actual_tree_count, 3 AS actual_node_count, 1 AS actual_max_depth, 1 AS used_feature_count, 1.0::DOUBLE AS mean_comparisons_per_prediction
FROM met JOIN train USING (seed) GROUP BY ALL
""")
def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = ["accuracy", "macro_f1", "weighted_f1", "roc_auc_ovr_macro", "roc_auc_ovr_weighted", "average_precision_macro", "average_precision_weighted"]
    return _grid(spark, sf_dir).metrics().where("model_name = 'stump'").select("seed", "train_windows", "test_windows", *[F.round(c, 8).alias(c) for c in rounded], *complexity.MEASURES)


@register()
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics of exact trees that are each fitted on all vectors but the one that they judge, over two features of the vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 2), lambda x: F.round(x.cast("double"), 2)).alias("f"))
    return metrics.per_class(folds.leave_one_out(rows, "vec_id", "f", "label", 2, max_depth=2), "true", "predicted")


@register()
def window_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of windows, the best first: descriptors of all of them from one scan, and a small tree over each seed's streams."""
    candidates, streams = [(20, 5), (40, 10)], table(spark, sf_dir, "events").withColumn("label", (F.col("user_id") % 3).cast("int"))
    described = panes.describe_all(streams, ["user_id", "label"], ORDER, "value", candidates).persist()
    found = grid.Grid(spark, shared.new_folder(spark, "search"), [0, 1, 2])
    spec = grid.Spec("tree", "tree", "decision_tree", {"max_depth": 2, "min_split": 5}, 6)
    for size, step in candidates:

        def prepare(seed: int, size: int = size, step: int = step) -> grid.Split:
            own = described.where((F.col("size") == size) & (F.col("step") == step))
            files = splits.stratified(own.select("user_id", "label").distinct(), ["label"], "user_id", 0.2, seed=seed).select("user_id", "part")
            rows = own.join(files, "user_id").select("part", F.col("user_id").alias("group"), F.col("window_index").alias("window_id"), "label", F.array(*naming.DESCRIPTORS).alias("features"))
            return grid.Split(rows, len(naming.DESCRIPTORS), 1)

        found.run([1, 2], [spec], size, step, prepare)
    described.unpersist()
    measures = ["accuracy", "macro_f1", "weighted_f1", "train_windows", "test_windows"]
    order = [F.desc("macro_f1_mean"), F.asc("macro_f1_std"), F.asc("window_packets")]
    return grid.summary(found.metrics(), ["window_packets", "step_packets"], measures, order)
