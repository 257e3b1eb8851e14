"""How large a fitted model is, and how many thresholds a prediction takes: from tables of nodes and counts of rows."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.operators.ensembles import Forest, Tree
from chanspark.operators.models import Node
from chanspark.sources import shared

#: The columns of the complexity of a model.
MEASURES = ("actual_tree_count", "actual_node_count", "actual_max_depth", "used_feature_count", "mean_comparisons_per_prediction")


def of_tree(root: Node, classes: list, width: int) -> Forest:
    """An exact tree as a forest of one, whose leaves have the whole vote of their label."""
    tree = Tree()
    todo = [(root, 0)]
    while todo:
        node, at = todo.pop()
        if node.left is None:
            tree.value[at] = [float(c == node.label) for c in classes]
        else:
            child = tree.split(at, node.feature, node.threshold)
            todo += [(node.left, child), (node.right, child + 1)]
    return Forest([tree], classes, width)


def saved_nodes(spark: SparkSession, model) -> DataFrame:
    """Forest.nodes() of a tree or forest of Spark ML, read from what it saves; value has the votes of a leaf's classes, or its score.

    The model is written to the shared folder, and its nodes are renumbered from their root on.
    """
    folder = shared.new_folder(spark, "model")
    model.write().overwrite().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    data = data.select(F.col("treeID").alias("tree"), "nodeData.*") if "treeID" in data.columns else data.withColumn("tree", F.lit(0))
    rows = data.select("tree", "id", "leftChild", "rightChild", "prediction", "impurityStats", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).collect()  # a row a node
    shared.remove(spark, folder)
    trees: dict[int, dict[int, object]] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["id"]] = r
    votes = not hasattr(model, "treeWeights") or not type(model).__name__.startswith("GBT")
    out = []
    for k, own in sorted(trees.items()):
        todo = [(0, 1)]
        while todo:
            at, number = todo.pop()
            r = own[at]
            leaf = r["leftChild"] < 0
            value = [float(x) for x in r["impurityStats"]] if votes else [r["prediction"] * model.treeWeights[k]]
            out.append((k, number, number.bit_length() - 1, None if leaf else r["feature"], None if leaf else r["threshold"], None if leaf else 2 * number, None if leaf else 2 * number + 1, leaf, value if leaf else None))
            if not leaf:
                todo += [(r["leftChild"], 2 * number), (r["rightChild"], 2 * number + 1)]
    return spark.createDataFrame(out, "tree int, node long, depth int, feature int, threshold double, left long, right long, is_leaf boolean, value array<double>")


def from_nodes(nodes: DataFrame, classes: list, width: int) -> Forest:
    """The forest that a table of nodes describes."""
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():  # a row a node
        trees.setdefault(r["tree"], {})[r["node"]] = r
    out = []
    for _, own in sorted(trees.items()):
        tree, todo = Tree(), [(1, 0)]
        while todo:
            number, at = todo.pop()
            r = own[number]
            if r["is_leaf"]:
                tree.value[at] = list(r["value"])
            else:
                child = tree.split(at, r["feature"], r["threshold"])
                todo += [(r["left"], child), (r["right"], child + 1)]
        out.append(tree)
    return Forest(out, classes, width)


def of_forest(forest: Forest, rows: DataFrame, features: str, most: int | None = None) -> DataFrame:
    """MEASURES of a forest: comparisons are a mean over rows, of which `most` are taken (None: all)."""
    spark = rows.sparkSession
    nodes = forest.nodes(spark)
    size = nodes.agg(
        F.count_distinct("tree").cast("int").alias(MEASURES[0]), F.count("*").cast("int").alias(MEASURES[1]), F.max("depth").alias(MEASURES[2]), F.count_distinct("feature").cast("int").alias(MEASURES[3]),
    )
    taken = rows if most is None else rows.limit(most)
    mean = taken.select(forest.comparisons(features).alias("c")).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias(MEASURES[4]))
    return size.crossJoin(mean)  # one row each


def routed(forest: Forest, rows: DataFrame, features: str) -> DataFrame:
    """(tree, node, rows): how many rows go through each node of a forest; those that no row reaches are left out."""
    every = [(k, n) for k, t in enumerate(forest.trees) for n in t.number]
    paths = rows.select(F.explode(forest.paths(features)).alias("i")).where("i IS NOT NULL").groupBy("i").agg(F.count("*").alias("rows"))
    names = rows.sparkSession.createDataFrame([(i, *e) for i, e in enumerate(every)], "j long, tree int, node long")
    return paths.join(F.broadcast(names), F.col("i") == F.col("j")).select("tree", "node", "rows")  # a row a node


def of_model(model, rows: DataFrame, features: str, width: int, most: int | None = None) -> DataFrame:
    """MEASURES of a fitted model: an exact tree, a Forest, or a model of Spark ML, alone or last in a pipeline.

    One against the rest counts the trees or coefficients of all its machines. A linear model compares each coefficient
    and uses the features of which one isn't 0; any other model uses all features and compares as many.
    """
    spark = rows.sparkSession
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if isinstance(model, Node):
        model = of_tree(model, sorted({n.label for n in _leaves(model)}, key=str), width)
    if isinstance(model, Forest):
        return of_forest(model, rows, features, most)
    parts = model.models if hasattr(model, "models") else [model]
    if all(hasattr(p, "trees") or hasattr(p, "toDebugString") for p in parts):
        forests = [from_nodes(saved_nodes(spark, p), [0, 1], width) for p in parts]
        return of_forest(Forest([t for f in forests for t in f.trees], [0, 1], width), rows, features, most)
    rows_of = [r for p in parts if hasattr(p, "coefficientMatrix") or hasattr(p, "coefficients") for r in (p.coefficientMatrix.toArray() if hasattr(p, "coefficientMatrix") else [p.coefficients.toArray()])]
    used, compared = (sum(any(abs(r[f]) > 1e-12 for r in rows_of) for f in range(width)), float(len(rows_of) * width)) if rows_of else (width, float(width))
    return spark.createDataFrame([(0, 0, 0, used, compared)], ", ".join(f"{c} {'double' if c == MEASURES[4] else 'int'}" for c in MEASURES))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)
