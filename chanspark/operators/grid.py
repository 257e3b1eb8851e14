"""A grid of models over seeds that can be stopped and started again, and its five long tables.

A run is a model specification under a seed. Splits are cached by seed, window and step; the runs of a seed are fitted side
by side. Of each run the predictions, the selected features and a row of what it took are written, that row last, so a
run without it counts as not done and is done again. All metrics are aggregates over the predictions of all runs at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chanspark.functions import arrays
from chanspark.operators import complexity, ensembles, models, ranking
from chanspark.sources import shared

#: Runs of equal width into which scores from 0 to 1 are cut, so that no task orders all of a run's scores.
SCORE_RUNS = 64
#: Rows over which a model's comparisons are averaged, as the suite reports them.
COMPLEXITY_ROWS = 500

RUN = "run string, seed int, window_packets int, step_packets int, train_files long, test_files long, train_windows long, test_windows long, selected_subcarrier_count int, selected_feature_count int, model_name string, family string, top_k string, top_k_sort int, parameters_json string, fit_time_ms double, prediction_time_ms double"
COMPLEXITY = ", ".join(f"{c} {'double' if c.startswith('mean') else 'int'}" for c in complexity.MEASURES)


@dataclass(frozen=True)
class Spec:
    """kind is decision_tree, extra_trees, gradient_boosting, rbf_svm, or the name of one of models.estimator(); top_k None takes all features."""

    name: str
    family: str
    kind: str
    parameters: dict = field(default_factory=dict)
    top_k: int | None = None

    def run(self, seed: int, window: int, step: int) -> str:
        """The name of its run: what can change the result is in it."""
        text = json.dumps([seed, window, step, self.name, self.family, self.kind, self.parameters, self.top_k], sort_keys=True)
        return sha256(text.encode()).hexdigest()[:24]


@dataclass
class Split:
    """rows: (part, group, window_id, label, features), label a class; width: of the features; channels: how many were selected."""

    rows: DataFrame
    width: int
    channels: int


def fitted(spec: Spec, seed: int, rows: DataFrame, classes: list, width: int) -> tuple[object, Callable[[DataFrame], DataFrame]]:
    """The model of rows (features, label), and what adds columns probability (of the classes, in order) and prediction."""
    more = dict(spec.parameters)
    if spec.kind in ("extra_trees", "gradient_boosting"):
        model = ensembles.fit_extra_trees(rows, "features", "label", width, seed=seed, **more) if spec.kind == "extra_trees" else ensembles.fit_boosting(rows, "features", "label", width, **more)
        aligned = lambda df: _winner(df.withColumn("_p", model.probabilities("features")), "_p", model.classes, classes)
        return model, aligned
    if spec.kind == "decision_tree":
        root = models.fit_tree(rows, "features", "label", width, **more)
        model = complexity.of_tree(root, classes, width)
        return model, lambda df: model.predict(df, "features")
    if spec.kind == "rbf_svm":
        count, gamma = more.pop("count", 512), more.pop("gamma", 1.0 / width)
        of = lambda df: df.withColumn("features", models.fourier("features", width, count, gamma, seed))
        model, predict = fitted(Spec(spec.name, spec.family, "linear_svm", more), seed, of(rows), classes, count)
        return model, lambda df: predict(of(df))
    indexed = rows.select(array_to_vector("features").alias("features"), (F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1).cast("double").alias("label"))
    model = models.estimator(spec.kind, seed=seed, **more).fit(indexed)

    def predict(df: DataFrame) -> DataFrame:
        found = model.transform(df.withColumnRenamed("features", "_f").withColumn("features", array_to_vector("_f"))).drop("features").withColumnRenamed("_f", "features")
        p = vector_to_array("probability") if "probability" in found.columns else arrays.softmax(vector_to_array("rawPrediction"))
        kept = [c for c in df.columns]
        return _winner(found.select(*kept, p.alias("_p")), "_p", classes, classes)

    return model, predict


def _winner(df: DataFrame, p: str, have: list, want: list) -> DataFrame:
    """df with the probabilities of the classes `have`, put in the order `want` (0 where missing), and the likeliest class."""
    own = F.array(*[F.coalesce(F.get(F.col(p), have.index(c)), F.lit(0.0)) if c in have else F.lit(0.0) for c in want])
    known = F.array(*map(F.lit, want))
    return df.withColumn("probability", own).drop(p).withColumn("prediction", F.element_at(known, F.array_position("probability", F.array_max("probability")).cast("int")))


class Grid:
    """The runs and tables under a folder, which a later session goes on with."""

    def __init__(self, spark: SparkSession, folder: str, classes: list, side_by_side: int = 2) -> None:
        self.spark, self.folder, self.classes, self.side_by_side = spark, folder.rstrip("/"), classes, side_by_side

    def split(self, seed: int, window: int, step: int, prepare: Callable[[int], Split]) -> Split:
        """What prepare(seed) gives, written once for each seed, window and step."""
        path = f"{self.folder}/splits/seed={seed}-window={window}-step={step}"
        if not shared.exists(self.spark, f"{path}/sizes/_SUCCESS"):
            made = prepare(seed)
            made.rows.select("part", "group", "window_id", "label", F.col("features").cast("array<double>").alias("features")).write.mode("overwrite").parquet(f"{path}/rows")
            self.spark.createDataFrame([(made.width, made.channels)], "width int, channels int").write.mode("overwrite").parquet(f"{path}/sizes")
        sizes = self.spark.read.parquet(f"{path}/sizes").first()
        return Split(self.spark.read.parquet(f"{path}/rows"), sizes["width"], sizes["channels"])

    def left(self, seeds: list[int], specs: list[Spec], window: int, step: int) -> list[tuple[int, Spec]]:
        """The runs that aren't done."""
        planned = {s.run(seed, window, step): (seed, s) for seed in seeds for s in specs}
        frame = self.spark.createDataFrame([(r,) for r in planned], "run string")
        return [planned[r["run"]] for r in frame.join(self.runs(), "run", "left_anti").collect()]

    def run(self, seeds: list[int], specs: list[Spec], window: int, step: int, prepare: Callable[[int], Split]) -> int:
        """Does the runs that are left, and says how many they were."""
        todo = self.left(seeds, specs, window, step)
        for seed in seeds:
            own = [s for k, s in todo if k == seed]
            if not own:
                continue
            split = self.split(seed, window, step, prepare)
            rows = split.rows.persist()
            try:
                train = rows.where("part = 'train'")
                scores = ranking.fisher_scores(train.select("label", F.posexplode("features").alias("feature", "x")), "label", "feature", "x", arrays.EPS)
                ranked = [(r["feature"], r["score"]) for r in scores.orderBy(F.desc("score"), "feature").collect()]  # a row a feature
                sizes = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("group").alias("files")).collect()}
                with ThreadPoolExecutor(self.side_by_side) as pool:
                    for done in [pool.submit(self._one, seed, s, window, step, split, rows, ranked, sizes) for s in own]:
                        done.result()
            finally:
                rows.unpersist()
        return len(todo)

    def _one(self, seed: int, spec: Spec, window: int, step: int, split: Split, rows: DataFrame, ranked: list, sizes: dict) -> None:
        name = spec.run(seed, window, step)
        chosen = ranked[: spec.top_k] if spec.top_k else ranked
        picked = rows.withColumn("features", F.transform(F.array(*[F.lit(f) for f, _ in chosen]), lambda i: F.get(F.col("features"), i)))
        train, test = (picked.where(F.col("part") == p) for p in ("train", "test"))
        began = time.perf_counter()
        model, predict = fitted(spec, seed, train.select("features", "label"), self.classes, len(chosen))
        fit_ms = (time.perf_counter() - began) * 1000
        confidence = F.array_max("probability").alias("confidence")
        out = predict(test).select("group", "window_id", F.col("label").alias("true_class"), F.col("prediction").alias("predicted_class"), (F.col("label") == F.col("prediction")).alias("correct"), confidence, "probability")
        began = time.perf_counter()
        self._put("predictions", name, out.withColumn("seed", F.lit(seed)).withColumn("model_name", F.lit(spec.name)))
        took_ms = (time.perf_counter() - began) * 1000
        label = "all" if spec.top_k is None else str(spec.top_k)
        selection = [(seed, spec.name, spec.family, label, i, f, s) for i, (f, s) in enumerate(chosen, 1)]
        self._put("selection", name, self.spark.createDataFrame(selection, "seed int, model_name string, family string, top_k string, rank int, feature_index int, fisher_score double"))
        size = complexity.of_model(model, test, "features", len(chosen), COMPLEXITY_ROWS).first()
        of = lambda p, c: int(sizes[p][c]) if p in sizes else 0
        row = (name, seed, window, step, of("train", "files"), of("test", "files"), of("train", "n"), of("test", "n"), split.channels, len(chosen), spec.name, spec.family, label, split.width if spec.top_k is None else spec.top_k, json.dumps(spec.parameters, sort_keys=True), fit_ms, took_ms, *size)
        self._put("runs", name, self.spark.createDataFrame([row], f"{RUN}, {COMPLEXITY}").drop("run"))  # last: with it the run is done

    def _put(self, table: str, run: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{table}/run={run}")

    def runs(self) -> DataFrame:
        """A row for each run that is done."""
        if not shared.exists(self.spark, f"{self.folder}/runs"):
            return self.spark.createDataFrame([], f"{RUN}, {COMPLEXITY}")
        # a run's row counts once its file is committed
        return self.spark.read.schema(f"{RUN.removeprefix('run string, ')}, {COMPLEXITY}, run string").parquet(f"{self.folder}/runs").where("seed IS NOT NULL")

    def _table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}").withColumn("run", F.col("run").cast("string"))
        return rows.join(F.broadcast(self.runs().select("run")), "run", "left_semi")  # a row a run

    def predictions(self) -> DataFrame:
        """(run, seed, model_name, group, window_id, true_class, predicted_class, correct, confidence, probability)."""
        return self._table("predictions")

    def selection(self) -> DataFrame:
        """(run, seed, model_name, family, top_k, rank, feature_index, fisher_score)."""
        return self._table("selection")

    def confusion(self) -> DataFrame:
        """confusion_by() of all runs with what the run is."""
        return self.runs().join(confusion_by(self.predictions(), ["run"], self.classes), "run")

    def per_class(self) -> DataFrame:
        return self.runs().join(per_class_by(self.predictions(), ["run"], self.classes), "run")

    def metrics(self) -> DataFrame:
        """overall_by() of all runs with what the run is and took."""
        found = self.runs().join(overall_by(per_class_by(self.predictions(), ["run"], self.classes), ["run"], self.classes), "run")
        return found.withColumn("prediction_time_us_per_window", F.col("prediction_time_ms") * 1000 / F.greatest(F.col("test_samples"), F.lit(1)))


def confusion_by(predictions: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """(keys, true_class, predicted_class, count) for every two classes, with zeros."""
    n = predictions.groupBy(*keys, "true_class", "predicted_class").agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(a).alias("true_class"), F.lit(b).alias("predicted_class")) for a in classes for b in classes])
    met = n.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("true_class", "predicted_class"), "n"))).alias("m"))  # classes squared at most
    each = met.select(*keys, "m", F.explode(every).alias("e"))
    return each.select(*keys, "e.*", F.coalesce(F.try_element_at("m", F.col("e")), F.lit(0)).alias("count"))


def per_class_by(predictions: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """(keys, class_index, class, precision, recall, f1, support, hits, guessed, roc_auc, average_precision); 0 where a ratio is undefined, NaN where an area is."""
    pairs = confusion_by(predictions, keys, classes)
    sides = pairs.select(*keys, F.explode(F.array(F.struct(F.col("true_class").alias("class"), F.col("count").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted_class").alias("class"), F.lit(0).cast("long").alias("s"), F.col("count").alias("p")))).alias("e"), F.when(F.col("true_class") == F.col("predicted_class"), F.col("count")).otherwise(0).alias("h"))
    sums = sides.groupBy(*keys, "e.class").agg(F.sum("e.s").alias("support"), F.sum("e.p").alias("guessed"), (F.sum("h") / 2).cast("long").alias("hits"))
    ratio = lambda top, bottom: F.when(bottom == 0, 0.0).otherwise(top / bottom)
    own = sums.select(*keys, "class", ratio(F.col("hits"), F.col("guessed")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"), ratio(2 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1"), "support", "hits", "guessed")
    index = (F.array_position(F.array(*map(F.lit, classes)), F.col("class")) - 1).cast("int")
    joined = own.join(areas_by(predictions, keys, classes), [*keys, "class"], "left")
    nan = F.lit(float("nan"))
    return joined.select(*keys, index.alias("class_index"), "class", "precision", "recall", "f1", "support", "hits", "guessed", F.coalesce("roc_auc", nan).alias("roc_auc"), F.coalesce("average_precision", nan).alias("average_precision"))


def areas_by(predictions: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """(keys, class, roc_auc, average_precision) of each class against the rest by its probability; null without rows of both kinds."""
    each = F.array(*[F.struct(F.lit(c).alias("class"), F.get("probability", F.lit(k)).alias("score"), (F.col("true_class") == F.lit(c)).alias("own")) for k, c in enumerate(classes)])
    n = predictions.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*").groupBy(*keys, "class", "score").agg(F.count("*").alias("n"), F.count_if("own").alias("pos"))
    cut = n.withColumn("_run", F.least(F.floor(F.col("score") * SCORE_RUNS), F.lit(SCORE_RUNS - 1)))
    own = [*keys, "class"]
    totals = cut.groupBy(*own, "_run").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rp"))
    above = Window.partitionBy(*own).orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*own, "_run", F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"))
    upto = Window.partitionBy(*own, "_run").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    step = cut.join(before, [*own, "_run"]).withColumn("cn", F.sum("n").over(upto) + F.col("bn")).withColumn("cp", F.sum("pos").over(upto) + F.col("bp"))
    neg = F.col("n") - F.col("pos")
    sums = step.groupBy(*own).agg(F.sum("pos").alias("p"), F.sum(neg).alias("q"), F.sum(F.col("pos").cast("double") * (F.col("cn") - F.col("cp")) - F.col("pos") * neg * F.lit(0.5)).alias("lost"), F.sum(F.col("pos") * (F.col("cp") / F.col("cn"))).alias("top"))
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return sums.select(*own, F.when(both, 1 - F.col("lost") / (F.col("p").cast("double") * F.col("q"))).alias("roc_auc"), F.when(both, F.col("top") / F.col("p")).alias("average_precision"))


def overall_by(classes_of_run: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """(keys, accuracy, macro_f1, weighted_f1, areas macro and weighted, each class's f1, test_samples) from per_class_by().

    macro_f1 is over classes that occur, truly or as predicted. An area is NaN if it is undefined for a class.
    """
    n = F.sum("support")
    occurs = F.col("support") + F.col("guessed") > 0
    area = lambda c: [F.avg(c), F.sum(F.col(c) * F.col("support")) / n]
    auc, ap = area("roc_auc"), area("average_precision")
    return classes_of_run.groupBy(*keys).agg(
        (F.sum("hits") / n).alias("accuracy"), F.avg(F.when(occurs, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        auc[0].alias("roc_auc_ovr_macro"), auc[1].alias("roc_auc_ovr_weighted"), ap[0].alias("average_precision_macro"), ap[1].alias("average_precision_weighted"),
        *[F.max(F.when(F.col("class") == F.lit(c), F.col("f1"))).alias(f"{c}_f1") for c in classes], n.alias("test_samples"),
    )


def summary(metrics: DataFrame, keys: list[str], measures: list[str], order: list[Column]) -> DataFrame:
    """(keys, each measure's mean and population deviation over seeds), with its position in an order."""
    found = metrics.groupBy(*keys).agg(*[e for m in measures for e in (F.avg(F.when(~F.isnan(m), F.col(m))).alias(f"{m}_mean"), F.stddev_pop(F.when(~F.isnan(m), F.col(m))).alias(f"{m}_std"))])
    return found.withColumn("position", F.row_number().over(Window.orderBy(*order, *keys)))  # a row a setting
