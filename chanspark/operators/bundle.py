"""What is fitted last and deployed: preprocessing, features, model and settings as one bundle; and models of two stages.

A bundle is a folder of JSON files and a manifest with the SHA-256 of each. Loading verifies every byte and that the parts
fit each other, so a stream is judged by what was fitted or not at all. Files go through Spark's file systems.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chanspark.functions import arrays
from chanspark.functions.naming import DESCRIPTORS
from chanspark.operators import complexity, ensembles, grid, models, panes, preprocessing, ranking, windows
from chanspark.sources import shared
from chanspark.streaming import engine, machine

FILES = ("preprocessing.json", "features.json", "model.json", "settings.json")
MANIFEST = "manifest.json"


@dataclass
class Bundle:
    """features: places in the vector of selected channels' descriptors; model: what they are given to; settings: window, step and filters."""

    preprocessing: preprocessing.Fitted
    features: list[int]
    scores: list[float]
    model: ensembles.Forest
    settings: dict

    def check(self) -> Bundle:
        """Raises ValueError if the parts don't fit each other."""
        own = self.preprocessing
        if not own.selected:
            raise ValueError("no channel is selected")
        if not len(own.selected) == len(own.mean) == len(own.std):
            raise ValueError("the scaler and the selected channels differ in length")
        if min(own.selected) < 0 or max(own.selected) >= own.width:
            raise ValueError("a selected channel is outside of the vector")
        if min(own.std) <= 0:
            raise ValueError("a selected channel has no deviation above 0")
        if not self.features or min(self.features) < 0 or max(self.features) >= len(DESCRIPTORS) * len(own.selected):
            raise ValueError("a selected feature is outside of the descriptors")
        if self.model.width != len(self.features):
            raise ValueError(f"the model takes {self.model.width} features, {len(self.features)} are selected")
        return self

    def engine(self, rules: dict | None = None) -> engine.Settings:
        """The settings of the streaming engine that judges with this bundle; classes must be those of the state machine, or fewer."""
        own, judge, have = self.preprocessing, self.model.local(), list(self.model.classes)

        def classify(vector: np.ndarray) -> list[float]:
            p = dict(zip(have, judge(vector[None])[0].tolist(), strict=True))
            return [p.get(c, 0.0) for c in arrays.CLASSES]

        return engine.Settings(own.width, own.mean, own.std, own.selected, self.features, classify, **self.settings, rules=rules or machine.config())


def feature_rows(packets: DataFrame, keys: list[str], order: list[str], array: str, label: str, fitted: preprocessing.Fitted, size: int, step: int) -> DataFrame:
    """(keys, label, window_index, features, sample_id): the descriptors of the selected, scaled channels over each stream's windows."""
    scaled = preprocessing.transform(packets, array, fitted)
    long = scaled.select(*keys, label, *order, F.posexplode("z").alias("channel", "x"))
    described = panes.describe_all(long, [*keys, label, "channel"], order, "x", [(size, step)]).drop("size", "step")
    return windows.feature_vectors(described, [*keys, label, "channel"], "channel")


def chosen_features(rows: DataFrame, features: str, label: str, top_k: int | None) -> list[tuple[int, float]]:
    """(place, score) of the best features by Fisher's criterion, the best first; a row a feature comes to the driver."""
    scores = ranking.fisher_scores(rows.select(label, F.posexplode(features).alias("feature", "x")), label, "feature", "x", arrays.EPS)
    best = scores.orderBy(F.desc("score"), "feature")
    return [(r["feature"], r["score"]) for r in (best.limit(top_k) if top_k else best).collect()]


def picked(rows: DataFrame, features: str, places: list[int]) -> DataFrame:
    return rows.withColumn(features, F.transform(F.array(*map(F.lit, places)), lambda i: F.get(F.col(features), i)))


def fit_all(packets: DataFrame, keys: list[str], order: list[str], array: str, label: str, width: int, spec: grid.Spec, size: int, step: int, threshold: float = 0.95, seed: int = 2026, filters: dict | None = None) -> Bundle:
    """The final fit, on all streams: preprocessing, windows, selection and a forest, boosting or exact tree.

    filters: radius, sigmas, width and context of the engine that is to judge with the bundle; the packets of the fit
    should have gone through the same ones.
    """
    fitted = preprocessing.fit(packets, array, width, threshold)
    rows = feature_rows(packets, keys, order, array, label, fitted, size, step).persist()
    try:
        best = chosen_features(rows, "features", label, spec.top_k)
        train = picked(rows, "features", [f for f, _ in best]).select("features", F.col(label).alias("label"))
        model, _ = grid.fitted(spec, seed, train, ensembles.classes_of(train, "label"), len(best))
    finally:
        rows.unpersist()
    if not isinstance(model, ensembles.Forest):
        raise ValueError(f"a bundle has no place for a model of kind {spec.kind}")
    return Bundle(fitted, [f for f, _ in best], [s for _, s in best], model, {"size": size, "step": step, **(filters or {})}).check()


def _contents(bundle: Bundle) -> dict[str, bytes]:
    model = {"classes": bundle.model.classes, "width": bundle.model.width, "start": bundle.model.start, "trees": [asdict(t) for t in bundle.model.trees]}
    parts = (asdict(bundle.preprocessing), {"features": bundle.features, "scores": bundle.scores}, model, bundle.settings)
    return {name: json.dumps(part, sort_keys=True).encode() for name, part in zip(FILES, parts, strict=True)}


def save(spark: SparkSession, bundle: Bundle, folder: str) -> dict[str, str]:
    """Writes a bundle, the manifest last, and gives the SHA-256 of its files."""
    files = _contents(bundle.check())
    digests = {name: sha256(content).hexdigest() for name, content in files.items()}
    for name, content in [*files.items(), (MANIFEST, json.dumps(digests, sort_keys=True).encode())]:
        fs, path = shared._path(spark, f"{folder}/{name}")
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()
    return digests


def load(spark: SparkSession, folder: str) -> Bundle:
    """The bundle of a folder. ValueError if a file is missing or isn't what the manifest says, or if the parts don't fit."""
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "content").collect()}
    if MANIFEST not in found:
        raise ValueError(f"{folder} has no manifest")
    digests = json.loads(found[MANIFEST])
    for name in FILES:
        if name not in found or name not in digests:
            raise ValueError(f"{folder} lacks {name}")
        if sha256(found[name]).hexdigest() != digests[name]:
            raise ValueError(f"{name} is not what was written: its SHA-256 differs")
    own, features, model, settings = (json.loads(found[name]) for name in FILES)
    forest = ensembles.Forest([ensembles.Tree(**t) for t in model["trees"]], model["classes"], model["width"], model["start"])
    return Bundle(preprocessing.Fitted(**own), features["features"], features["scores"], forest, settings).check()


@dataclass
class TwoStage:
    """first tells `none` from all else, second the other classes; each with features of its own."""

    none: object
    first: object
    second: object
    features: tuple[list[int], list[int]]

    def predict(self, rows: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """rows with the class: `none` where the first stage says so, else what the second says."""
        kept = rows.columns
        step = rows.withColumn("_all", F.col(features))
        for k, (predict, places) in enumerate(zip((self.first, self.second), self.features, strict=True)):
            own = predict(step.withColumn("features", F.transform(F.array(*map(F.lit, places)), lambda i: F.get(F.col("_all"), i))))
            step = own.withColumnRenamed("prediction", f"_p{k}").drop("probability")
        told = models.two_stage(F.when(F.col("_p0") == 0, F.lit(self.none)).otherwise(F.col("_p1")), F.col("_p1"), self.none)
        return step.withColumn(out, told).withColumn(features, F.col("_all")).select(*kept, out)


def fit_two_stage(rows: DataFrame, none: object, spec: grid.Spec, classes: list, seed: int = 0) -> TwoStage:
    """Of (features, label): the first stage is fitted on all rows, the second on those of another class than `none`."""
    marked = rows.where(F.col("label").isNotNull()).select("features", "label", F.when(F.col("label") == F.lit(none), 0).otherwise(1).alias("some"))
    best = chosen_features(marked, "features", "some", spec.top_k)
    first = picked(marked, "features", [f for f, _ in best]).select("features", F.col("some").alias("label"))
    _, tell = grid.fitted(spec, seed, first, [0, 1], len(best))
    others = marked.where("some = 1")
    own = chosen_features(others, "features", "label", spec.top_k)
    second = picked(others, "features", [f for f, _ in own]).select("features", "label")
    _, which = grid.fitted(spec, seed, second, [c for c in classes if c != none], len(own))
    return TwoStage(none, tell, which, ([f for f, _ in best], [f for f, _ in own]))


def of_bundle(bundle: Bundle, rows: DataFrame, features: str = "features") -> DataFrame:
    """How complex its model is, by rows of its selected features."""
    return complexity.of_forest(bundle.model, rows, features, grid.COMPLEXITY_ROWS)
