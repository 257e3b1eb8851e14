"""Ensembles that Spark ML doesn't have: extremely randomised trees, and gradient boosting of many classes with one loss.

Trees grow a level at a time, all of them in one aggregation: tasks route their rows through the trees so far in NumPy
and give sums by tree and node, which Spark adds up. What comes to the driver is the best split of each open node, and
the ranges of the features that a node draws, of at most NODES nodes at a time; models have a bounded size by their
parameters. Lost executors cost what they had: nothing is kept but cached input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Open nodes whose splits are looked for in one pass.
NODES = 20_000
_M = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Tree:
    """Nodes by place; number 1 is the root, 2 n and 2 n + 1 the children of n; a leaf has feature -1. value: class weights of a forest's leaf, or [score]."""

    number: list[int] = field(default_factory=lambda: [1])
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[list[float]] = field(default_factory=lambda: [[]])

    def split(self, at: int, feature: int, threshold: float) -> int:
        """Makes a leaf an inner node; the place of its left child, after which comes the right one."""
        self.feature[at], self.threshold[at], self.left[at] = feature, threshold, len(self.number)
        for side in (0, 1):
            self.number.append(2 * self.number[at] + side)
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.value.append([])
        return self.left[at]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int64), np.array(self.threshold), np.array(self.left, np.int64)

    def depth(self) -> int:
        return max(n.bit_length() for n in self.number) - 1


def _routed(arrays: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The place of the leaf that each row of x gets to: at most the threshold goes left."""
    feature, threshold, left = arrays
    at = np.zeros(len(x), np.int64)
    moving = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        node = at[moving]
        at[moving] = left[node] + (x[moving, feature[node]] > threshold[node])
        moving = moving[feature[at[moving]] >= 0]
    return at


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _vectors(rows: DataFrame, features: str, label: str, classes: list, width: int) -> DataFrame:
    """(x, y): vectors of `width` values and the number of their class; others, and rows of another class, are left out."""
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    own = rows.where(F.col(label).isNotNull() & (F.size(features) == width)).select(F.col(features).cast("array<double>").alias("x"), y.alias("y"))
    return own.where((F.col("y") >= 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))


def classes_of(rows: DataFrame, label: str) -> list:
    """The classes in order; ValueError if no row has one."""
    found = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())  # classes are few
    if not found:
        raise ValueError("no row has a label")
    return found


@dataclass
class Forest:
    """Trees whose leaves vote: as the shares of the classes in a leaf (forest), or by scores that add up (boosting)."""

    trees: list[Tree]
    classes: list
    width: int
    #: Of boosting: the scores at the start, and which class a tree adds to.
    start: list[float] | None = None

    def _each(self, features: str, kind: str, run) -> Column:
        """run(matrix, arrays of the trees) as a column; null for vectors of another width or with a missing value."""
        arrays, width = [t.arrays() for t in self.trees], self.width

        @F.arrow_udf(kind)
        def column(values: pa.Array) -> pa.Array:
            good = np.zeros(len(values), bool)
            good[values.is_valid().to_numpy(zero_copy_only=False)] = True
            good &= np.asarray(values.value_lengths().fill_null(0)) == width
            x = _matrix(values.filter(pa.array(good)), width)
            finite = ~np.isnan(x).any(axis=1)
            good[np.flatnonzero(good)[~finite]] = False
            out = [None] * len(values)
            found = run(x[finite], arrays)
            for i, v in zip(np.flatnonzero(good).tolist(), found.tolist(), strict=True):
                out[i] = v
            return pa.array(out, pa.list_(pa.float64()) if kind.startswith("array") else pa.float64())

        return column(F.col(features).cast("array<double>"))

    def local(self):
        """A function from a matrix of vectors to the probabilities of the classes, for use in tasks."""
        if self.start is not None:
            scores = self.scorer()
            return lambda x: softmax(scores(x))
        arrays, k = [t.arrays() for t in self.trees], len(self.classes)
        shares = [np.array([np.array(v) / sum(v) if f < 0 else np.zeros(k) for v, f in zip(t.value, t.feature, strict=True)]) for t in self.trees]
        return lambda x: sum((s[_routed(a, x)] for s, a in zip(shares, arrays, strict=True)), np.zeros((len(x), k))) / len(arrays)

    def probabilities(self, features: str) -> Column:
        """The probabilities of the classes, in their order."""
        judge = self.local()
        return self._each(features, "array<double>", lambda x, arrays: judge(x))

    def scorer(self):
        """A function from vectors to the boosted scores of each class."""
        arrays, values = [t.arrays() for t in self.trees], [np.array([v[0] if v else 0.0 for v in t.value]) for t in self.trees]
        start, k = np.array(self.start), len(self.classes)

        def run(x: np.ndarray) -> np.ndarray:
            out = np.tile(start, (len(x), 1))
            for i, (a, v) in enumerate(zip(arrays, values, strict=True)):
                out[:, i % k] += v[_routed(a, x)]
            return out

        return run

    def comparisons(self, features: str) -> Column:
        """How many thresholds a vector is held against by all trees."""
        depths = [np.array([n.bit_length() - 1 for n in t.number]) for t in self.trees]
        return self._each(features, "double", lambda x, arrays: sum((d[_routed(a, x)] for d, a in zip(depths, arrays, strict=True)), np.zeros(len(x))))

    def paths(self, features: str) -> Column:
        """The nodes that a vector goes through, counted through all trees."""
        above = []
        for t in self.trees:
            place = {n: i for i, n in enumerate(t.number)}
            above.append([[place[n >> k] for k in range(n.bit_length())] for n in t.number])
        first = np.cumsum([0] + [len(t.number) for t in self.trees])
        listed = [[[float(first[k] + i) for i in own] for own in each] for k, each in enumerate(above)]

        def run(x: np.ndarray, arrays: list) -> np.ndarray:
            leaves = [_routed(a, x).tolist() for a in arrays]
            out = np.empty(len(x), object)
            for i in range(len(x)):
                out[i] = [n for each, at in zip(listed, leaves, strict=True) for n in each[at[i]]]
            return out

        return F.transform(self._each(features, "array<double>", run), lambda n: n.cast("long"))

    def predict(self, rows: DataFrame, features: str, out: str = "prediction", probabilities: str = "probability") -> DataFrame:
        """rows with the probabilities and the likeliest class, the first of equal ones; null where a vector isn't valid."""
        p = F.col(probabilities)
        known = F.array(*[F.lit(c) for c in self.classes])
        return rows.withColumn(probabilities, self.probabilities(features)).withColumn(out, F.when(p.isNotNull(), F.element_at(known, F.array_position(p, F.array_max(p)).cast("int"))))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, depth, feature, threshold, left, right, is_leaf, value): a row a node; children by number, null in leaves."""
        rows = [
            (k, n, n.bit_length() - 1, f if f >= 0 else None, h if f >= 0 else None, 2 * n if f >= 0 else None, 2 * n + 1 if f >= 0 else None, f < 0, [float(x) for x in v] if f < 0 else None)
            for k, t in enumerate(self.trees) for n, f, h, v in zip(t.number, t.feature, t.threshold, t.value, strict=True)
        ]
        return spark.createDataFrame(rows, "tree int, node long, depth int, feature int, threshold double, left long, right long, is_leaf boolean, value array<double>")


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def draws(seed: int, tree: int, node: int, width: int, tried: int) -> tuple[np.ndarray, np.ndarray]:
    """The features that a node draws, twice as many as it tries, and a number from 0 to 1 for each; they follow from the arguments alone."""
    with np.errstate(over="ignore"):
        h = np.arange(1, width + 1, dtype=np.uint64)
        for part in (seed, tree, node):
            h = h * _M[2] + np.uint64(part & 0xFFFFFFFFFFFFFFFF)
            for m in (_M[0], _M[1]):
                h = (h ^ (h >> np.uint64(30))) * m
        h ^= h >> np.uint64(31)
        drawn = np.argsort(h, kind="stable")[: min(width, 2 * tried)]
        u = ((h * _M[0]) ^ (h >> np.uint64(29))) * _M[1]
    return drawn, ((u ^ (u >> np.uint64(32))) >> np.uint64(11))[drawn] * 2.0**-53


def _threshold(low: float, high: float, u: float) -> float:
    t = low + (high - low) * u
    return low if t >= high else t


def fit_extra_trees(rows: DataFrame, features: str, label: str, width: int, trees: int = 100, tried: int | None = None, max_depth: int = 12, min_split: int = 2, seed: int = 0, weights: dict | None = None) -> Forest:
    """Extremely randomised trees: a node draws features, of each one threshold between its least and greatest value there, and takes the best by Gini impurity.

    `tried` features count (by default the root of the width), the first drawn that vary in the node; of twice as many
    drawn. Nodes split until they are pure, have fewer than min_split rows or the greatest depth. All rows go to all
    trees. weights: of the classes, for impurity and votes. Equal costs go to the feature drawn first.
    """
    classes = classes_of(rows, label)
    tried = tried or max(1, int(width**0.5))
    many = range(len(classes))
    weigh = [float((weights or {}).get(c, 1.0)) for c in classes]
    data = _vectors(rows, features, label, classes, width).persist()
    model = Forest([Tree() for _ in range(trees)], classes, width)
    # A group of open nodes at a time: of each node whose place it is, and what it draws.
    open_nodes = [(t, 0) for t in range(trees)]

    def summed(group: list[tuple[int, int]], schema: str, kernel) -> DataFrame:
        """The rows that kernel(x, y, place in the group's nodes of the tree, first of them in group) gives for each tree."""
        arrays = [t.arrays() for t in model.trees]
        own: dict[int, list[tuple[int, int]]] = {}
        for g, (t, at) in enumerate(group):
            own.setdefault(t, []).append((at, g))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = _matrix(batch.column(0), width), batch.column(1).to_numpy()
                for t, listed in own.items():
                    which = np.full(len(arrays[t][0]), -1)
                    which[[a for a, _ in listed]] = [g for _, g in listed]
                    of = which[_routed(arrays[t], x)]
                    some = np.flatnonzero(of >= 0)
                    if len(some):
                        order = some[np.argsort(of[some], kind="stable")]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in kernel(x[order], y[order], of[order])], names)

        return data.mapInArrow(run, schema)

    try:
        while open_nodes:
            grown: list[tuple[int, int]] = []
            for start in range(0, len(open_nodes), NODES):
                group = open_nodes[start : start + NODES]
                drawn = [draws(seed, t, model.trees[t].number[at], width, tried) for t, at in group]
                chosen = np.array([d for d, _ in drawn])

                def ranges(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
                    first = np.flatnonzero(np.append(True, np.diff(of) != 0))
                    node, values = of[first], np.take_along_axis(x, chosen[of], 1)
                    j = np.tile(np.arange(chosen.shape[1]), len(node))
                    counts = np.add.reduceat(y[:, None] == np.arange(len(classes)), first, axis=0, dtype=np.int64)
                    return [np.repeat(node, chosen.shape[1]), j, np.minimum.reduceat(values, first).ravel(), np.maximum.reduceat(values, first).ravel(), *[np.where(j == 0, np.repeat(counts[:, c], chosen.shape[1]), 0) for c in many]]

                found = summed(group, "g long, j long, low double, high double" + "".join(f", c{c} long" for c in many), ranges)
                found = found.groupBy("g", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(f"c{c}").alias(f"c{c}") for c in many]).toArrow().sort_by([("g", "ascending"), ("j", "ascending")])
                g, low, high = (found.column(c).to_numpy() for c in ("g", "low", "high"))
                counts = np.array([found.column(f"c{c}").to_numpy() for c in many]).T[:: chosen.shape[1]]
                present = g[:: chosen.shape[1]].tolist()
                low, high = low.reshape(-1, chosen.shape[1]), high.reshape(-1, chosen.shape[1])
                feature, threshold = np.full((len(group), tried), -1, np.int64), np.zeros((len(group), tried))
                for i, k in enumerate(present):
                    t, at = group[k]
                    tree, n = model.trees[t], counts[i]
                    tree.value[at] = (n * weigh).tolist()
                    if n.sum() < min_split or (n > 0).sum() < 2 or tree.number[at].bit_length() - 1 >= max_depth:
                        continue
                    vary = np.flatnonzero(low[i] < high[i])[:tried]
                    feature[k, : len(vary)] = chosen[k][vary]
                    threshold[k, : len(vary)] = [_threshold(low[i, v], high[i, v], drawn[k][1][v]) for v in vary]
                wanted = [k for k in range(len(group)) if feature[k, 0] >= 0]
                if not wanted:
                    continue

                def sides(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
                    keep = feature[of, 0] >= 0
                    x, y, of = x[keep], y[keep], of[keep]
                    first = np.flatnonzero(np.append(True, np.diff(of) != 0))[: len(of)]
                    below = np.take_along_axis(x, np.maximum(feature[of], 0), 1) <= threshold[of]
                    node, sums = of[first], []
                    for side in (below, ~below):
                        sums += [np.add.reduceat(side & (y == c)[:, None], first, axis=0, dtype=np.int64).ravel() if len(of) else np.zeros(0, np.int64) for c in many]
                    return [np.repeat(node, tried), np.tile(np.arange(tried), len(node)), *sums]

                left, right = [f"l{c}" for c in many], [f"r{c}" for c in many]
                table = summed(group, "g long, j long" + "".join(f", {c} long" for c in left + right), sides)
                table = table.groupBy("g", "j").agg(*[F.sum(c).alias(c) for c in left + right])
                total = lambda names: sum((F.col(c) * F.lit(w) for c, w in zip(names, weigh, strict=True)), F.lit(0.0))
                gini = lambda names: total(names) - sum((F.col(c) * F.lit(w) * F.col(c) * F.lit(w) for c, w in zip(names, weigh, strict=True)), F.lit(0.0)) / total(names)
                whole = table.where((total(left) > 0) & (total(right) > 0)).withColumn("cost", F.round(gini(left) + gini(right), 9))
                for r in whole.groupBy("g").agg(F.min(F.struct("cost", "j")).alias("b")).collect():
                    t, at = group[r["g"]]
                    child = model.trees[t].split(at, int(feature[r["g"], r["b"]["j"]]), float(threshold[r["g"], r["b"]["j"]]))
                    grown += [(t, child), (t, child + 1)]
            open_nodes = grown
    finally:
        data.unpersist()
    for tree in model.trees:
        for at, v in enumerate(tree.value):
            if not v:
                tree.value[at] = [1.0] * len(classes)  # of a table without rows
    return model


def fit_boosting(rows: DataFrame, features: str, label: str, width: int, rounds: int = 20, max_depth: int = 3, rate: float = 0.1, bins: int = 64, min_split: int = 2, newton: bool = False, ridge: float = 1.0) -> Forest:
    """Gradient boosting with the softmax loss over all classes; a round grows a tree for each.

    Features are cut into bins at quantiles. A level's sums of gradients by class, node, feature and bin come from one
    pass over the rows of each split's smaller child; those of its sibling are its parent's less these. Trees fit
    residuals by Friedman's gain, and leaves take a Newton step; with newton the gain is that of second derivatives with a
    penalty `ridge`, too. Equal gains go to the lower feature, then the lower threshold.
    """
    classes = classes_of(rows, label)
    k = len(classes)
    data = _vectors(rows, features, label, classes, width).persist()
    try:
        counts = [r["n"] for r in data.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect()]
        cuts = data.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", [i / bins for i in range(1, bins)], 50 * bins).alias("c")).collect()
        edges = {r["f"]: np.array(sorted(set(r["c"]))) for r in cuts}
        edges = [edges.get(f, np.zeros(0)) for f in range(width)]
        model = Forest([], classes, width, [float(np.log(n / sum(counts))) for n in counts])
        for _ in range(rounds if k > 1 else 0):
            _boost(model, data, edges, max_depth, rate, min_split, newton, ridge)
    finally:
        data.unpersist()
    return model


def gradients(scores: np.ndarray, y: np.ndarray, newton: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each row and class the residual, and the weight of a Newton step."""
    p = softmax(scores)
    r = (y[:, None] == np.arange(scores.shape[1])) - p
    return r, p * (1 - p) if newton else np.abs(r) * (1 - np.abs(r))


def leaf_value(r: float, h: float, classes: int, newton: bool, ridge: float) -> float:
    if newton:
        return r / (h + ridge)
    return (classes - 1) / classes * r / h if abs(h) > 1e-150 else 0.0


def _boost(model: Forest, data: DataFrame, edges: list[np.ndarray], max_depth: int, rate: float, min_split: int, newton: bool, ridge: float) -> None:
    """Adds a round's trees to the model."""
    k, width = len(model.classes), model.width
    bins = max([len(e) for e in edges], default=0) + 1
    scores = model.scorer() if model.trees else (lambda x, start=np.array(model.start): np.tile(start, (len(x), 1)))
    trees = [Tree() for _ in range(k)]

    def sums(asked: list[tuple[int, int]]) -> DataFrame:
        """(c, node, f, b, n, r, h) of the asked (class, place) alone, by number of node."""
        arrays, numbers = [t.arrays() for t in trees], [np.array(t.number) for t in trees]
        own = {c: [at for d, at in asked if d == c] for c in {c for c, _ in asked}}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = {c: np.zeros((3, len(ats), width, bins)) for c, ats in own.items()}
            for batch in batches:
                x, y = _matrix(batch.column(0), width), batch.column(1).to_numpy()
                r, h = gradients(scores(x), y, newton)
                placed = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
                for c, ats in own.items():
                    which = np.full(len(arrays[c][0]), -1)
                    which[ats] = np.arange(len(ats))
                    of = which[_routed(arrays[c], x)]
                    some = np.flatnonzero(of >= 0)
                    for f in range(width):
                        at = of[some] * bins + placed[f][some]
                        for i, weight in enumerate((None, r[some, c], h[some, c])):
                            out[c][i, :, f] += np.bincount(at, weight, minlength=len(ats) * bins).reshape(-1, bins)
            for c, sums_ in out.items():
                node, f, b = np.nonzero(sums_[0])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.full(len(node), c), numbers[c][np.array(own[c])[node]], f, b, sums_[0, node, f, b].astype(np.int64), sums_[1, node, f, b], sums_[2, node, f, b])], ["c", "node", "f", "b", "n", "r", "h"])

        found = data.mapInArrow(run, "c long, node long, f long, b long, n long, r double, h double")
        return found.groupBy("c", "node", "f", "b").agg(*[F.sum(v).alias(v) for v in ("n", "r", "h")])

    def best(level: DataFrame) -> list:
        """A row for each class and node: its sums, and the best split if one is better than none."""
        every, upto = Window.partitionBy("c", "node", "f"), Window.partitionBy("c", "node", "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        both = level.select("c", "node", "f", "b", *[F.sum(v).over(every).alias(v) for v in ("n", "r", "h")], *[F.sum(v).over(upto).alias(f"l{v}") for v in ("n", "r", "h")])
        n, r, h, ln, lr, lh = (F.col(v) for v in ("n", "r", "h", "ln", "lr", "lh"))
        if newton:
            gain = lr * lr / (lh + ridge) + (r - lr) * (r - lr) / (h - lh + ridge) - r * r / (h + ridge)
        else:
            apart = lr / ln - (r - lr) / (n - ln)
            gain = ln * (n - ln) / n * apart * apart
        split = F.when(ln < n, F.struct(F.round(gain, 9).alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), ln.alias("n"), lr.alias("r"), lh.alias("h")))
        return both.groupBy("c", "node").agg(F.max(split).alias("s"), F.max(F.when(F.col("f") == 0, F.struct("n", "r", "h"))).alias("t")).collect()

    level, parents, kept = sums([(c, 0) for c in range(k)]), {}, []
    places = {(c, 1): 0 for c in range(k)}
    for depth in range(max_depth + 1):
        level = level.persist()
        kept.append(level)
        asked, siblings, next_places = [], [], {}
        for row in best(level):
            c, tree, at, t, s = row["c"], trees[row["c"]], places[row["c"], row["node"]], row["t"], row["s"]
            tree.value[at] = [rate * leaf_value(t["r"], t["h"], k, newton, ridge)]
            if depth == max_depth or t["n"] < min_split or s is None or s["gain"] <= 1e-9:
                continue
            child = tree.split(at, -s["f"], float(edges[-s["f"]][-s["b"]]))
            right = (t["n"] - s["n"], t["r"] - s["r"], t["h"] - s["h"])
            for side, (_, r, h) in enumerate(((s["n"], s["r"], s["h"]), right)):
                tree.value[child + side] = [rate * leaf_value(r, h, k, newton, ridge)]
                next_places[c, tree.number[child + side]] = child + side
            small = int(s["n"] > right[0])
            asked.append((c, child + small))
            siblings.append((c, row["node"], tree.number[child + small], tree.number[child + 1 - small]))
        if not asked or depth + 1 == max_depth:
            break
        few = sums(asked).persist()
        kept.append(few)
        names = data.sparkSession.createDataFrame(siblings, "c long, parent long, small long, large long")  # a row a split node
        below = level.join(F.broadcast(names), (level["c"] == names["c"]) & (F.col("node") == F.col("parent"))).select(names["c"].alias("c_"), "small", F.col("large").alias("node"), F.col("f").alias("f_"), F.col("b").alias("b_"), *[F.col(v).alias(f"p{v}") for v in ("n", "r", "h")])
        less = few.withColumnRenamed("node", "few")
        rest = below.join(less, (F.col("c_") == less["c"]) & (F.col("small") == F.col("few")) & (F.col("f_") == less["f"]) & (F.col("b_") == less["b"]), "left")
        rest = rest.select(F.col("c_").alias("c"), "node", F.col("f_").alias("f"), F.col("b_").alias("b"), *[(F.col(f"p{v}") - F.coalesce(F.col(v), F.lit(0))).alias(v) for v in ("n", "r", "h")]).where("n > 0")
        level, places = few.unionByName(rest), next_places
    for df in kept:
        df.unpersist()
    model.trees += trees
