"""Panes against hopping windows; ensembles against slow versions with the same draws; the grid stopped and started again."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chanspark.functions.naming import DESCRIPTORS
from chanspark.operators import complexity, ensembles, grid, models, panes, windows


def streams(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, int(t), float(rng.normal())) for k, n in (("hot", 400), ("b", 61), ("c", 7), (None, 40)) for t in rng.permutation(n) // 2 * 2]
    return spark.createDataFrame([(k, t, i, x) for i, (k, t, x) in enumerate(rows)] + [("b", 5, 9999, None)], "k string, t long, i long, x double")


@pytest.mark.parametrize("candidates", [[(10, 5)], [(8, 3)], [(12, 4), (20, 4), (4, 8), (40, 20)]])
def test_panes_give_the_windows(spark, candidates):
    df = streams(spark)
    found = {tuple(r)[:4]: tuple(r)[4:] for r in panes.describe_all(df, ["k"], ["t", "i"], "x", candidates).select("k", "size", "step", "window_index", *DESCRIPTORS).collect()}
    want = {}
    for size, step in candidates:
        for r in windows.describe(windows.hop(df.where("x IS NOT NULL"), ["k"], ["t", "i"], size, step), ["k"], "x").collect():
            want[r["k"], size, step, r["window_index"]] = tuple(r[c] for c in DESCRIPTORS)
    assert set(found) == set(want) and len(found) > 0
    for key, values in want.items():
        assert found[key] == pytest.approx(values, abs=1e-9), key


@pytest.mark.parametrize("runs", [1, 5, 64])
def test_places(spark, runs):
    found = {(r["k"], r["i"]): r["pos"] for r in panes.numbered(streams(spark), ["k"], ["t", "i"], runs=runs).collect()}
    rows = streams(spark).collect()
    for k in {r["k"] for r in rows}:
        own = sorted((r["t"], r["i"]) for r in rows if r["k"] == k)
        assert [found[k, i] for _, i in own] == list(range(len(own)))


def test_panes_of_nothing(spark):
    assert panes.describe_all(streams(spark).limit(0), ["k"], ["t"], "x", [(4, 2)]).count() == 0
    with pytest.raises(ValueError, match="two rows"):
        panes.describe_all(streams(spark), ["k"], ["t"], "x", [(1, 1)])


def vectors(n, width, k, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n)
    x = np.round(rng.normal(size=(n, width)) + y[:, None] * (np.arange(width) < 2) * 1.5, 1)
    x[:, -1] = 3.0  # a feature that never varies
    return x, y


def frame(spark, x, y, names=None):
    rows = [(i, [float(v) for v in r], (names or {}).get(int(c), int(c))) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i long, f array<double>, y " + ("string" if names else "int")).repartition(3)


def slow_extra_tree(x, y, k, tree, tried, max_depth, min_split, seed, weigh):
    out = {}

    def gini(counts):
        w = counts * weigh
        return w.sum() - (w * w).sum() / w.sum()

    def grow(rows, number):
        counts = np.bincount(y[rows], minlength=k)
        if len(rows) >= min_split and (counts > 0).sum() > 1 and number.bit_length() - 1 < max_depth:
            drawn, u = ensembles.draws(seed, tree, number, x.shape[1], tried)
            best, count = None, 0
            for f, v in zip(drawn.tolist(), u.tolist(), strict=True):
                low, high = x[rows, f].min(), x[rows, f].max()
                if low == high or count == tried:
                    continue
                t = low + (high - low) * v
                t = low if t >= high else t
                left = x[rows, f] <= t
                cost = round(gini(np.bincount(y[rows[left]], minlength=k)) + gini(np.bincount(y[rows[~left]], minlength=k)), 9)
                if best is None or cost < best[0]:
                    best = (cost, f, t, left)
                count += 1
            if best:
                out[number] = (best[1], best[2])
                grow(rows[best[3]], 2 * number)
                grow(rows[~best[3]], 2 * number + 1)
                return
        out[number] = tuple((counts * weigh).tolist())

    grow(np.arange(len(x)), 1)
    return out


@pytest.mark.parametrize(("weights", "group"), [(None, 20_000), ({0: 2.0, 2: 0.5}, 3)])
def test_extra_trees(spark, monkeypatch, weights, group):
    """Equal, tree by tree, to growing each one by itself; also where few nodes are looked at together."""
    monkeypatch.setattr(ensembles, "NODES", group)
    x, y = vectors(150, 6, 3, 1)
    model = ensembles.fit_extra_trees(frame(spark, x, y), "f", "y", 6, trees=3, max_depth=4, min_split=4, seed=9, weights=weights)
    weigh = np.array([(weights or {}).get(c, 1.0) for c in range(3)])
    for k, tree in enumerate(model.trees):
        want = slow_extra_tree(x, y, 3, k, 2, 4, 4, 9, weigh)
        got = {n: tuple(v) if f < 0 else (f, t) for n, f, t, v in zip(tree.number, tree.feature, tree.threshold, tree.value, strict=True)}
        assert set(got) == set(want)
        for n in want:
            assert got[n] == pytest.approx(want[n], abs=1e-9), n


def test_extra_trees_learn(spark):
    x, y = vectors(600, 8, 3, 2)
    rows = frame(spark, x, y, {0: "a", 1: "b", 2: "c"})
    model = ensembles.fit_extra_trees(rows.where("i % 4 <> 0"), "f", "y", 8, trees=15, max_depth=8)
    told = model.predict(rows.where("i % 4 = 0").unionByName(frame(spark, x[:1], y[:1], {0: "a", 1: "b", 2: "c"}).withColumn("f", F.array(F.lit(1.0)))), "f").collect()
    good = [r for r in told if r["prediction"] is not None]
    assert len(good) == len(told) - 1 and sum(r["y"] == r["prediction"] for r in good) / len(good) > 0.7
    assert all(sum(r["probability"]) == pytest.approx(1) for r in good)


def slow_boosting(x, y, k, rounds, depth, rate, bins, min_split, newton, ridge=1.0):
    n, width = x.shape
    rank = lambda p: max(int(np.ceil(p * n)) - 1, 0)
    edges = [sorted({float(np.sort(x[:, f])[rank(i / bins)]) for i in range(1, bins)}) for f in range(width)]
    scores = np.tile(np.log(np.bincount(y, minlength=k) / n), (n, 1))
    losses, trees = [], []
    for _ in range(rounds):
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(n), y]).mean())
        r = (y[:, None] == np.arange(k)) - p
        h = p * (1 - p) if newton else np.abs(r) * (1 - np.abs(r))
        step = np.zeros_like(scores)
        for c in range(k):
            tree = {}

            def grow(rows, number, c=c, tree=tree):
                rs, hs = r[rows, c].sum(), h[rows, c].sum()
                best = None
                if number.bit_length() - 1 < depth and len(rows) >= min_split:
                    for f in range(width):
                        for t in edges[f]:
                            left = x[rows, f] <= t
                            if not left.any() or left.all():
                                continue
                            lr, lh, ln = r[rows[left], c].sum(), h[rows[left], c].sum(), left.sum()
                            gain = lr**2 / (lh + ridge) + (rs - lr) ** 2 / (hs - lh + ridge) - rs**2 / (hs + ridge) if newton else ln * (len(rows) - ln) / len(rows) * (lr / ln - (rs - lr) / (len(rows) - ln)) ** 2
                            if best is None or round(gain, 9) > best[0]:
                                best = (round(gain, 9), f, t, left)
                if best and best[0] > 1e-9:
                    tree[number] = best[1:3]
                    grow(rows[best[3]], 2 * number)
                    grow(rows[~best[3]], 2 * number + 1)
                else:
                    v = rs / (hs + ridge) if newton else (k - 1) / k * rs / hs
                    tree[number] = (rate * v,)
                    step[rows, c] = rate * v

            grow(np.arange(n), 1)
            trees.append(tree)
        scores = scores + step
    return trees, losses


@pytest.mark.parametrize("newton", [False, True])
def test_boosting(spark, newton):
    """Equal to boosting with all sums taken anew, and the loss falls."""
    x, y = vectors(160, 4, 3, 3)
    model = ensembles.fit_boosting(frame(spark, x, y), "f", "y", 4, rounds=3, max_depth=3, bins=12, min_split=5, newton=newton)
    want, losses = slow_boosting(x, y, 3, 3, 3, 0.1, 12, 5, newton)
    assert losses == sorted(losses, reverse=True)
    for tree, slow in zip(model.trees, want, strict=True):
        got = {n: tuple(v) if f < 0 else (f, t) for n, f, t, v in zip(tree.number, tree.feature, tree.threshold, tree.value, strict=True)}
        assert set(got) == set(slow)
        for n in slow:
            assert got[n] == pytest.approx(slow[n], abs=1e-7), n


def test_complexity_of_spark_models(spark):
    """Nodes, depth, features and comparisons from saved nodes, against what Spark says of the model."""
    x, y = vectors(200, 5, 2, 4)
    rows = frame(spark, x, y).select("f", array_to_vector("f").alias("features"), F.col("y").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=4, maxDepth=3, seed=1).fit(rows)
    got = complexity.of_model(forest, rows, "f", 5).first()
    assert got["actual_tree_count"] == 4 and got["actual_node_count"] == forest.totalNumNodes and got["actual_max_depth"] == max(t.depth for t in forest.trees)
    read = complexity.from_nodes(complexity.saved_nodes(spark, forest), [0, 1], 5)
    told = forest.transform(rows).withColumn("p", read.probabilities("f")).select("probability", "p").collect()
    assert all(list(r["probability"]) == pytest.approx(r["p"], abs=1e-9) for r in told)
    boosted = GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(rows)
    got = complexity.of_model(boosted, rows, "f", 5).first()
    assert (got["actual_tree_count"], got["actual_node_count"]) == (3, boosted.totalNumNodes)
    linear = models.estimator("logistic_regression").fit(rows)
    got = complexity.of_model(linear, rows, "f", 5).first()
    assert got["actual_tree_count"] == 0 and got["used_feature_count"] == 4 and got["mean_comparisons_per_prediction"] == 5.0


def test_counts_through_nodes(spark):
    x, y = vectors(120, 4, 3, 5)
    rows = frame(spark, x, y)
    model = ensembles.fit_extra_trees(rows, "f", "y", 4, trees=2, max_depth=3)
    through = {(r["tree"], r["node"]): r["rows"] for r in complexity.routed(model, rows, "f").collect()}
    inner = sum(n for (t, k), n in through.items() if model.trees[t].feature[model.trees[t].number.index(k)] >= 0)
    assert all(through[t, 1] == 120 for t in (0, 1))
    assert complexity.of_forest(model, rows, "f").first()["mean_comparisons_per_prediction"] == pytest.approx(inner / 120)


KINDS = [
    grid.Spec("dt", "tree", "decision_tree", {"max_depth": 2}), grid.Spec("rf", "forest", "random_forest", {"numTrees": 3}, 3), grid.Spec("et", "forest", "extra_trees", {"trees": 3}, 2),
    grid.Spec("gb", "boosting", "gradient_boosting", {"rounds": 2, "max_depth": 2}), grid.Spec("lr", "linear", "logistic_regression"), grid.Spec("svm", "linear", "linear_svm", {"maxIter": 5}, 4),
]


def test_grid_goes_on(spark, tmp_path):
    x, y = vectors(240, 5, 3, 6)
    classes, made = ["a", "b", "c"], []

    def prepare(seed):
        made.append(seed)
        rows = frame(spark, x, y, dict(enumerate(classes)))
        return grid.Split(rows.select(F.when((F.col("i") + seed) % 4 == 0, "test").otherwise("train").alias("part"), (F.col("i") % 7).alias("group"), F.col("i").alias("window_id"), F.col("y").alias("label"), F.col("f").alias("features")), 5, 5)

    first = grid.Grid(spark, f"file://{tmp_path}/g", classes)
    assert first.run([1], KINDS[:2], 4, 2, prepare) == 2
    # A run that was stopped: its predictions are there, its row isn't.
    broken = KINDS[2].run(1, 4, 2)
    spark.range(1).selectExpr("id AS window_id").write.parquet(f"file://{tmp_path}/g/predictions/run={broken}")
    second = grid.Grid(spark, f"file://{tmp_path}/g", classes)
    assert {s.name for _, s in second.left([1], KINDS, 4, 2)} == {"et", "gb", "lr", "svm"}
    assert second.run([1, 2], KINDS, 4, 2, prepare) == 10 and made == [1, 2]
    assert second.run([1, 2], KINDS, 4, 2, prepare) == 0

    told = second.predictions().collect()
    assert len(told) == 12 * 60 and {r["model_name"] for r in told} == {s.name for s in KINDS}
    for m in second.metrics().collect():
        own = [r for r in told if r["run"] == m["run"]]
        true, said = [r["true_class"] for r in own], [r["predicted_class"] for r in own]
        p = np.array([r["probability"] for r in own])
        assert np.allclose(p.sum(axis=1), 1) and m["test_samples"] == 60
        assert m["accuracy"] == pytest.approx(np.mean([a == b for a, b in zip(true, said, strict=True)]))
        f1 = [2 * sum(a == b == c for a, b in zip(true, said, strict=True)) / max(1, true.count(c) + said.count(c)) for c in classes if true.count(c) + said.count(c)]
        assert m["macro_f1"] == pytest.approx(np.mean(f1))
        areas = []
        for k, c in enumerate(classes):
            pos, neg = p[[t == c for t in true], k], p[[t != c for t in true], k]
            areas.append(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
        assert m["roc_auc_ovr_macro"] == pytest.approx(np.mean(areas))
        assert m["selected_feature_count"] == (next(s.top_k for s in KINDS if s.name == m["model_name"]) or 5)
        assert m["fit_time_ms"] > 0 and m["train_windows"] == 180 and m["train_files"] == 7
    assert second.confusion().groupBy("run").agg(F.sum("count")).collect() == [*second.confusion().groupBy("run").agg(F.sum("count")).collect()]
    assert {r["n"] for r in second.confusion().groupBy("run").agg(F.count("*").alias("n")).collect()} == {9}
    assert second.selection().where("model_name = 'rf'").count() == 6
