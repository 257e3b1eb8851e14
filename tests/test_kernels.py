"""Small cases with known answers, edges and the semantics that are easy to get wrong."""

import math
import random
import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from chanspark.functions import arrays, naming
from chanspark.operators import channels, metrics, models, signal, splits, windows


def _series(spark, values, key="k"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, i int, x double")


def _column(df, name):
    return [r[name] for r in df.orderBy("k", "i").collect()]


def _median_filter(x, radius):
    padded = np.concatenate([[x[0]] * radius, x, [x[-1]] * radius])
    return np.array([np.median(padded[i : i + 2 * radius + 1]) for i in range(len(x))])


def test_hampel_against_numpy(spark):
    random.seed(3)
    for n in (1, 2, 3, 7, 40):
        x = np.array([random.gauss(0, 1) if i % 9 else 50.0 for i in range(n)])
        med = _median_filter(x, 5)
        dev = np.abs(x - med)
        mad = 1.4826 * _median_filter(dev, 5)
        want = np.where((mad > 0) & (dev > 3 * mad) & (n >= 3), med, x)
        assert np.allclose(_column(signal.hampel(_series(spark, x), ["k"], ["i"], "x"), "clean"), want)
        cut = []
        for i in range(n):
            w = x[max(0, i - 5) : i + 6]
            m = np.median(w)
            s = 1.4826 * np.median(np.abs(w - m))
            cut.append(m if s > 0 and abs(x[i] - m) > 3 * s else x[i])
        assert np.allclose(_column(signal.hampel(_series(spark, x), ["k"], ["i"], "x", edges="truncate"), "clean"), cut)
    assert _column(signal.hampel(_series(spark, [4.0] * 9), ["k"], ["i"], "x"), "clean") == [4.0] * 9


def test_averages(spark):
    df = _series(spark, [1, 2, 6, 3])
    assert _column(signal.moving_average(df, ["k"], ["i"], "x", 3), "smooth") == [1.5, 3.0, 11 / 3, 4.5]
    assert np.allclose(_column(signal.moving_average(df, ["k"], ["i"], "x", 3, "nearest"), "smooth"), [4 / 3, 3, 11 / 3, 4])
    assert np.allclose(_column(signal.moving_average(df, ["k"], ["i"], "x", 5, "nearest"), "smooth"), [11 / 5, 13 / 5, 3, 17 / 5])
    assert _column(signal.moving_average(df, ["k"], ["i"], "x", 1), "smooth") == [1, 2, 6, 3]


def test_gaps_wrap_and_restart(spark):
    s = [4294967294, 4294967295, 0, 4, 4, 2, 3]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(s)], "k string, i int, s long")
    assert signal.sequence_gaps(df, ["k"], ["i"], "s").first()["gaps"] == 3
    times = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 3.0), ("b", 0, 5.0), ("c", 0, -1.0)], "k string, i int, t double")
    assert {r["k"]: (r["duration"], r["rate"]) for r in signal.sampling_rate(times, ["k"], ["i"], "t").collect()} == {"a": (2.0, 0.5), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_windows(spark):
    for n in (0, 3, 4, 5, 9, 12):
        df = spark.createDataFrame([("k", i, float(i * i)) for i in range(n)], "k string, i int, x double")
        hopped = windows.hop(df, ["k"], ["i"], 4, 3).collect()
        want = {(s // 3, p) for s in range(0, n, 3) if s + 4 <= n for p in range(s, s + 4)}
        assert {(r["window_index"], r["pos"]) for r in hopped} == want and len(hopped) == len(want)
        count = windows.window_counts(df, ["k"], 4, 3).collect()
        assert not n or count[0]["windows"] == len({w for w, _ in want})
    row = windows.describe(windows.hop(_series(spark, [1, 3, 2, 6]), ["k"], ["i"], 4, 1), ["k"], "x").first()
    x, d = np.array([1, 3, 2, 6.0]), np.array([2, -1, 4.0])
    want = [x.mean(), x.std(), 1, 6, 5, (x * x).sum(), np.abs(d).mean(), 4, (d * d).sum(), d.std(), np.polyfit(range(4), x, 1)[0]]
    assert np.allclose([row[c] for c in naming.DESCRIPTORS], want)
    one = windows.describe(windows.hop(_series(spark, [5]), ["k"], ["i"], 1, 1), ["k"], "x").first()
    assert one["slope"] == one["std_diff"] == one["mean_abs_diff"] == 0


def test_correlations_and_pruning(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    x[:, 3] = -x[:, 0] * 2 + 1e-3 * x[:, 1]
    x[:, 4] = 7
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0, 2.0],), ([float("nan")] * 5,)], "v array<double>").repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in channels.correlations(df, "v", 5).collect()}
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.abs(np.corrcoef(x.T)))
    assert all(math.isclose(got[a, b], want[a, b], abs_tol=1e-9) for a in range(5) for b in range(a + 1, 5))
    pairs = channels.correlations(df, "v", 5)
    assert channels.prune(pairs, [0, 1, 2, 3], 0.95) == [0, 1, 2] and channels.prune(pairs, [1, 3], 1.0) == [1, 3]


def test_metrics(spark):
    rows = [("e", "e")] * 3054 + [("e", "s")] * 324 + [("e", "m")] * 8 + [("s", "e")] * 792 + [("s", "s")] * 2291 + [("s", "m")] * 271 + [("m", "e")] * 13 + [("m", "s")] * 176 + [("m", "m")] * 3181
    found = metrics.overall(metrics.per_class(spark.createDataFrame(rows, "t string, p string"), "t", "p")).first()
    assert round(found["accuracy"], 4) == 0.8433  # the published confusion matrix and accuracy
    scores = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1), (0, None)]
    df = spark.createDataFrame(scores, "y int, s double")
    full = [(y, s) for y, s in scores if s is not None]
    pairs = [(a, b) for y, a in full if y for z, b in full if not z]
    assert math.isclose(metrics.auc(df, F.col("y") == 1, "s").first()["auc"], sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    assert math.isclose(metrics.average_precision(df, F.col("y") == 1, "s").first()["average_precision"], (1 / 2 + 2 / 3 + 3 / 5) / 3)
    assert math.isnan(metrics.auc(df.where("y = 1"), F.col("y") == 1, "s").first()["auc"])
    runs = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 2.0)], "m string, x double")
    assert {r["m"]: (r["x_mean"], r["x_std"]) for r in metrics.summarise(runs, ["m"], ["x"]).collect()} == {"a": (2.0, 1.0), "b": (2.0, 0.0)}
    assert {r["m"]: r["x_std"] for r in metrics.summarise(runs, ["m"], ["x"], ddof=1).collect()} == {"a": 2**0.5, "b": 0.0}


def test_policy_prefers_the_second_metric_within_reach(spark):
    rows = [("boosting", 0.8409, 0.9247), ("trees", 0.8402, 0.9318), ("poor", 0.7, 0.99)]
    got = metrics.by_policy(spark.createDataFrame(rows, "name string, f1 double, movement double"), "f1", 0.005, [F.desc("movement")], [F.desc("f1")], "name").orderBy("position").collect()
    assert [r["name"] for r in got] == ["trees", "boosting", "poor"] and [r["selected_by_policy"] for r in got] == [True, False, False]


def test_columns(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(naming.packets_of(F.lit(0.25), F.lit(50.0))) == 12 and get(naming.packets_of(F.lit(0.01), F.lit(50.0))) == 2
    assert get(naming.feature_channel(F.lit(829))) == 75 and get(naming.feature_name(F.lit(829))) == "peak_to_peak"
    assert get(naming.label(F.lit(" Presence "))) == "static_presence" and get(naming.label(F.lit("x"))) is None
    assert get(naming.label_of_path(F.lit("/a/quad1/other/movement_1.bin"))) == "movement"
    assert get(naming.safe_name(F.lit("a b/ü c!"))) == "a_b_c" and get(naming.safe_name(F.lit("!!"))) == "unnamed"
    assert get(arrays.winner(F.array(*map(F.lit, [0.4, 0.4, 0.2])))) == "empty"
    assert get(arrays.amplitude(F.array(F.lit(3)), F.array(F.lit(4), F.lit(1)))) == [5.0]
    assert get(arrays.is_valid(F.array(F.lit(0.0)))) is False and get(arrays.is_valid(F.array(F.lit(1.0), F.lit(float("nan"))))) is False
    assert get(arrays.block_of(F.lit(66), 67)) == 3


def test_splits(spark):
    rows = spark.createDataFrame([(f"f{i}", "ab"[i % 2] if i < 20 else "lone") for i in range(21)], "f string, label string")
    once, again = (splits.stratified(rows, ["label"], "f", 0.2, seed=5).orderBy("f").collect() for _ in range(2))
    assert once == again
    assert {k: sum(r["part"] == "test" for r in once if r["label"] == k) for k in ("a", "b", "lone")} == {"a": 2, "b": 2, "lone": 0}
    train, test = splits.hold_out(rows, "label", "a")
    assert (train.count(), test.count()) == (11, 10)


def _tree(x, y, depth):
    """A plain recursive tree: label, or (feature, threshold, left, right)."""
    counts = {v: y.count(v) for v in sorted(set(y))}
    label, gini = max(counts, key=counts.get), lambda part: len(part) - sum(part.count(v) ** 2 for v in set(part)) / len(part)
    best = None
    if depth and len(counts) > 1:
        for f in range(len(x[0])):
            values = sorted({r[f] for r in x})
            for a, b in zip(values, values[1:], strict=False):
                t = (a + b) / 2
                cost = round(gini([v for r, v in zip(x, y, strict=True) if r[f] <= t]), 9) + gini([v for r, v in zip(x, y, strict=True) if r[f] > t])
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, t)
    if best is None or best[0] >= gini(y) - 1e-9:
        return label
    _, f, t = best
    sides = [[(r, v) for r, v in zip(x, y, strict=True) if (r[f] <= t) == left] for left in (True, False)]
    return (f, t, *[_tree([r for r, _ in s], [v for _, v in s], depth - 1) for s in sides])


def _plain(node):
    return node.label if node.left is None else (node.feature, node.threshold, _plain(node.left), _plain(node.right))


def test_tree_is_exact(spark):
    random.seed(2)
    x = [[float(random.randint(0, 6)), float(random.randint(0, 6)), random.random()] for _ in range(80)]
    y = ["a" if r[0] > 3 else "b" if r[1] + r[2] > 3 else "c" for r in x]
    df = spark.createDataFrame(list(zip(x, y, strict=True)), "f array<double>, y string")
    root = models.fit_tree(df, "f", "y", 3, max_depth=3)
    assert _plain(root) == _tree(x, y, 3)
    assert df.where(models.tree_column(root, "f") == F.col("y")).count() >= 76
    assert len(models.nodes(root)) == 2 * root.leaves() - 1
    assert models.fit_tree(df.where("y = 'a'"), "f", "y", 3).label == "a"


def test_neighbours_either_way(spark, monkeypatch):
    random.seed(4)
    rows = [(i, [random.random(), random.random()], random.choice("ab")) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y string")
    want = {}
    for i, v, _ in rows[:10]:
        near = sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2, j, y) for j, w, y in rows if j != i)[:3]
        want[i] = max(sorted({y for *_, y in near}), key=[y for *_, y in near].count)
    for limit in (100, 0):
        monkeypatch.setattr(models, "BROADCAST_QUERIES", limit)
        assert {r["id"]: r["predicted"] for r in models.nearest_vote(df.where("id < 10"), df, "id", "v", "y", 3, block=4).collect()} == want


def test_rest_stands_without_the_llm_folders(tmp_path):
    """What the driver does: both folders and the pipeline go, and the registry must still import."""
    import shutil
    from pathlib import Path

    repo = Path(__file__).parent.parent
    shutil.copytree(repo / "chanspark", tmp_path / "chanspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'fisher_topk' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_hampel_over_batches(spark, monkeypatch):
    """Streams longer than what a task holds, short ones, missing values, and more columns."""
    monkeypatch.setattr(signal, "MOST", 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        rng = np.random.default_rng(8)
        streams = {k: [None if k == "gaps" and i % 7 == 3 else float(v) if i % 11 else 40.0 for i, v in enumerate(rng.normal(size=n))] for k, n in (("a", 200), ("b", 1), ("c", 2), ("d", 31), ("e", 500), ("gaps", 90), (None, 44))}
        rows = [(k, i, v, "kept") for k, own in streams.items() for i, v in enumerate(own)]
        df = spark.createDataFrame(rows, "k string, i int, x double, other string").repartition(5)
        for edges in ("nearest", "truncate"):
            got = {(r["k"], r["i"]): r["clean"] for r in signal.hampel(df, ["k"], ["i"], "x", 3, edges=edges).collect()}
            assert len(got) == len(rows)
            for k, own in streams.items():
                x = np.array([np.nan if v is None else v for v in own])
                n = len(x)
                at = [np.clip(np.arange(i - 3, i + 4), 0, n - 1) if edges == "nearest" else np.arange(max(0, i - 3), min(n, i + 4)) for i in range(n)]
                median = np.array([np.nanmedian(x[a]) for a in at])
                scale = np.array([np.nanmedian(np.abs(x - median)[a] if edges == "nearest" else np.abs(x[a] - median[i])) for i, a in enumerate(at)]) * 1.4826
                want = [m if s > 0 and abs(v - m) > 3 * s and (n >= 3 or edges != "nearest") else v for v, m, s in zip(x.tolist(), median.tolist(), scale.tolist(), strict=True)]
                assert np.allclose([np.nan if got[k, i] is None else got[k, i] for i in range(n)], want, equal_nan=True), (k, edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
