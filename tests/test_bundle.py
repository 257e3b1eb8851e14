"""The final fit, its bundle and what loading refuses; two-stage models; the kernel machine."""

import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chanspark.functions.arrays import CLASSES
from chanspark.operators import bundle, grid, models
from chanspark.streaming import engine

WIDTH = 6
SPEC = grid.Spec("et", "forest", "extra_trees", {"trees": 4, "max_depth": 4}, 7)
STREAMS = "stream_id string, sequence long, seconds double, amplitude array<double>"


def _packets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(9):
        label = CLASSES[k % 3]
        for i in range(60):
            v = rng.normal(10 + 3 * (k % 3), 1 + k % 3, WIDTH)
            v[4] = v[0] * 2  # says nothing that channel 0 doesn't
            v[5] = 1.0  # says nothing at all
            rows.append((f"s{k}", label, i, i / 50, v.tolist()))
    return spark.createDataFrame(rows, "stream_id string, label string, sequence long, seconds double, amplitude array<double>")


@pytest.fixture(scope="module")
def fitted(spark):
    return bundle.fit_all(_packets(spark), ["stream_id"], ["sequence"], "amplitude", "label", WIDTH, SPEC, 20, 10, filters={"radius": 0, "width": 1, "context": 0})


def test_a_bundle_says_the_same_in_a_new_session(spark, fitted, tmp_path):
    assert fitted.preprocessing.selected == [0, 1, 2, 3] and len(fitted.features) == 7
    folder = f"file://{tmp_path}/b"
    digests = bundle.save(spark, fitted, folder)
    assert set(digests) == set(bundle.FILES) and json.loads((tmp_path / "b/manifest.json").read_text()) == digests
    packets = _packets(spark)
    want = engine.run(packets.select(*[c.split()[0] for c in STREAMS.split(", ")]), fitted.engine()).select("stream_id", "window_start", "raw_state", "stable_state", "confidence").collect()
    packets.write.parquet(f"{tmp_path}/packets")
    code = f"""
from conftest import session
from chanspark.operators import bundle
from chanspark.streaming import engine
spark = session()
own = bundle.load(spark, {folder!r})
found = engine.run(spark.read.parquet({str(tmp_path / "packets")!r}).select("stream_id", "sequence", "seconds", "amplitude"), own.engine())
found.select("stream_id", "window_start", "raw_state", "stable_state", "confidence").coalesce(1).write.parquet({str(tmp_path / "out")!r})
"""
    tests = Path(__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=tests.parent, env=os.environ | {"PYTHONPATH": f"{tests.parent}:{tests}"}, check=True, capture_output=True)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want) and len(want) == 9 * 5
    right = {r["stream_id"]: r["raw_state"] == CLASSES[int(r["stream_id"][1:]) % 3] for r in want}
    assert sum(right.values()) >= 8


def test_windows_of_the_fit_are_those_of_the_engine(spark, fitted):
    """The features that the model was fitted on are what the engine computes."""
    packets = _packets(spark)
    rows = bundle.feature_rows(packets, ["stream_id"], ["sequence"], "amplitude", "label", fitted.preprocessing, 20, 10)
    told = bundle.picked(rows, "features", fitted.features)
    own = {(r["stream_id"], r["window_index"] * 10): r["prediction"] for r in fitted.model.predict(told, "features").collect()}
    streamed = engine.run(packets.select("stream_id", "sequence", "seconds", "amplitude"), fitted.engine()).collect()
    assert {(r["stream_id"], r["window_start"]): r["raw_state"] for r in streamed} == own


@pytest.mark.parametrize("name", [*bundle.FILES, bundle.MANIFEST])
def test_a_changed_byte_is_an_error(spark, fitted, tmp_path, name):
    bundle.save(spark, fitted, f"file://{tmp_path}/b")
    path = tmp_path / "b" / name
    (tmp_path / "b" / f".{name}.crc").unlink(missing_ok=True)
    raw = bytearray(path.read_bytes())
    at = raw.index(b"1" if b"1" in raw else b"a")
    raw[at] ^= 1
    path.write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        bundle.load(spark, f"file://{tmp_path}/b")
    path.unlink()
    with pytest.raises(ValueError):
        bundle.load(spark, f"file://{tmp_path}/b")


def test_parts_must_fit(fitted):
    from copy import deepcopy

    for part, field, value in (("preprocessing", "selected", []), ("preprocessing", "selected", [0, 1, 2, 99]), ("preprocessing", "std", [0.0] * 4), ("preprocessing", "mean", [1.0]), (None, "features", [0, 1]), (None, "features", [400] * 7)):
        broken = deepcopy(fitted)
        setattr(getattr(broken, part) if part else broken, field, value)
        with pytest.raises(ValueError):
            broken.check()


def test_two_stages(spark):
    """Each stage has the features that tell its classes apart."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        c = i % 3
        v = rng.normal(0, 1, 6)
        v[2] += 4 * (c > 0)
        v[4] += 4 * (c == 2)
        rows.append((i, v.tolist(), "none" if c == 0 else "ab"[c - 1]))
    df = spark.createDataFrame(rows, "i int, features array<double>, label string")
    model = bundle.fit_two_stage(df.where("i % 5 > 0"), "none", grid.Spec("t", "tree", "decision_tree", {"max_depth": 2}, 1), ["none", "a", "b"])
    assert model.features == ([2], [4])
    told = model.predict(df.where("i % 5 = 0"))
    assert told.columns == ["i", "features", "label", "prediction"]
    assert told.where("label = prediction").count() >= 54 and told.count() == 60


def test_random_features_are_near_the_kernel(spark):
    """Products within the stated bound of the exact kernel, and a machine on them near one on the exact kernel."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) > 1.1).astype(int)  # no plane parts these
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "i int, features array<double>, label int")
    z = np.array([r["z"] for r in df.select("i", models.fourier("features", 2, 2000, 0.5, 1).alias("z")).orderBy("i").collect()])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.13 and np.abs(z @ z.T - exact).mean() < 0.02
    train, test = df.where("i % 3 > 0"), df.where("i % 3 = 0")
    _, predict = grid.fitted(grid.Spec("rbf", "kernel", "rbf_svm", {"count": 300, "gamma": 0.5, "maxIter": 30}), 1, train.select("features", "label"), [0, 1], 2)
    told = predict(test.select("i", "features", "label")).collect()
    accuracy = np.mean([r["label"] == r["prediction"] for r in told])
    own, held = np.arange(240) % 3 > 0, np.arange(240) % 3 == 0
    weights = np.linalg.solve(exact[np.ix_(own, own)] + 0.1 * np.eye(own.sum()), 2 * y[own] - 1)
    best = np.mean((exact[np.ix_(held, own)] @ weights > 0) == y[held])
    assert accuracy >= best - 0.08 and best > 0.9
    _, flat = grid.fitted(grid.Spec("svm", "linear", "linear_svm", {"maxIter": 30}), 1, train.select("features", "label"), [0, 1], 2)
    assert accuracy > np.mean([r["label"] == r["prediction"] for r in flat(test.select("features", "label")).collect()]) + 0.1
