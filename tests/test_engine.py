import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chanspark.functions.naming import DESCRIPTORS
from chanspark.operators import signal, windows
from chanspark.streaming import engine

CHANNELS = 4


def _settings():
    # A lambda goes to the workers by value; they can't import this file.
    return engine.Settings(CHANNELS, [0.0, 0.1], [1.0, 2.0], [1, 3], [0, 11, 21], lambda v: [1.0, 0.2, 0.1] if v[0] < 0 else [0.1, 0.2, 1.0], size=10, step=4)


def _rows():
    rng = np.random.default_rng(5)
    rows = [(s, i, i / 50, rng.normal(np.sin(i / 9), 1, CHANNELS).tolist()) for s in ("a", "b") for i in range(90)]
    rows += [("a", 30, 0.6, [1.0]), ("b", 31, 0.62, None), ("b", 33, 0.66, [float("nan")] * CHANNELS)]
    random.shuffle(rows)
    return rows


SCHEMA = "stream_id string, sequence long, seconds double, amplitude array<double>"


def test_kernels_equal_the_operators(spark):
    x = np.random.default_rng(1).normal(size=40)
    x[7] = 30
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    clean = signal.moving_average(signal.hampel(df, ["k"], ["i"], "x"), ["k"], ["i"], "clean", 3, "nearest")
    assert np.allclose([r["smooth"] for r in clean.orderBy("i").collect()], engine.filtered(x[:, None], 5, 3.0, 3)[:, 0])
    row = windows.describe(windows.hop(df, ["k"], ["i"], 40, 1), ["k"], "x").first()
    assert np.allclose([row[c] for c in DESCRIPTORS], engine.describe(x[:, None]))


def test_windows_are_due_and_judged(spark):
    got = engine.run(spark.createDataFrame(_rows(), SCHEMA), _settings()).orderBy("stream_id", "accepted").collect()
    most = 10 + 2 * 6
    assert [r["accepted"] for r in got if r["stream_id"] == "a"] == list(range(most, 91, 4))
    assert {r["window_end"] - r["window_start"] for r in got} == {10} and got[0]["window_start"] == 6
    assert abs(got[0]["delay"] - 6 / 50) < 1e-9
    assert [r["window_index"] for r in got if r["stream_id"] == "b"] == list(range(len(got) // 2))
    assert max(r["rejected"] for r in got if r["stream_id"] == "b") == 2
    with pytest.raises(ValueError):
        engine.Settings(2, [0.0], [0.0], [1], [0], list)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(_rows(), SCHEMA)
    for low, high in ((0, 40), (40, 41), (41, 90)):
        df.where((F.col("sequence") >= low) & (F.col("sequence") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = engine.run(source, _settings()).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    columns = ["stream_id", "accepted", "window_start", "stable_state", "raw_state", "transition_reason"]
    got, want = spark.read.parquet(str(tmp_path / "out")).select(*columns), engine.run(df, _settings()).select(*columns)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 20
