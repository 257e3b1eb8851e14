"""The engine on the state API: equal to the batch engine with restarts, late packets and streams that fall silent."""

import time

import numpy as np
from pyspark.sql import functions as F

from chanspark.streaming import engine, stateful

CHANNELS = 3
SCHEMA = "stream_id string, sequence long, seconds double, amplitude array<double>"


def _settings():
    return engine.Settings(CHANNELS, [0.0, 0.1], [1.0, 2.0], [1, 2], [0, 11, 21], lambda v: [1.0, 0.2, 0.1] if v[0] < 0 else [0.1, 0.2, 1.0], size=10, step=4)


def _rows():
    rng = np.random.default_rng(5)
    rows = [(s, i, i / 50, rng.normal(np.sin(i / 9), 1, CHANNELS).tolist()) for s in ("a", "b") for i in range(80)]
    return rows + [("b", 100, 2.0, None), (None, 1, 0.1, [1.0] * CHANNELS)]


def _decisions(rows):
    return sorted(tuple(r[c] for c in ("stream_id", "accepted", "rejected", "window_start", "window_end", "stable_state", "window_index", "confidence")) for r in rows)


def _write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


def _go(spark, tmp_path, silent_ms=None, once=True):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = stateful.run(source, _settings(), silent_ms).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start(str(tmp_path / "out"))
    if once:
        query.awaitTermination()
    return query


def test_stream_equals_batch(spark, tmp_path):
    """Three starts of the query, with packets that come late or twice in the later ones."""
    rows = _rows()
    at = lambda low, high: [r for r in rows if low <= r[1] < high]
    _write(spark, at(0, 30), str(tmp_path / "in"))
    _go(spark, tmp_path)
    late = [("a", 5, 9.9, [50.0] * CHANNELS), ("b", 29, 9.9, [50.0] * CHANNELS), ("a", 7, 9.9, None)]
    _write(spark, at(30, 41) + late, str(tmp_path / "in"))
    _write(spark, at(41, 60), str(tmp_path / "in"))
    _go(spark, tmp_path)
    _write(spark, [*at(60, 200), ("b", 10, 9.9, [1.0] * CHANNELS)], str(tmp_path / "in"))
    _go(spark, tmp_path)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    want = engine.run(spark.createDataFrame(rows, SCHEMA), _settings()).collect()
    assert _decisions(found) == _decisions(want) and len(want) > 20
    assert {(r["stream_id"], r["late"]) for r in found if r["accepted"] > 70} == {("a", 2), ("b", 2)}


def test_batch_data(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    found = stateful.run(df, _settings()).collect()
    assert _decisions(found) == _decisions(engine.run(df, _settings()).collect()) and {r["event"] for r in found} == {"decision"}


def test_silent_streams_are_forgotten(spark, tmp_path):
    rows = [r for r in _rows() if r[0] == "a" and r[1] < 30]
    _write(spark, rows, str(tmp_path / "in"))
    query = _go(spark, tmp_path, 2000, once=False)
    try:
        for _ in range(60):
            time.sleep(1)
            done = spark.read.schema(f"stream_id string, {stateful.EVENT}").parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else None
            if done is not None and done.where("event = 'silent'").count():
                break
        _write(spark, [r for r in _rows() if r[0] == "a" and 30 <= r[1] < 60], str(tmp_path / "in"))
        for _ in range(40):
            time.sleep(1)
            if done.where("event = 'silent'").count() > 1:
                break
    finally:
        query.stop()
    found = spark.read.parquet(str(tmp_path / "out")).where(F.col("event") == "silent").select("accepted", "late").collect()
    assert [tuple(r) for r in found] == [(30, 0), (30, 0)]  # it starts anew
