"""Queries against their SQL where only equal bits will do: lists are compared as they are, with the sign of zero."""

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chanspark.operators import models
from chanspark.plans import catalogue


def _exact(x):
    return [_exact(v) for v in x] if isinstance(x, list | tuple) else x


def _differences(spark, name, folder):
    """The rows that only the query has, and those that only its SQL has."""
    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    db.execute("SET TimeZone = 'UTC'")
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    want = sorted(repr(_exact(r)) for r in found.fetchall())
    got = sorted(repr(_exact([r[c] for c in columns])) for r in catalogue.queries()[name](spark, str(folder)).collect())
    return [r for r in got if r not in want], [r for r in want if r not in got], len(want)


def _events(folder, rows):
    """events of (user, ts in seconds, value)."""
    users, seconds, values = zip(*rows, strict=True)
    stamps = pa.array([None if s is None else s * 1_000_000 for s in seconds], pa.timestamp("us"))
    table = pa.table({"event_id": pa.array(range(len(rows)), pa.int64()), "ts": stamps, "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * len(rows), "value": pa.array(values, pa.float64()), "props": [""] * len(rows)})
    pq.write_table(table, f"{folder}/events.parquet")
    return folder


def _vectors(folder, values):
    """embeddings of rows of 64 floats."""
    rows = np.asarray(values, np.float32)
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32())), "label": pa.array([k % 10 for k in range(len(rows))], pa.int32())})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["codec_roundtrip", "packet_source_roundtrip"])
def test_thousandths_of_floats(spark, tmp_path, name):
    _vectors(tmp_path, (np.arange(64 * 100).reshape(100, 64) - 3200) / 1000)
    assert _differences(spark, name, tmp_path) == ([], [], 100)


def test_feature_vectors_of_odd_streams(spark, tmp_path):
    falling = [(1, k, 1 - k * 1e-7) for k in range(20)]  # a slope that rounds to minus zero
    halves = [(2, k, round(0.00125 * (k % 16 == 0) + k % 7 / 1000, 5)) for k in range(60)]
    lacking = [(3, k, None if k < 25 or k % 3 == 1 else k / 7) for k in range(60)]
    nameless = [(None, k, 1.0) for k in range(30)]
    timeless = [(4, None if k % 5 == 2 else k, k * k / 3) for k in range(40)]
    _events(tmp_path, falling + halves + lacking + nameless + timeless)
    got, want, n = _differences(spark, "feature_vectors", tmp_path)
    assert (got, want, n) == ([], [], 1 + 9 + 9 + 5)


def test_scaled_vectors_near_their_mean(spark, tmp_path):
    values = np.random.default_rng(0).integers(-4, 5, (40, 64)) / 8
    values[:, 5] = [1, -1] * 19 + [-1e-7, 1e-7]  # two that round to zeros of either sign
    _vectors(tmp_path, values)
    got, want, n = _differences(spark, "preprocessing_pipeline", tmp_path)
    assert (got, want, n) == ([], [], 40)


@pytest.mark.parametrize(("broadcast", "rows", "pairs", "kind"), [(8192, 4096, 1 << 30, "float"), (7, 16, 80, "float"), (16, 5, 1 << 30, "double")])
def test_neighbours_of_many_queries(spark, monkeypatch, broadcast, rows, pairs, kind):
    """In rounds and slices, with names of any length, equal vectors, and rows without a label: as measured one by one."""
    monkeypatch.setattr(models, "BROADCAST_QUERIES", broadcast)
    monkeypatch.setattr(models, "SLICE", rows)
    monkeypatch.setattr(models, "TASK_PAIRS", pairs)
    rng = np.random.default_rng(1)
    x = (rng.integers(-2, 3, (90, 4)) * 0.1).astype(np.float32 if kind == "float" else float)
    names, labels = ["n" * (k % 5) + str(k) for k in range(90)], [None if k % 11 == 0 else "abc"[k % 3] for k in range(90)]
    df = spark.createDataFrame([(n, v, y) for n, v, y in zip(names, x.tolist(), labels, strict=True)], f"id string, v array<{kind}>, y string")
    got = models.nearest(df.where("id < '5'"), df, "id", "v", "y", 3, block=8).collect()
    squares = lambda d: float(np.cumsum(d * d, dtype=float)[-1])
    want = {(n, *c) for k, n in enumerate(names) if n < "5" for c in sorted(((squares(x[k] - w), m, y) for m, w, y in zip(names, x, labels, strict=True) if m != n), key=lambda c: c[:2])[:3]}
    assert {(r["q"], r["d"], r["r"], r["y"]) for r in got} == want and len(got) == len(want)


def test_nearest_vote_is_that_of_its_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "BROADCAST_QUERIES", 4)
    _vectors(tmp_path, np.random.default_rng(3).integers(-3, 4, (400, 64)) * 0.1)
    got, want, n = _differences(spark, "nearest_vote", tmp_path)
    assert (got, want, n) == ([], [], 20)
