"""Leave-one-out validation of exact trees in as many passes as a tree has levels, whatever the number of rows.

Only the nodes on its own row's way count for a fold's prediction, and the rows that get there are those of a node that
most folds share, less the row itself. So of each node that some fold has, counts by feature, value and label are taken
once over all rows, and each row looks for the best split with itself taken out of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chanspark.operators.ensembles import _matrix

#: Different values of all features in all nodes of a level; leave-one-out is for tables that are no larger.
MOST_VALUES = 5_000_000
#: Rows times splits that a task weighs at once.
AT_ONCE = 4_000_000


def _gini(counts: np.ndarray) -> np.ndarray:
    n = counts.sum(axis=-1)
    return n - (counts * counts).sum(axis=-1) / np.maximum(n, 1)


def _inside(x: np.ndarray, way: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, t, left in way:
        out &= (x[:, f] <= t) == left
    return out


def _next(values: list[tuple[np.ndarray, np.ndarray]], total: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int, max_depth: int, min_split: int) -> list[tuple[int, float] | int]:
    """Of each row x of a node, with itself taken out: the best split (feature, threshold), or the label that a leaf says.

    values: of each feature the node's different values, ascending, and how many rows of each label have them.
    """
    eye = np.eye(len(total), dtype=np.int64)
    feature = np.concatenate([np.full(max(len(v) - 1, 0), f) for f, (v, _) in enumerate(values)])
    low = np.concatenate([v[:-1] for v, _ in values])
    high = np.concatenate([v[1:] for v, _ in values])
    left = np.concatenate([np.cumsum(c, axis=0)[:-1] for _, c in values]) if len(feature) else np.zeros((0, len(total)), np.int64)
    out: list = []
    step = max(1, AT_ONCE // max(1, left.size))
    for at in range(0, len(x), step):
        own, label = x[at : at + step], eye[y[at : at + step]]
        rest = total - label
        below = left[None] - (own[:, feature] <= low)[:, :, None] * label[:, None]
        above = rest[:, None] - below
        cost = np.where((below.sum(-1) > 0) & (above.sum(-1) > 0), np.round(_gini(below) + _gini(above), 9), np.inf)
        n = rest.sum(-1)
        for i in range(len(own)):
            k = int(np.argmin(cost[i])) if cost.shape[1] else -1
            if depth >= max_depth or n[i] < min_split or (rest[i] > 0).sum() < 2 or k < 0 or not cost[i, k] < n[i] - (rest[i] * rest[i]).sum() / n[i] - 1e-9:
                out.append(int(np.argmax(rest[i])))
                continue
            f, a, b = int(feature[k]), low[k], high[k]
            v, counts = values[f]
            place = int(np.searchsorted(v, own[i, f]))
            if counts[place].sum() == 1:  # the value goes with the row, and its neighbours are next to each other
                if a == v[place]:
                    a = v[place - 1]
                elif b == v[place]:
                    b = v[place + 1]
            out.append((f, float((a + b) / 2)))
    return out


def leave_one_out(rows: DataFrame, key: str, features: str, label: str, width: int, max_depth: int = 4, min_split: int = 2) -> DataFrame:
    """(key, true, predicted) of each row by the exact tree that is fitted on all others, as models.fit_tree() fits it.

    An empty table gives none. Rows without a label, or with a vector of another width or with a missing value, are left out; of one row there is
    no tree, and predicted is null. Rows of one key are rows by themselves. ValueError beyond MOST_VALUES.
    """
    spark = rows.sparkSession
    labels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())  # classes are few
    if not labels:
        return rows.limit(0).select(key, F.col(label).alias("true"), F.col(label).alias("predicted"))
    label_type = rows.schema[label].dataType.simpleString()
    y = F.array_position(F.array(*map(F.lit, labels)), F.col(label)).cast("int") - 1
    whole = F.col(label).isNotNull() & (F.size(features) == width) & F.forall(features, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")))
    state = rows.where(whole).select(F.col(key).alias("key"), F.col(features).cast("array<double>").alias("x"), y.alias("y"), F.lit("[]").alias("way"), F.lit(None).cast("int").alias("said")).persist()
    kept, names = [state], ["key", "x", "y", "way", "said"]
    n = state.count()
    for depth in range(max_depth + 1 if n > 1 else 0):
        open_ways = [r["way"] for r in state.where("said IS NULL").select("way").distinct().collect()]
        if not open_ways:
            break

        def count(batches: Iterator[pa.RecordBatch], ways: list = [json.loads(w) for w in open_ways]) -> Iterator[pa.RecordBatch]:  # noqa: B006
            for batch in batches:
                x, own = _matrix(batch.column(1), width), batch.column(2).to_numpy()
                for k, way in enumerate(ways):
                    inside = _inside(x, way)
                    if not inside.any():
                        continue
                    some, said = x[inside], own[inside]
                    for f in range(width):
                        v, at = np.unique(some[:, f], return_inverse=True)
                        code, times = np.unique(at * len(labels) + said, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k)), pa.array(np.full(len(code), f)), pa.array(v[code // len(labels)]), pa.array(code % len(labels)), pa.array(times)], ["w", "f", "v", "c", "n"])

        summed = state.mapInArrow(count, "w long, f long, v double, c long, n long").groupBy("w", "f", "v", "c").agg(F.sum("n").alias("n"))
        table = summed.limit(MOST_VALUES + 1).toArrow().sort_by([("w", "ascending"), ("f", "ascending"), ("v", "ascending")])
        if table.num_rows > MOST_VALUES:
            raise ValueError(f"leave-one-out takes at most {MOST_VALUES} different values of features in a level")
        w, f, v, c, times = (table.column(k).to_numpy() for k in ("w", "f", "v", "c", "n"))
        found: dict[str, tuple[list, np.ndarray]] = {}
        for k, way in enumerate(open_ways):
            values = []
            for feature in range(width):
                some = (w == k) & (f == feature)
                distinct, at = np.unique(v[some], return_inverse=True)
                counts = np.zeros((len(distinct), len(labels)), np.int64)
                np.add.at(counts, (at, c[some]), times[some])
                values.append((distinct, counts))
            found[way] = (values, values[0][1].sum(axis=0))
        held = spark.sparkContext.broadcast(found)

        def decide(batches: Iterator[pa.RecordBatch], depth: int = depth, held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, own = _matrix(batch.column(1), width), batch.column(2).to_numpy()
                ways, said = batch.column(3).to_pylist(), batch.column(4).to_pylist()
                groups: dict[str, list[int]] = {}
                for i, (way, told) in enumerate(zip(ways, said, strict=True)):
                    if told is None:
                        groups.setdefault(way, []).append(i)
                for way, members in groups.items():
                    for i, answer in zip(members, _next(*held.value[way], x[members], own[members], depth, max_depth, min_split), strict=True):
                        if isinstance(answer, tuple):
                            ways[i] = json.dumps([*json.loads(way), [*answer, bool(x[i, answer[0]] <= answer[1])]])
                        else:
                            said[i] = answer
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ways, pa.string()), pa.array(said, pa.int32())], names)

        state = state.mapInArrow(decide, state.schema).persist()
        state.count()
        kept.append(state)
    for df in kept[:-1]:
        df.unpersist()  # the last one has what was computed, and where to compute it from
    known = F.array(*map(F.lit, labels)).cast(f"array<{label_type}>")
    return state.select(F.col("key").alias(key), F.get(known, F.col("y")).alias("true"), F.get(known, F.col("said")).alias("predicted"))
