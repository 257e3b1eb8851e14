"""Leave-one-out against fitting a tree for each row."""

import numpy as np
import pytest

from chanspark.operators import folds


def _predict(node, x):
    while isinstance(node, tuple):
        f, t, left, right = node
        node = left if x[f] <= t else right
    return node


def slow(x, y, depth, least):
    labels = sorted(set(y))

    def gini(rows):
        n = [sum(y[r] == c for r in rows) for c in labels]
        return len(rows) - sum(v * v for v in n) / len(rows)

    def grow(rows, at):
        n = [sum(y[r] == c for r in rows) for c in labels]
        best = None
        if at < depth and len(rows) >= least and sum(v > 0 for v in n) > 1:
            for f in range(len(x[0])):
                v = sorted({x[r][f] for r in rows})
                for a, b in zip(v, v[1:], strict=False):
                    left = [r for r in rows if x[r][f] <= a]
                    right = [r for r in rows if x[r][f] > a]
                    cost = round(gini(left) + gini(right), 9)
                    if best is None or cost < best[0]:
                        best = (cost, f, (a + b) / 2, left, right)
        if best and best[0] < gini(rows) - 1e-9:
            return best[1], best[2], grow(best[3], at + 1), grow(best[4], at + 1)
        return labels[n.index(max(n))]

    return [_predict(grow([r for r in range(len(x)) if r != i], 0), x[i]) for i in range(len(x))]


@pytest.mark.parametrize(("seed", "least", "places"), [(1, 2, 0), (2, 2, 1), (3, 8, 2)])
def test_leave_one_out(spark, monkeypatch, seed, least, places):
    """Ties, values that go with their row, and few rows at once."""
    monkeypatch.setattr(folds, "AT_ONCE", 2000)
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, 60)
    x = np.round(rng.normal(size=(60, 3)) + (y[:, None] == np.arange(3)) * 1.2, places)
    rows = [(i, r.tolist(), "abc"[c]) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame([*rows, (90, None, "a"), (91, [1.0], "a"), (92, [1.0, float("nan"), 1.0], "a"), (93, [1.0, 1.0, 1.0], None)], "id int, f array<double>, label string").repartition(4)
    found = sorted(tuple(r) for r in folds.leave_one_out(df, "id", "f", "label", 3, max_depth=3, min_split=least).collect())
    want = slow([r[1] for r in rows], [r[2] for r in rows], 3, least)
    assert found == [(r[0], r[2], p) for r, p in zip(rows, want, strict=True)]


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 5)], "id int, f array<double>, label int")
    assert [tuple(r) for r in folds.leave_one_out(df, "id", "f", "label", 1).collect()] == [(1, 5, None)]
    assert folds.leave_one_out(df.limit(0), "id", "f", "label", 1).count() == 0
