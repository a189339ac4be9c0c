"""Support-vector classifiers against their dual by coordinates, folds by size, components without engine internals."""

import numpy as np
import pytest

from zonegrain.operators import margin, study


def dual(x, y, c):
    """Coordinate ascent on the dual of the hinge loss (intercept as one more feature): the optimum's value."""
    x = np.column_stack([x, np.ones(len(x))])
    a, w, q = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(1)
    for _ in range(3000):
        for i in range(len(y)):
            new = min(max(a[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0), c)
            w += (new - a[i]) * y[i] * x[i]
            a[i] = new
    return w, w @ w / 2 + c * np.maximum(0, 1 - y * (x @ w)).sum()


def test_lowest():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=6)
    w, value = margin.lowest(a, b)
    at = lambda v: v @ v / 2 + (a @ v + b).max()
    assert at(w) == pytest.approx(value, abs=1e-6) and all(at(w + rng.normal(size=3) * s) >= value - 1e-9 for s in (0.01, 0.1, 1) for _ in range(50))


def test_svm(spark):
    rng = np.random.default_rng(2)
    n, x = 60, rng.normal(size=(60, 2)) * 2
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int) + (x[:, 1] > 1.5)
    rows = spark.createDataFrame([(i, i % 4, x[i].tolist(), int(y[i])) for i in range(n)], "row_id long, group_id int, x array<double>, y int").repartition(3)
    got = {r.row_id: r.label for r in margin.svm_logo(rows, 2, [0, 1, 2], 0.5, 1e-4).collect()}
    wrong = 0
    for g in range(4):
        t = np.arange(n) % 4 != g
        ws = [dual(x[t], np.where(y[t] == k, 1.0, -1.0), 0.5)[0] for k in range(3)]
        s = np.column_stack([x[~t], np.ones((~t).sum())]) @ np.array(ws).T
        wrong += sum(got[i] != k for i, k in zip(np.flatnonzero(~t).tolist(), s.argmax(1).tolist(), strict=True))
    assert wrong <= 1  # a tie within the gap


def test_group_folds(spark):
    sizes = [9, 7, 7, 4, 3, 3, 2, 1]
    rows = spark.createDataFrame([(g, 0) for g, n in enumerate(sizes) for _ in range(n)], "group_id int, v int")
    load, want = [0, 0, 0], {}
    for g, n in sorted(enumerate(sizes), key=lambda e: (-e[1], e[0])):
        i = load.index(min(load))
        load[i] += n
        want[g] = i
    assert {r.group_id: r.fold for r in study.group_folds(rows, 3).collect()} == want
