"""Bootstrap values of every replicate against loops over the same weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.operators import resample


def auc(y, s, w):
    pos, neg = y == 1, y == 0
    d = s[pos][:, None] - s[neg][None]
    return ((np.sign(d) + 1) / 2 * w[pos][:, None] * w[neg][None]).sum() / (w[pos].sum() * w[neg].sum())


def precision(y, s, w):
    total = 0.0
    for v in np.unique(s):
        at, upto = s == v, s >= v
        total += w[at & (y == 1)].sum() * w[upto & (y == 1)].sum() / max(w[upto].sum(), 1)
    return total / w[y == 1].sum()


@pytest.mark.parametrize(("n", "levels"), [(200, 12), (150, 1), (90, 10_000)])
def test_each_replicate(spark, n, levels):
    rng = np.random.default_rng(n)
    y, s = rng.integers(0, 2, n), rng.integers(0, levels, n) / 7
    rows = spark.createDataFrame([(i, int(y[i]), float(s[i])) for i in range(n)], "id long, y int, score double").repartition(7)
    got = {(r.metric, r.replicate): r.value for r in resample.bootstrap(rows, "y", "score", "id", ("auc", "average_precision", "mse"), 40, draw=F.col("id")).collect()}
    w = resample.weights(np.arange(n), 40, 42)
    for r in range(40):
        assert got["auc", r] == pytest.approx(auc(y, s, w[:, r]), abs=1e-9)
        assert got["average_precision", r] == pytest.approx(precision(y, s, w[:, r]), abs=1e-9)
        assert got["mse", r] == pytest.approx((w[:, r] * (y - s) ** 2).sum() / w[:, r].sum(), abs=1e-9)


def test_weights_are_poisson():
    w = resample.weights(np.random.default_rng(1).integers(0, 2**31, 2000), 200, 42)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.003)
    assert abs(np.corrcoef(w[:, :30].T)[np.triu_indices(30, 1)]).max() < 0.1 and abs(np.corrcoef(w[:30])[np.triu_indices(30, 1)]).max() < 0.35


def test_spread_is_that_of_resampling(spark):
    """Mean and limits of 2,000 replicates against 2,000 resamples with replacement."""
    rng = np.random.default_rng(6)
    y = (np.arange(120) % 3 == 0).astype(int)
    s = rng.normal(size=120) + y
    rows = spark.createDataFrame([(i, int(y[i]), float(s[i])) for i in range(120)], "id long, y int, score double")
    got = resample.intervals(resample.bootstrap(rows, "y", "score", "id", ("auc",))).first()
    draws = [np.concatenate([rng.choice(np.flatnonzero(y == k), (y == k).sum()) for k in (0, 1)]) for _ in range(2000)]
    want = [auc(y[d], s[d], np.ones(120)) for d in draws]
    assert got.replicates == 2000 and got.mean == pytest.approx(np.mean(want), abs=0.01)
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(want, (2, 97))), abs=0.025)


def test_replicates_that_are_skipped(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25), (2, 0, None), (3, None, 1.0)], "id long, y int, score double")
    w = resample.weights(np.arange(2), 60, 42)
    both = set(np.flatnonzero((w > 0).all(0)).tolist())
    got = resample.bootstrap(rows, "y", "score", "id", ("auc", "average_precision"), 60, draw=F.col("id")).collect()
    assert {r.replicate for r in got if r.metric == "auc"} == both == {r.replicate for r in got if r.metric == "average_precision"} and len(both) < 60
    plain = resample.bootstrap(rows, "y", "score", "id", ("average_precision",), 60, stratified=False, draw=F.col("id")).collect()
    assert {r.replicate for r in plain} == set(np.flatnonzero(w[0] > 0).tolist())
    assert resample.bootstrap(rows.limit(0), "y", "score", "id", ("auc", "mse"), 5).isEmpty()


def test_draws_in_blocks_and_buckets(spark, monkeypatch):
    """Many tasks, blocks and buckets give what one of each gives."""
    from zonegrain.operators import study

    t = spark.createDataFrame([(k, k % 3 % 2, k * 7919 % 41) for k in range(300)], "id long, y int, score int")
    told = lambda: (sorted(map(tuple, study.bootstrap_auc(t, "y", "score", "id", 4).collect())), sorted(map(tuple, study.bootstrap_curves(t, "y", "score", "id", 4).collect())))
    one = told()
    monkeypatch.setattr(study, "_TASK", 150)
    monkeypatch.setattr(study, "_BLOCK", 7)
    monkeypatch.setattr(study, "_ORDERED", 40)
    many = told()
    assert many == one and len(one[0]) == 4
