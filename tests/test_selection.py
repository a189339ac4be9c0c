"""Nested hold-outs from additive sums against refits, one-pass textures against one set at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.operators import order, selection, stencil
from zonegrain.plans import jobs


def logo_error(x, y, groups, n, alpha):
    """Whitened components, ridge (penalty on columns over their norm) without each group, mean squared error."""
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    scores = c @ vt[:n].T / (s[:n] / np.sqrt(len(x) - 1))
    p = np.zeros(len(y))
    for g in set(groups.tolist()):
        t = groups != g
        m, my = scores[t].mean(0), y[t].mean()
        a = scores[t] - m
        norm = np.sqrt((a * a).sum(0))
        w = np.linalg.solve((a / norm).T @ (a / norm) + alpha * np.eye(n), (a / norm).T @ (y[t] - my)) / norm
        p[~t] = (scores[~t] - m) @ w + my
    return ((p - y) ** 2).mean()


def study(spark, seed=5, sets=3, samples=24, d=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(sets, samples, d))
    y = np.round(x[1, :, 0] + x[1, :, 1] + rng.normal(size=samples) / 4, 3)
    groups = np.arange(samples) % 7
    features = spark.createDataFrame([(k, i, j, float(x[k, i, j])) for k in range(sets) for i in range(samples) for j in range(d)], "par_id int, sample long, bin int, val double")
    grades = spark.createDataFrame([(i, int(groups[i]), i, float(y[i])) for i in range(samples)], "sample long, group_id int, split long, grade double")
    return x, y, groups, features, grades


def test_split_errors(spark):
    x, y, groups, features, grades = study(spark)
    got = {(r.par_id, r.split): r.error for r in selection.split_errors(features, grades, 3, 0.1).collect()}
    assert len(got) == 3 * 24
    for (k, s), error in got.items():
        t = np.arange(24) != s
        assert error == pytest.approx(logo_error(x[k][t], y[t], groups[t], 3, 0.1), rel=1e-8)
    whole = {r.par_id: (r.split, r.error) for r in selection.split_errors(features, grades, 3, 0.1, whole=True).collect()}
    assert all(whole[k] == (None, pytest.approx(logo_error(x[k], y, groups, 3, 0.1), rel=1e-8)) for k in range(3))


def test_split_errors_of_sets_that_fail(spark):
    _, _, _, features, grades = study(spark, sets=2)
    broken = features.withColumn("val", F.when((F.col("par_id") == 1) & (F.col("sample") == 4), float("nan")).otherwise(F.col("val")))
    got = selection.split_errors(broken, grades, 3).collect()
    assert {r.error for r in got if r.par_id == 1} == {selection.FAILED} and all(r.error < 1e6 for r in got if r.par_id == 0)
    one = selection.split_errors(features, grades.withColumn("group_id", F.lit(1)), 3).collect()
    assert {r.error for r in one} == {selection.FAILED}
    assert selection.split_errors(features.limit(0), grades).isEmpty()


@pytest.mark.parametrize(("n", "folds"), [(23, 4), (12, 11), (30, 2)])
def test_kfold_inside_loo(spark, n, folds):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 2)), rng.normal(size=n)
    rows = spark.createDataFrame([(100 - i, x[i].tolist(), float(y[i])) for i in range(n)], "row_id long, x array<double>, y double").repartition(5)
    got = {r.row_id: r.prediction for r in selection.kfold_inside_loo(rows, 2, folds).collect()}
    x, y = x[::-1], y[::-1]  # in order of row_id
    for i in range(n):
        rest = np.delete(np.arange(n), i)
        found = []
        for part in np.array_split(rest, folds):
            t = np.setdiff1d(rest, part)
            w = np.linalg.lstsq(np.column_stack([x[t], np.ones(len(t))]), y[t], rcond=None)[0]
            found.append(w[:2] @ x[i] + w[2])
        assert got[101 - n + i] == pytest.approx(np.mean(found), abs=1e-9)


def test_numbered(spark):
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, i * 37 % 101) for i in range(300)], "g int, v int").repartition(6)
    got: dict = {}
    for r in order.numbered(rows, ["g"], ["v"]).collect():
        got.setdefault(r.g, []).append((r.nth, r.v))
    for some in got.values():
        some.sort()
        assert [n for n, _ in some] == list(range(len(some))) and [v for _, v in some] == sorted(v for _, v in some)


def test_textures_of_many_sets(spark):
    rng = np.random.default_rng(8)
    rows = [(f"surf/{k}", y, x, float(rng.integers(0, 256))) for k in range(2) for y in range(30 + k) for x in range(27)]
    images = spark.createDataFrame(rows, "image string, y int, x int, val double")
    names = ("par_id", *stencil.SET)
    sets = [dict(zip(names, v, strict=True)) for v in ((0, 3, 1, 3, 1, 8, 2, 1, 3, 3, 3), (1, 7, 2, 5, 1, 8, 5, 2, 1, 3, 5), (2, 5, 2, 3, 1, 8, 3, 2, 5, 5, 3))]
    got = {(r.image, r.par_id, r.bin): r.val for r in stencil.texture_sets(images, sets).collect()}
    assert len(got) == 2 * 3 * 32
    for p in sets:
        even = stencil.standardise(images, p["ks1"], p["sigma1"], p["ks2"], p["sigma2"])
        one = stencil.mrelbp(even, 8, p["large"], p["small"], p["wc"], p["wl"], p["ws"], True).collect()
        assert all(got[r.image, p["par_id"], r.bin] == pytest.approx(r.val, abs=1e-12) for r in one) and len(one) == 64
    with pytest.raises(ValueError, match="odd"):
        stencil.texture_sets(images, [{**sets[0], "ks1": 4}])


def test_texture_search(spark):
    """The choice of each left-out sample is that of refits on features made set by set."""
    rng = np.random.default_rng(9)
    rows = [("surf", k, y, x, float(rng.integers(0, 256) * (1 + (k % 3) * (x % 2)) % 256)) for k in range(9) for y in range(24) for x in range(24)]
    images = spark.createDataFrame(rows, "zone string, sample long, y int, x int, val double")
    grades = spark.createDataFrame([(k, k % 4, k % 3) for k in range(9)], "sample long, group_id int, grade int")
    names = ["par_id", *stencil.SET]
    sets = spark.createDataFrame([(0, 3, 1, 3, 1, 8, 2, 1, 3, 3, 3), (1, 5, 2, 3, 1, 8, 3, 2, 1, 3, 1)], names)
    got = {r.split: (r.par_id, r.error) for r in jobs.texture_search(images, grades, sets, 2).collect()}
    errors: dict = {}
    for p in sets.collect():
        own = stencil.standardise(images.select(F.col("sample").alias("image"), "y", "x", "val"), p.ks1, p.sigma1, p.ks2, p.sigma2)
        x = np.zeros((9, 32))
        for r in stencil.mrelbp(own, 8, p.large, p.small, p.wc, p.wl, p.ws, True).collect():
            x[r.image, r.bin] = r.val
        y, groups = np.arange(9) % 3, np.arange(9) % 4
        for s in range(9):
            t = np.arange(9) != s
            errors[s, p.par_id] = logo_error(x[t], y[t].astype(float), groups[t], 2, 0.1)
    for s in range(9):
        best = min((errors[s, k], k) for k in (0, 1))
        assert got[s] == (best[1], pytest.approx(best[0], rel=1e-6))
