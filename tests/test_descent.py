"""Gradient descent, leave-one-out of whole samples against parts, and the job of sub-images, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.operators import descent, learn, resample, study
from zonegrain.plans import jobs


def test_descent_takes_the_same_steps(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    rows = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)] + [([1.0, None, 2.0], 3.0), ([1.0, 2.0, 3.0], None)], "x array<double>, y double")
    got = descent.descent_model(rows, 3, 0.01, 300).first()
    wide, w = np.c_[x, np.ones(60)], np.zeros(4)
    for _ in range(300):
        loss = ((wide @ w - y) ** 2).mean()
        w = w - 0.01 * 2 / 60 * wide.T @ (wide @ w - y)
    assert np.allclose(got.w, w) and np.isclose(got.loss, loss)
    with pytest.raises(Exception, match="grow without end"):
        descent.descent_model(rows, 3, 1e3, 5000).collect()
    assert descent.descent_model(rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("centred", [True, False])
def test_parts_loo_refits(spark, centred):
    rng = np.random.default_rng(1)
    group = np.repeat(np.arange(6), [1, 4, 4, 9, 2, 30])
    x, y = rng.normal(3, 1, (50, 2)), rng.normal(size=50)
    whole = rng.normal(3, 1, (7, 2))  # the last has no part
    parts = spark.createDataFrame([(int(g), list(map(float, a)), float(b)) for g, a, b in zip(group, x, y, strict=True)], "group_id int, x array<double>, y double")
    samples = spark.createDataFrame([(g, list(map(float, a))) for g, a in enumerate(whole)], "group_id int, x array<double>")
    got = {r.group_id: r.prediction for r in descent.parts_loo(samples, parts, 2, 1.0, centred).collect()}
    assert got.pop(6) is None and len(got) == 6
    for g, p in got.items():
        a, b = x[group != g], y[group != g]
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + np.eye(2), (a - a.mean(0)).T @ (b - b.mean()))
        assert np.isclose(p, b.mean() + w @ (whole[g] - (a.mean(0) if centred else 0)))


def test_parts_grading(spark):
    """Features that tell the grade: what is fitted on parts of some samples grades the parts of others."""
    rng = np.random.default_rng(2)
    grade = rng.integers(0, 4, 40)
    rows = [(s, sub, b, float(v)) for s in range(40) for sub in range(3) for b, v in enumerate(np.r_[grade[s], -2 * grade[s], 0] + rng.normal(0, 0.1, 3))]
    f = spark.createDataFrame(rows, "sample int, sub int, bin int, val double")
    grades = spark.createDataFrame([(s, int(g)) for s, g in enumerate(grade)], "sample int, grade int")
    got = jobs.parts_grading(f.where("sample < 25"), f.where("sample >= 25"), grades, 2, 0.05, 2000, 50)
    found = got["predictions"].toPandas()
    assert found.groupby("set").size().to_dict() == {"train": 75, "test": 45}
    assert (found.actual.to_numpy() == grade[found["sample"]]).all() and np.abs(found.prediction - found.actual).max() < 0.5
    m = {(r["set"], r["name"]): r.value for r in got["metrics"].collect()}
    for name, one in found.groupby("set"):
        a, p = one.actual.to_numpy(), one.prediction.to_numpy()
        assert np.isclose(m[name, "mse"], ((a - p) ** 2).mean()) and np.isclose(m[name, "r2"], 1 - ((a - p) ** 2).mean() / a.var())
        assert np.allclose([m[name, "slope"], m[name, "intercept"]], np.polyfit(a, p, 1))
        yes, no = np.round(p[a > 0]) > 0, np.round(p[a == 0]) > 0
        assert np.isclose(m[name, "auc"], np.mean([(i > j) + 0.5 * (i == j) for i in yes.astype(int) for j in no.astype(int)]))
    assert {(r["set"], r.metric) for r in got["intervals"].collect()} == {("train", "mse"), ("test", "mse")}
    # the training rows' own components, by numpy
    x = np.array([r[3] for r in rows]).reshape(120, 3)[:75]
    left, sv, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    wide, w = np.c_[left[:, :2] * np.sqrt(74), np.ones(75)], np.zeros(3)
    y = np.repeat(grade[:25], 3)
    for _ in range(2000):
        w = w - 0.05 * 2 / 75 * wide.T @ (wide @ w - y)
    assert np.allclose(found[found.set == "train"].sort_values(["sample", "sub"]).prediction, wide @ w, atol=1e-6)


@pytest.mark.parametrize("block", [study.BLOCK, 4])
def test_products_go_by_bin(spark, monkeypatch, block):
    """Sums of samples that lack bins or hold nulls, NaN or infinity are those of the pairs that they have, in blocks of any size."""
    monkeypatch.setattr(study, "BLOCK", block)
    rows = [(0, 3, 1.0), (0, 7, 2.0), (1, 3, 3.0), (1, 5, 4.0), (1, 7, None), (2, 5, float("nan")), (2, 9, None), (3, 3, float("inf")), (3, 5, 0.0), (4, 7, 5.0), (4, 7, 0.5)]
    f = spark.createDataFrame(rows, "sample int, bin int, val double").repartition(1)
    a, b = f.alias("a"), f.alias("b")
    want = a.join(b, F.expr("a.sample = b.sample and a.bin <= b.bin")).groupBy("a.bin", "b.bin").agg(F.sum(F.expr("a.val * b.val")))
    text = lambda t: sorted((i, j, repr(v)) for i, j, v in t.collect())
    assert text(study.gram(f)) == text(want)
    assert study.gram(f.limit(0)).count() == 0


def test_scores_of_odd_rows_are_null(spark):
    model = {"mean": [1.0, 2.0], "eigvec": [[1.0, 0.0], [0.6, 0.8], [0.0, 1.0]], "sv": [2.0, 4.0, 0.0]}
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [1.0, None]), (2, None), (3, [1.0]), (4, [1.0, 2.0, 3.0])], "sample int, x array<double>")
    got = {r.sample: r.scores for r in learn.project(rows, model).collect()}
    assert np.allclose(got.pop(0), [1, 0.7, 2]) and all(v == [None] * 3 for v in got.values()) and len(got) == 4


def test_parts_grading_makes_what_is_asked_for(spark, monkeypatch):
    """No resample is drawn for metrics, and they are those of the whole job."""
    rng = np.random.default_rng(3)
    rows = [(s, sub, b, float(v)) for s in range(20) for sub in range(2) for b, v in enumerate(rng.normal(0, 1, 3))]
    f = spark.createDataFrame(rows, "sample int, sub int, bin int, val double")
    grades = spark.createDataFrame([(s, s % 4) for s in range(20)], "sample int, grade int")
    job = lambda **k: jobs.parts_grading(f.where("sample < 12"), f.where("sample >= 12"), grades, 2, 0.05, 100, 10, **k)
    whole = job()
    assert set(whole) == {"predictions", "metrics", "intervals", "model"}
    monkeypatch.setattr(resample, "bootstrap", None)
    got = job(tables=("metrics",))
    assert set(got) == {"metrics"}
    values = lambda t: {(r["set"], r.name): r.value for r in t.collect()}
    assert values(got["metrics"]) == pytest.approx(values(whole["metrics"]), nan_ok=True)


def test_metrics_of_sets_in_one_pass(spark):
    """Ranks, chances and areas by set are those of each set alone, also where sets share values; metrics of a set without rows are null."""
    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], float(a), float(p), int(a > 1)) for i, (a, p) in enumerate(zip(rng.integers(0, 4, 90), rng.normal(1, 2, 90).round(1), strict=True))]
    t = spark.createDataFrame(rows, "set string, a double, p double, y int")
    for make in (lambda t, **k: study.spearman(t, "a", "p", **k), lambda t, **k: study.wilcoxon(t, "a", "p", **k), lambda t, **k: study.auc(t, "y", "p", **k), lambda t, **k: study.regression_metrics(t, "a", "p", **k)):
        got = {r["set"]: tuple(r)[1:] for r in make(t, by=("set",)).collect()}
        assert set(got) == {"a", "b"}
        for k, one in got.items():
            assert one == pytest.approx(tuple(make(t.where(F.col("set") == k)).first()))
    f = spark.createDataFrame([(s, 0, b, float(v)) for s in range(9) for b, v in enumerate(rng.normal(0, 1, 3))], "sample int, sub int, bin int, val double")
    grades = spark.createDataFrame([(s, s % 4) for s in range(9)], "sample int, grade int")
    got = jobs.parts_grading(f, f.limit(0), grades, 2, 0.05, 50, tables=("metrics",))["metrics"]
    assert got.dtypes == [("name", "string"), ("value", "double"), ("set", "string")] and got.count() == 20
    assert got.where("set = 'test' and value is null").count() == 10 and got.where("set = 'train' and value is null").count() == 0
