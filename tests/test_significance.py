"""Chances of rank tests against known values, and reports of stored models against numpy."""

import math

import numpy as np
import pytest

from zonegrain.operators import learn, study
from zonegrain.plans import jobs


def test_student_p():
    """Values of the t table: two-sided 5 % and 1 % points, and one degree of freedom in closed form."""
    assert study.student_p(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert study.student_p(2.750, 30) == pytest.approx(0.01, abs=1e-5)
    assert study.student_p(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert study.student_p(0.0, 7) == 1.0
    assert study.student_p(1.96, 1e6) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-5)


def test_rank_tests(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 20, 60).astype(float)
    b = a + rng.integers(-6, 9, 60)
    t = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double")
    d = (a - b)[a != b]
    size = np.abs(d)
    rank = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
    n, stat = len(d), min(rank[d > 0].sum(), rank[d < 0].sum())
    ties = sum(c**3 - c for c in np.unique(size, return_counts=True)[1].tolist())
    z = (stat - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    got = study.wilcoxon(t, "a", "b").first()
    assert (got.statistic, got.n) == (stat, n) and got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    got = study.spearman(t, "a", "b").first()
    assert got.p == pytest.approx(study.student_p(got.rho * math.sqrt(58 / (1 - got.rho**2)), 58))


def test_logistic_fit_and_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 2))
    y = (x[:, 0] + rng.normal(size=90) > 0).astype(float)
    rows = spark.createDataFrame([(i, i % 3, x[i].tolist(), float(y[i])) for i in range(90)], "row_id long, group_id int, x array<double>, y double")
    w = learn.logistic_fit(rows, 2)
    assert x.T @ (y - 1 / (1 + np.exp(-x @ w))) - w == pytest.approx(np.zeros(2), abs=1e-6)
    held = {r.row_id: r.probability for r in learn.logistic_logo(rows, 2).collect()}
    for g in range(3):
        v = learn.logistic_fit(rows.where(f"group_id <> {g}"), 2)
        for i in range(g, 90, 3):
            assert held[i] == pytest.approx(1 / (1 + math.exp(-x[i] @ v)), abs=1e-7)


def test_stored_model_and_weights(spark):
    """Fold means of both models, and weights of features by whitened components times their deviation, from numpy."""
    rng = np.random.default_rng(4)
    n, d, k = 40, 6, 3
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 5
    grade, groups = rng.integers(0, 4, n), np.arange(n) % 5
    features = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(d)], "sample long, bin int, val double")
    grades = spark.createDataFrame([(i, int(groups[i]), int(grade[i])) for i in range(n)], "sample long, group_id int, grade int")
    found, model = jobs.graded(features, grades, k, 0.1)
    mean = x.mean(0)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    vt = vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]
    deviation = s[:k] / math.sqrt(n - 1)
    scores = (x - mean) @ vt[:k].T / deviation
    lin, log, intercepts, raw, chance = [], [], [], np.zeros(n), np.zeros(n)
    for g in range(5):
        t = groups != g
        m, my = scores[t].mean(0), grade[t].mean()
        a = scores[t] - m
        w = np.linalg.solve(a.T @ a + 0.1 * np.diag((a * a).sum(0)), a.T @ (grade[t] - my))
        v, y = np.zeros(k), (grade[t] > 1).astype(float)
        for _ in range(50):
            p = 1 / (1 + np.exp(-scores[t] @ v))
            v = v + np.linalg.solve(scores[t].T @ (scores[t] * (p * (1 - p))[:, None]) + np.eye(k), scores[t].T @ (y - p) - v)
        lin, log, intercepts = [*lin, w], [*log, v], [*intercepts, my - m @ w]
        raw[~t], chance[~t] = scores[~t] @ w + intercepts[-1], 1 / (1 + np.exp(-scores[~t] @ v))
    rows = {r["sample"]: r for r in found.collect()}
    assert [rows[i].raw for i in range(n)] == pytest.approx(raw.tolist(), abs=1e-8)
    assert [rows[i].probability for i in range(n)] == pytest.approx(chance.tolist(), abs=1e-6)
    assert [rows[i].prediction for i in range(n)] == pytest.approx(np.clip(raw, 0, grade.max()).tolist(), abs=1e-8)
    stored = jobs.stored_model(model, "surf")
    r = stored.first()
    assert r.w_lin == pytest.approx(np.mean(lin, 0).tolist()) and r.b_lin == pytest.approx(np.mean(intercepts)) and r.w_log == pytest.approx(np.mean(log, 0).tolist(), abs=1e-6) and r.b_log == 0
    assert r.sv == pytest.approx((s[:k] / math.sqrt(d - 1)).tolist())
    back: dict = {}
    for q in jobs.weight_report(stored, n).collect():
        back.setdefault(q.kind, {})[q.bin] = q.weight
    for kind, w in (("linear", np.mean(lin, 0)), ("logistic", np.mean(log, 0))):
        assert [back[kind][j] for j in range(d)] == pytest.approx((vt[:k].T @ (w * deviation) + mean).tolist(), abs=1e-5)
        assert [back[f"{kind}_pca"][j] for j in range(k)] == pytest.approx(w.tolist(), abs=1e-6)
    assert [back["pc2"][j] for j in range(d)] == pytest.approx(vt[1].tolist(), abs=1e-8)
    # Metrics: the linear ones before the cut to the grades' range, the others of the logistic probability.
    got = {q.name: q.value for q in jobs.metrics(found).collect()}
    y, label = grade > 1, chance > 0.5
    assert got["mse"] == pytest.approx(((raw - grade) ** 2).mean()) and got["mse"] != pytest.approx(((np.clip(raw, 0, 3) - grade) ** 2).mean())
    assert got["r2"] == pytest.approx(1 - ((raw - grade) ** 2).sum() / ((grade - grade.mean()) ** 2).sum())
    pairs = np.sign(chance[y][:, None] - chance[~y][None])
    assert got["auc"] == pytest.approx(((pairs + 1) / 2).mean())
    counts = {"tp": (y & label).sum(), "fp": (~y & label).sum(), "fn": (y & ~label).sum(), "tn": (~y & ~label).sum()}
    assert {c: got[c] for c in counts} == counts and got["accuracy"] == pytest.approx((y == label).mean())
    assert got["precision"] == pytest.approx(counts["tp"] / max(label.sum(), 1)) and got["recall"] == pytest.approx(counts["tp"] / y.sum())


def test_a_fit_that_is_not_finite_ends(spark):
    rows = spark.createDataFrame([(i, i % 3, [float(i), float("nan") if i == 4 else 1.0], float(i % 2)) for i in range(12)], "row_id long, group_id int, x array<double>, y double")
    with pytest.raises(ValueError, match="finite"):
        learn.logistic_logo(rows, 2)


def test_titles(spark):
    t = spark.createDataFrame([("deep", 1), ("surf", 2)], "zone string, sample int")
    assert jobs.picked(t, "Deep zone").count() == 1
    with pytest.raises(ValueError, match="begins with"):
        jobs.picked(t, "bone")
