"""Nearest neighbours in blocks of bounded size, with ties and copies, against all distances."""

import numpy as np

from zonegrain.operators import study


def test_knn_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(study, "NEAR", 9)  # more blocks than partitions alone would give
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 4, (60, 3)).astype(float), rng.random(60)
    rows = spark.createDataFrame([(i, x[i].tolist(), float(y[i])) for i in range(60)], "sample long, x array<double>, y double")
    got = {r.sample: r.prediction for r in study.knn(rows, 3).collect()}
    for i in range(60):
        d2 = ((x - x[i]) ** 2).sum(1)
        near = sorted((d2[j], j) for j in range(60) if j != i)[:3]
        w = [float(d == 0) if near[0][0] == 0 else d**-0.5 for d, _ in near]
        assert abs(got[i] - sum(u * y[j] for u, (_, j) in zip(w, near, strict=True)) / sum(w)) < 1e-12
