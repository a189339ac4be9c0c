"""Linear models by gradient descent, and leave-one-out where training rows are parts of samples and tests are whole ones.

Both need only additive sums of the rows (n, sums, products): one pass with partial sums, whatever the number of steps or of
samples left out. Rows without a value in x or y are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import study


def _whole(rows: DataFrame, d: int) -> DataFrame:
    ok = F.col("y").isNotNull()
    for i in range(d):
        ok = ok & F.get("x", F.lit(i)).isNotNull()
    return rows.where(ok)


def descend(stat: pd.Series, d: int, rate: float, epochs: int) -> tuple[np.ndarray, float]:
    """Coefficients with the intercept last, and the loss of the last step's start, from sums; all start at 0."""
    n = stat["n"]
    g, c = np.empty((d + 1, d + 1)), np.array([*(stat[f"c{i}"] for i in range(d)), stat["sy"]], float)
    for i in range(d):
        g[i, d] = g[d, i] = stat[f"s{i}"]
        for j in range(i, d):
            g[i, j] = g[j, i] = stat[f"g{i}_{j}"]
    g[d, d] = n
    w, before = np.zeros(d + 1), np.zeros(d + 1)
    for _ in range(epochs):
        before, w = w, w - rate * 2 / n * (g @ w - c)
        if not np.isfinite(w).all():
            raise ValueError(f"steps of {rate} grow without end; the largest that don't is {2 / np.linalg.eigvalsh(2 / n * g)[-1]:.3g}")
    return w, float((stat["yy"] - 2 * c @ before + before @ g @ before) / n)


def descent_model(rows: DataFrame, d: int, rate: float = 1e-5, epochs: int = 5000) -> DataFrame:
    """w (array, the intercept last) and loss of the linear model of rows (x array, y) after so many steps on the mean squared error of all rows.

    A step needs the gradient over all rows, which their sums give exactly: the steps are made on (d + 1)^2 numbers. No row
    gives no model.
    """
    sums = study.fold_sums(_whole(rows, d).select("x", "y").withColumn("group_id", F.lit(0)), d)
    numbers = sums.select(*(F.col(c).cast("double").alias(c) for c in sums.columns if c != "group_id"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [descend(r, d, rate, epochs) for _, r in pdf.iterrows()]
            yield pd.DataFrame({"w": [w.tolist() for w, _ in found], "loss": [loss for _, loss in found]})

    return numbers.mapInPandas(solve, "w array<double>, loss double")


def predicted(rows: DataFrame, model: DataFrame, d: int) -> DataFrame:
    """rows (x array) with the prediction of one model."""
    p = sum((F.get("w", F.lit(i)) * F.get("x", F.lit(i)) for i in range(d)), F.get("w", F.lit(d)))
    return rows.join(F.broadcast(model.select("w"))).withColumn("prediction", p).drop("w")  # one row


def parts_loo(whole: DataFrame, parts: DataFrame, d: int, alpha: float = 1.0, centred: bool = True) -> DataFrame:
    """whole (group_id, x array) with the prediction of the ridge model of all parts (group_id, x, y) but those of its own group.

    centred False: x is not taken less the training mean, as the model's own rows are; the prediction is the mean of y plus the
    weighted x. A sample without parts has a null prediction. Groups of any size are sums before they meet.
    """
    parts = _whole(parts, d)
    models = study.fold_models(parts, d, alpha, False)
    if not centred:
        sums = study.fold_sums(parts, d).select("group_id", "n", *(f"s{i}" for i in range(d)))
        total = sums.agg(*(F.sum(c).alias(f"all_{c}") for c in sums.columns if c != "group_id"))
        mean = sums.join(F.broadcast(total)).select("group_id", F.array(*((F.col(f"all_s{i}") - F.col(f"s{i}")) / (F.col("all_n") - F.col("n")) for i in range(d))).alias("mean"))  # one row
        shift = sum((F.get("w", F.lit(i)) * F.get("mean", F.lit(i)) for i in range(d)), F.lit(0.0))
        models = models.join(mean, "group_id").select("group_id", F.concat(F.slice("w", 1, d), F.array(F.get("w", F.lit(d)) + shift)).alias("w"))
    p = sum((F.get("w", F.lit(i)) * F.get("x", F.lit(i)) for i in range(d)), F.get("w", F.lit(d)))
    return whole.join(models, "group_id", "left").withColumn("prediction", p).drop("w")
