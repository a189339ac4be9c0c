"""Linear support-vector classifiers for all held-out groups at once, by cutting planes.

For each group left out and each class the loss is w.w / 2 + C * sum of max(0, 1 - y (w.x + b)). One pass over rows gives every
such loss and a subgradient at its present weights: a plane that the loss lies above. The least of w.w / 2 plus the highest plane
is a small problem of its own, and a lower bound; passes end when no loss found is further from its bound than the gap asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes after which it's an error, models (groups times classes) at most.
PASSES, MODELS = 500, 20_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """The w that brings w.w / 2 + max_i(a_i w + b_i) lowest, and that value, from the dual over the simplex (pairwise steps)."""
    k = len(b)
    gram, alpha = a @ a.T, np.zeros(k)
    alpha[int(np.argmax(b - np.diag(gram) / 2))] = 1
    g = b - gram @ alpha  # of the dual b.alpha - |a' alpha|^2 / 2
    for _ in range(20_000):
        up, down = int(g.argmax()), int(np.where(alpha > 0, g, np.inf).argmin())
        gap = g[up] - g[down]
        if gap < 1e-10 * (1 + abs(b).max()):
            break
        curve = gram[up, up] - 2 * gram[up, down] + gram[down, down]
        step = min(alpha[down], gap / curve if curve > 0 else np.inf)
        alpha[up] += step
        alpha[down] -= step
        g -= step * (gram[:, up] - gram[:, down])
    v = a.T @ alpha
    return -v, float(b @ alpha - v @ v / 2)


def svm_logo(rows: DataFrame, d: int, classes: list[int], c: float = 1.0, gap: float = 1e-3) -> DataFrame:
    """rows (row_id, group_id, x, y) with label: the class whose linear classifier against the others, fitted without the row's group, is highest.

    The last weight is the intercept, penalised like the others. gap: of a loss to its lower bound, as a share of the loss. Groups
    and classes are bounded lists (an error beyond MODELS of both); of equal values the class listed first is taken.
    """
    kind = dict(rows.dtypes)["group_id"]
    folds = [r[0] for r in rows.select("group_id").distinct().orderBy("group_id").limit(MODELS + 1).collect()]
    if len(folds) * len(classes) > MODELS:
        raise ValueError(f"more than {MODELS} groups times classes")
    table = rows.select("group_id", F.transform("x", lambda v: v.cast("double")).alias("x"), "y")
    n_models = len(folds) * len(classes)
    place = {g: i for i, g in enumerate(folds)}

    def parts(w: np.ndarray, live: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, grad = np.zeros(len(live)), np.zeros((len(live), d + 1))
            fold, cls = live // len(classes), np.array(classes)[live % len(classes)]
            for pdf in batches:
                for i in range(0, len(pdf), 1000):
                    some = pdf.iloc[i : i + 1000]
                    x = np.column_stack([np.stack(some["x"].to_numpy()), np.ones(len(some))])
                    y = np.where(some["y"].to_numpy()[:, None] == cls[None], 1.0, -1.0)
                    out = np.array([place[g] for g in some["group_id"]])[:, None] == fold[None]
                    short = 1 - y * (x @ w[live].T)
                    on = (short > 0) & ~out
                    loss += np.where(on, short, 0).sum(0)
                    grad -= (on * y).T @ x
            yield pd.DataFrame({"loss": [loss.tolist()], "grad": [grad.ravel().tolist()]})

        return run

    w, best, found = np.zeros((n_models, d + 1)), np.full(n_models, np.inf), np.zeros((n_models, d + 1))
    planes: list[tuple[list, list]] = [([], []) for _ in range(n_models)]
    live = np.arange(n_models)
    for _ in range(PASSES):
        sums = table.mapInPandas(parts(w, live), "loss array<double>, grad array<double>").collect()  # a row a task
        loss = c * sum((np.array(r["loss"]) for r in sums), np.zeros(len(live)))
        grad = c * sum((np.array(r["grad"]) for r in sums), np.zeros(len(live) * (d + 1))).reshape(-1, d + 1)
        if not np.isfinite(loss).all():
            raise ValueError("a feature is missing or not a number")
        still = []
        for i, m in enumerate(live.tolist()):
            value = w[m] @ w[m] / 2 + loss[i]
            if value < best[m]:
                best[m], found[m] = value, w[m]
            planes[m][0].append(grad[i])
            planes[m][1].append(loss[i] - grad[i] @ w[m])
            new, bound = lowest(np.array(planes[m][0]), np.array(planes[m][1]))
            if best[m] - bound > gap * max(best[m], 1e-12):
                w[m] = new
                still.append(m)
        live = np.array(still, int)
        if not len(live):
            break
    else:
        raise ValueError(f"the gap is still open after {PASSES} passes")
    models = rows.sparkSession.createDataFrame([(g, found[i * len(classes) : (i + 1) * len(classes)].tolist()) for g, i in place.items()], f"group_id {kind}, w array<array<double>>")
    score = F.transform("w", lambda v: F.aggregate(F.zip_with(F.slice(v, 1, d), "x", lambda a, b: a * b), F.element_at(v, d + 1), lambda s, e: s + e))
    t = rows.join(F.broadcast(models), "group_id").withColumn("__s", score)  # a row a group
    return t.withColumn("label", F.element_at(F.array(*map(F.lit, classes)), F.array_position("__s", F.array_max("__s")).cast("int"))).drop("w", "__s")
