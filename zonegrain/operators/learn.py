"""Models over feature rows: PCA with whitening, stored models and their scores, hold-out logistic fits, explanations, parameter search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonegrain.operators import study
from zonegrain.sources import shared

MODEL = "zone string, n_comp int, mean array<double>, eigvec array<array<double>>, sv array<double>, w_lin array<double>, w_log array<double>, b_lin double, b_log double"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pca(features: DataFrame, n: int | float, by_features: bool = False) -> dict:
    """mean, eigvec (n rows of d), sv: n components, or the fewest that reach a share of the variance.

    Only d means and d * d sums leave the cluster. sv is the standard deviation of a component over n_samples - 1 (by_features:
    over n_features - 1). The largest entry of each component is positive.
    """
    return pca_of(shared.saved(study.listed(features), "pca-rows"), n, by_features)


def pca_of(rows: DataFrame, n: int | float, by_features: bool = False) -> dict:
    """pca() of rows (at, x as study.listed() gives them), which are read three times."""
    mean = dict(rows.select(F.explode(F.arrays_zip("at", "x")).alias("e")).groupBy("e.at").agg(F.avg("e.x")).collect())
    bins = sorted(mean)
    place = {b: i for i, b in enumerate(bins)}
    g = np.zeros((len(bins), len(bins)))
    for i, j, v in study.products(rows, mean).collect():
        g[place[i], place[j]] = g[place[j], place[i]] = v
    samples = rows.count()
    value, vector = np.linalg.eigh(g)
    order = np.argsort(-value)
    value, vector = np.maximum(value[order], 0), vector[:, order].T
    k = int(n) if n >= 1 else int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), n - 1e-12)) + 1
    sign = np.sign(vector[np.arange(len(vector)), np.abs(vector).argmax(1)])
    over = (len(bins) if by_features else samples) - 1
    return {"bins": bins, "place": place, "mean": [mean[b] for b in bins], "eigvec": (vector * sign[:, None])[:k].tolist(), "sv": np.sqrt(value[:k] / max(over, 1)).tolist(), "share": (value[:k] / max(value.sum(), 1e-300)).tolist()}


def project(rows: DataFrame, model: dict, whiten: bool = True) -> DataFrame:
    """rows (sample, x) with scores, an array: (x - mean) * component, over its deviation; nulls where x has another length or a null."""
    mean, k = np.array(model["mean"], float), len(model["eigvec"])
    kept = np.array([[x / s if whiten and s > 0 else x for x in v] for v, s in zip(model["eigvec"], model["sv"], strict=True)], float).reshape(k, len(mean))

    @F.arrow_udf("array<double>")
    def scores(x: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(x), 0).to_numpy()
        val = x.flatten()
        holes = np.bincount(np.repeat(np.arange(len(x)), n)[val.is_null().to_numpy(zero_copy_only=False)], minlength=len(x))
        whole = (n == len(mean)) & (holes == 0)
        out = np.zeros((len(x), k))
        out[whole] = (val.to_numpy(zero_copy_only=False)[np.repeat(whole, n)].astype(float).reshape(-1, len(mean)) - mean) @ kept.T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(out.ravel(), mask=np.repeat(~whole, k)))

    return rows.withColumn("scores", scores(F.col("x").cast("array<double>")))


def score_model(rows: DataFrame, models: DataFrame, mode: str = "model") -> DataFrame:
    """rows (sample, zone, x) with linear and logistic predictions of the stored model of their zone.

    mode model: centred by the stored mean, class by the raw logit > 0.5. mode batch: centred by the batch's own mean, class by
    probability > 0.5.
    """
    t = rows.join(F.broadcast(models), "zone")  # a row a zone
    mean = F.col("mean")
    if mode == "batch":
        own = rows.select("zone", F.posexplode("x").alias("i", "v")).groupBy("zone", "i").agg(F.avg("v").alias("m")).groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("l")).select("zone", F.col("l.m").alias("own"))
        t, mean = t.join(F.broadcast(own), "zone"), F.col("own")
    t = t.withColumn("c", F.zip_with("x", mean, lambda a, b: a - b))
    t = t.withColumn("p", F.zip_with(F.transform("eigvec", lambda v: dot(F.col("c"), v)), F.col("sv"), lambda a, s: a / s))
    logit = dot(F.col("p"), F.col("w_log")) + F.col("b_log")
    probability = 1 / (1 + F.exp(-logit))
    return t.select("sample", "zone", (dot(F.col("p"), F.col("w_lin")) + F.col("b_lin")).alias("pred_lin"), probability.alias("pred_log"), ((logit if mode == "model" else probability) > 0.5).cast("int").alias("label"))


def folded(model: dict, w: list[float]) -> list[float]:
    """One coefficient for each feature: the components and the linear weights in one."""
    return (np.array(model["eigvec"]).T @ (np.array(w) / np.array(model["sv"]))).tolist()


def _newton_sums(t: DataFrame, d: int, by: list[str]) -> DataFrame:
    """Gradient and Hessian sums of the logistic loss of rows (x, y, w)."""
    x, p = [F.get("x", F.lit(i)) for i in range(d)], F.col("p")
    t = t.withColumn("p", 1 / (1 + F.exp(-dot(F.col("x"), F.col("w")))))
    return t.groupBy(*by).agg(*(F.sum((F.col("y").cast("double") - p) * x[i]).alias(f"g{i}") for i in range(d)), *(F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)))


def _newton_step(r: dict, w: np.ndarray, d: int, c: float) -> np.ndarray:
    g = c * np.array([r[f"g{i}"] or 0.0 for i in range(d)]) - w
    h = c * np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]) + np.eye(d)
    return np.linalg.solve(h, g)


#: Change of a weight at which Newton steps end.
STILL = 1e-9


def logistic_fit(rows: DataFrame, d: int, c: float = 1.0) -> np.ndarray:
    """Weights of the L2 logistic model (no intercept) of rows (x, y), by Newton steps until they stand still."""
    w = np.zeros(d)
    while True:
        r = _newton_sums(rows.withColumn("w", F.array(*(F.lit(float(v)) for v in w))), d, []).first().asDict()
        step = _newton_step(r, w, d, c)
        _finite(step)
        w = w + step
        if np.abs(step).max() < STILL:
            return w


def _finite(step: np.ndarray) -> None:
    if not np.isfinite(step).all():
        raise ValueError("the logistic fit isn't finite: a feature is missing or not a number")


#: Groups that are held out at most: every step sends each row to all models but its own group's.
FOLDS = 5_000


def logistic_folds(rows: DataFrame, d: int, c: float = 1.0) -> DataFrame:
    """group_id, w: the L2 logistic model (no intercept) of rows (group_id, x, y) without that group.

    All folds start from the fit on everything and take Newton steps together until none moves: a pass gives the sums of
    each fold, to which a row is sent for every group but its own, one row of weights a group. Groups are a bounded list
    (an error beyond FOLDS); a feature that isn't finite is an error too.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["group_id"]
    folds = [r[0] for r in rows.select("group_id").distinct().orderBy("group_id").limit(FOLDS + 1).collect()]
    if len(folds) > FOLDS:
        raise ValueError(f"more than {FOLDS} groups to hold out")
    start = logistic_fit(rows, d, c)
    w = {f: start.copy() for f in folds}
    live = list(folds) if len(folds) > 1 else []
    while live:
        models = F.array(*(F.struct(F.lit(f).cast(kind).alias("fold"), F.array(*(F.lit(float(x)) for x in w[f])).alias("w")) for f in live))
        sent = rows.select("group_id", "x", "y", F.explode(F.filter(models, lambda m: m["fold"] != F.col("group_id"))).alias("m")).select("x", "y", F.col("m.fold").alias("fold"), F.col("m.w").alias("w"))
        moved = []
        for r in _newton_sums(sent, d, ["fold"]).collect():
            step = _newton_step(r.asDict(), w[r["fold"]], d, c)
            _finite(step)
            w[r["fold"]] = w[r["fold"]] + step
            if np.abs(step).max() >= STILL:
                moved.append(r["fold"])
        live = moved
    return spark.createDataFrame([(f, v.tolist()) for f, v in w.items()], f"group_id {kind}, w array<double>")


def logistic_logo(rows: DataFrame, d: int, c: float = 1.0, models: DataFrame | None = None) -> DataFrame:
    """rows (row_id, group_id, x, y) with the probability of the model (logistic_folds) that was fitted without their group."""
    table = logistic_folds(rows, d, c) if models is None else models
    return rows.join(F.broadcast(table), "group_id").withColumn("probability", 1 / (1 + F.exp(-dot(F.col("x"), F.col("w"))))).drop("w")  # a row a group


def explained(rows: DataFrame, d: int, alpha: float = 1.0) -> DataFrame:
    """row_id, bin, value: w_j * (x_ij - mean_j), with weights and means of the folds without the row's group."""
    sums = study.fold_sums(rows, d)
    total = sums.agg(F.sum("n").alias("all_n"), *(F.sum(f"s{i}").alias(f"all_s{i}") for i in range(d)))
    means = sums.join(F.broadcast(total)).select("group_id", F.array(*((F.col(f"all_s{i}") - F.col(f"s{i}")) / (F.col("all_n") - F.col("n")) for i in range(d))).alias("m"))
    t = rows.join(study.fold_models(rows, d, alpha), "group_id").join(means, "group_id")
    value = F.zip_with(F.zip_with("x", "m", lambda a, b: a - b), F.slice("w", 1, d), lambda a, b: a * b)
    return t.select("row_id", F.posexplode(value).alias("bin", "value"))


def lda(rows: DataFrame, d: int, classes: list[int], ridge: float = 1e-6) -> DataFrame:
    """rows (row_id, group_id, x, y) with the class of linear discriminants fitted without their group.

    Class counts, sums and pooled products are additive: a fold is the total minus its group. One solve for each fold.
    """
    import pandas as pd

    x = [F.get("x", F.lit(i)) for i in range(d)]
    one = lambda k: (F.col("y") == k).cast("double")
    sums = rows.groupBy("group_id").agg(*(F.sum(one(k)).alias(f"n{k}") for k in classes), *(F.sum(one(k) * x[i]).alias(f"s{k}_{i}") for k in classes for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)))
    names = [c for c in sums.columns if c != "group_id"]
    total = sums.agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    left = sums.join(F.broadcast(total)).select("group_id", *((F.col(f"all_{c}") - F.col(c)).alias(c) for c in names))

    def solve(parts):
        for pdf in parts:
            out = []
            for _, r in pdf.iterrows():
                n = np.array([max(r[f"n{k}"], 1e-9) for k in classes])
                m = np.array([[r[f"s{k}_{i}"] for i in range(d)] for k in classes]) / n[:, None]
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - (m * n[:, None]).T @ m
                w = np.linalg.solve(g / max(n.sum() - len(classes), 1) + ridge * np.eye(d), m.T).T
                out.append(np.column_stack([w, np.log(n / n.sum()) - 0.5 * (w * m).sum(1)]).tolist())
            yield pd.DataFrame({"group_id": pdf["group_id"], "w": out})

    models = left.mapInPandas(solve, f"group_id {dict(rows.dtypes)['group_id']}, w array<array<double>>")
    t = rows.join(models, "group_id").withColumn("s", F.transform("w", lambda v: dot(F.slice(v, 1, d), F.col("x")) + F.element_at(v, d + 1)))
    return t.withColumn("label", F.element_at(F.array(*map(F.lit, classes)), F.array_position("s", F.array_max("s")).cast("int"))).drop("w", "s")


def first_rows(rows: DataFrame, split: int, order: str) -> DataFrame:
    """rows with `train`: true for the first `split` of them by distinct values of `order`; rows of an equal value go together."""
    last = rows.select(order).orderBy(order).limit(split).agg(F.max(order).alias("__last"))  # one row
    return rows.join(F.broadcast(last)).withColumn("train", F.coalesce(F.col(order) <= F.col("__last"), F.lit(False))).drop("__last")


#: Rows of a task of a forest's fit, where there are more than one for each core.
FOREST_ROWS = 100_000


def forest_logo(rows: DataFrame, d: int, trees: int = 50, seed: int = 42) -> DataFrame:
    """rows (row_id, group_id, x, y) with the probability of a random forest fitted without their group, one distributed fit for each group.

    In each round of a fit a task sends sums of all open nodes of all trees, however few its rows are: tasks are as many as
    cores, or as the rows need. Draws are by task, so rows are dealt and ordered by row_id.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = shared.saved(rows, "forest-rows")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FOREST_ROWS))
    t = rows.repartition(n, "row_id").sortWithinPartitions("row_id").withColumn("features", array_to_vector("x")).withColumn("label", F.col("y").cast("double")).persist()
    out = None
    for g in [r[0] for r in t.select("group_id").distinct().orderBy("group_id").collect()]:
        model = RandomForestClassifier(numTrees=trees, seed=seed).fit(t.where(F.col("group_id") != g))
        one = model.transform(t.where(F.col("group_id") == g)).select("row_id", "group_id", "y", F.element_at(vector_to_array("probability"), 2).alias("probability"))
        out = one if out is None else out.unionByName(one)
    return out
