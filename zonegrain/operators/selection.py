"""Choices among many parameter sets, and nested hold-outs, from additive sums.

What a linear fit needs of its rows are sums (count, sums, products), and so is what its error needs. A split's training rows are
the total minus the rows left out, and a group held out inside it is that minus the group: no split is fitted by another pass
over rows, and the number of jobs depends neither on the sets nor on the splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import order, study
from zonegrain.sources import shared

#: The error of a set that can't be fitted.
FAILED = 1e6
#: Splits of a set that one task goes through.
BLOCK = 64


def _size(d: int) -> int:
    return 3 + 2 * d + d * d


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n, sum y, sum y^2, sums of x, of x y, of x x'."""
    return np.concatenate([[len(y), y.sum(), y @ y], x.sum(0), y @ x, (x.T @ x).ravel()])


def _parts(s: np.ndarray, d: int) -> tuple:
    return s[..., 0], s[..., 1], s[..., 2], s[..., 3 : 3 + d], s[..., 3 + d : 3 + 2 * d], s[..., 3 + 2 * d :].reshape(*s.shape[:-1], d, d)


def _scores(s: np.ndarray, d: int, mean: np.ndarray, basis: np.ndarray) -> tuple:
    """The sums of (x - mean) basis, from those of x."""
    n, sy, yy, sx, sxy, g = _parts(s, d)
    z = (sx - n[..., None] * mean) @ basis
    c = (sxy - sy[..., None] * mean) @ basis
    outer = sx[..., :, None] * mean[None, :]
    centred = g - outer - np.swapaxes(outer, -1, -2) + n[..., None, None] * np.outer(mean, mean)
    return n, sy, yy, z, c, basis.T @ centred @ basis


def held_out_error(total: np.ndarray, groups: np.ndarray, d: int, components: float, alpha: float) -> float:
    """Mean squared error of groups, each predicted by ridge (penalty on columns over their norm) on whitened components without it.

    total: sums of all rows; groups: sums of each group. components: how many, or the share of the variance that they reach.
    """
    groups = groups[groups[:, 0] > 0]
    if len(groups) < 2 or not np.isfinite(total).all():
        return FAILED
    n, _, _, sx, _, g = _parts(total, d)
    mean = sx / n
    value, vector = np.linalg.eigh(g - n * np.outer(mean, mean))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    k = int(components) if components >= 1 else int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-300), components - 1e-12)) + 1
    k = min(k, int((value > 1e-12 * max(value[0], 1e-300)).sum()))
    if not k or n < 2:
        return FAILED
    basis = vector[:, :k] / np.sqrt(value[:k] / (n - 1))
    whole, own = _scores(total, d, mean, basis), _scores(groups, d, mean, basis)
    rest = [a - b for a, b in zip(whole, own, strict=True)]
    m, sy, _, z, c, gram = rest
    mz, my = z / m[:, None], sy / m
    gram = gram - m[:, None, None] * mz[:, :, None] * mz[:, None, :]
    ridge = np.einsum("gii->gi", gram)[:, :, None] * np.eye(k) * alpha
    w = np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(gram + ridge, c - m[:, None] * mz * my[:, None], strict=True)])
    b = my - (w * mz).sum(1)
    n, sy, yy, z, c, gram = own
    errors = yy - 2 * (w * c).sum(1) - 2 * b * sy + np.einsum("gi,gij,gj->g", w, gram, w) + 2 * b * (w * z).sum(1) + n * b * b
    error = errors.sum() / n.sum()
    return float(error) if np.isfinite(error) else FAILED


def group_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, s: sums (see _sums) of rows (keys, x array, y) for each value of keys; each batch of rows sends one row a key."""
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*keys).dtypes)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, own in pdf.groupby(keys, dropna=False):
                yield pd.DataFrame([[*key, _sums(np.stack(own["x"].to_numpy()), own["y"].to_numpy(float)).tolist()]], columns=[*keys, "s"])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, np.sum(np.stack(pdf["s"].to_numpy()), 0).tolist()]], columns=[*keys, "s"])

    return rows.select(*keys, "x", "y").mapInPandas(partial, f"{kinds}, s array<double>").groupBy(*keys).applyInPandas(whole, f"{kinds}, s array<double>")


def split_errors(features: DataFrame, grades: DataFrame, components: float = 5, alpha: float = 0.1, by: tuple[str, ...] = ("par_id",), whole: bool = False) -> DataFrame:
    """by, split, error: for each parameter set and each split left out, the error of groups held out of the rows that stay.

    features: by, sample, bin, val. grades: sample, group_id, split (a sample of its own each: leave-one-out), grade. whole: one
    row with split null, nothing left out. A set whose sums aren't finite, or with less than two groups, has the error 1e6. A
    task gets the sums of all groups of a set, and the rows of a block of its splits.
    """
    spark, by = features.sparkSession, list(by)
    arrays = features.groupBy(*by, "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "val"))), lambda e: e["val"].cast("double")).alias("x"))
    rows = shared.saved(arrays.join(grades, "sample").select(*by, "sample", "group_id", F.lit(None).cast("long").alias("split") if whole else F.col("split").cast("long").alias("split"), "x", F.col("grade").cast("double").alias("y")), "rows-of-sets")
    widths = rows.agg(F.max(F.size("x")).alias("d"), F.countDistinct("split").alias("n")).first()
    if not widths.d:
        return spark.createDataFrame([], f"{', '.join(f'{c} {t}' for c, t in features.select(*by).dtypes)}, split long, error double")
    d, blocks = widths.d, max(1, -(-widths.n // BLOCK))
    whole_x = F.when(F.size("x") == d, F.col("x")).otherwise(F.array_repeat(F.lit(float("nan")), d))  # a row that lacks bins fails its set
    rows = rows.withColumn("x", whole_x)
    sums = shared.saved(group_sums(rows, [*by, "group_id"]), "sums-of-sets").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left = (rows.select(*by, "split").distinct() if whole else rows).withColumn("block", F.coalesce(F.pmod(F.xxhash64("split"), F.lit(blocks)), F.lit(0)).cast("int"))
    kinds = ", ".join(f"{c} {t}" for c, t in features.select(*by).dtypes)

    def solve(key: tuple, some: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        out = []
        stacked = np.stack(groups["s"].to_numpy())
        place = {g: i for i, g in enumerate(groups["group_id"])}
        for split, own in some.groupby("split", dropna=False):
            rest = stacked.copy()
            if not whole:
                for g, x, y in zip(own["group_id"], own["x"], own["y"], strict=True):
                    rest[place[g]] -= _sums(x[None], np.array([y]))
                emptied = np.round(rest[:, 0]) == 0
                rest[emptied] = 0
            try:
                error = held_out_error(rest.sum(0), rest, d, components, alpha)
            except np.linalg.LinAlgError:
                error = FAILED
            out.append([*key[:-1], None if pd.isna(split) else int(split), error])
        return pd.DataFrame(out, columns=[*by, "split", "error"]).astype({"split": "Int64"})

    return left.groupBy(*by, "block").cogroup(sums.groupBy(*by, "block")).applyInPandas(solve, f"{kinds}, split long, error double")


def alpha_errors(rows: DataFrame, d: int, alphas: dict[int, float]) -> DataFrame:
    """par_id, group_id, error: the mean squared error of the linear model of each penalty on each group that was left out of it, from one pass of sums."""
    sums = study.fold_sums(rows, d)
    names = [c for c in sums.columns if c != "group_id"]
    total = sums.agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    kind = dict(rows.dtypes)["group_id"]

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for _, r in pdf.iterrows():
                rest = pd.Series({c: float(r[f"all_{c}"]) - float(r[c]) for c in names})
                own = [float(r["n"]), float(r["sy"]), float(r["yy"]), np.array([r[f"s{i}"] for i in range(d)], float), np.array([r[f"c{i}"] for i in range(d)], float), np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)]
                for par, alpha in alphas.items():
                    w = study.ridge(rest, d, alpha, True)
                    n, sy, yy, s, c, g = own
                    v, b = w[:-1], w[-1]
                    out.append([par, r["group_id"], (yy - 2 * v @ c - 2 * b * sy + v @ g @ v + 2 * b * v @ s + n * b * b) / n])
            yield pd.DataFrame(out, columns=["par_id", "group_id", "error"])

    return sums.join(F.broadcast(total)).mapInPandas(solve, f"par_id int, group_id {kind}, error double")


def kfold_inside_loo(rows: DataFrame, d: int, folds: int, key: str = "row_id") -> DataFrame:
    """row_id, y, prediction: each row by the mean of `folds` least-squares models, each fitted on the other rows but one of their folds.

    The other rows, in order of key, are cut into folds of consecutive rows, the first ones a row larger where it doesn't go
    even. A row's folds begin at one of two places each, so sums over the stretches between those places (2 folds + 2 of
    them) are all that a row needs besides itself: total minus itself minus the fold.
    """
    spark = rows.sparkSession
    placed = shared.saved(order.numbered(rows.select(key, F.transform("x", lambda v: v.cast("double")).alias("x"), F.col("y").cast("double").alias("y")), [], [key], "place"), "places")
    n = placed.count()
    if n - 1 < folds or folds < 2:
        return spark.createDataFrame([], f"{key} {dict(rows.dtypes)[key]}, y double, prediction double")
    size, more = divmod(n - 1, folds)
    begins = np.cumsum([0, *(size + (i < more) for i in range(folds))]).tolist()  # among the other rows
    cuts = sorted({c for b in begins for c in (b, b + 1)} | {0, n})
    at = F.lit(0)
    for i, c in enumerate(cuts[1:]):
        at = at + (F.col("place") >= c).cast("int")
    sums = {r["cut"]: np.array(r["s"]) for r in group_sums(placed.withColumn("cut", at).withColumn("all", F.lit(0)), ["cut", "all"]).collect()}
    upto = {c: sum((sums[j] for j in range(i) if j in sums), np.zeros(_size(d))) for i, c in enumerate(cuts)}

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for place, x, y in zip(pdf["place"], pdf["x"], pdf["y"], strict=True):
                own = _sums(x[None], np.array([y]))
                found = []
                for a, b in zip(begins[:-1], begins[1:], strict=True):
                    lo, hi = a + (a >= place), b + (b >= place)
                    fold = upto[hi] - upto[lo] - (own if lo <= place < hi else 0)
                    m, sy, _, sx, sxy, g = _parts(upto[n] - own - fold, d)
                    mx, my = sx / m, sy / m
                    w = np.linalg.lstsq(g - m * np.outer(mx, mx), sxy - m * mx * my, rcond=None)[0]
                    found.append(my + w @ (x - mx))
                out.append(float(np.mean(found)))
            yield pd.DataFrame({key: pdf[key], "y": pdf["y"], "prediction": out})

    return placed.mapInPandas(solve, f"{key} {dict(rows.dtypes)[key]}, y double, prediction double")
