"""Studies over feature and grade tables: joins, metrics, curves, ranks, hold-out fits and resampling.

Hold-out fits never repeat a pass over the data: Gram sums are additive, so a fold's statistics are the total minus its group's.
Small solves (d by d) run beside each other, one row a fold, in a pandas function.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zonegrain.functions.columns import lcg
from zonegrain.operators import order
from zonegrain.sources import shared

# --- joins ------------------------------------------------------------------------------------------------------------


def with_grades(features: DataFrame, grades: DataFrame) -> DataFrame:
    return features.join(grades, "sample")


def unmatched(features: DataFrame, grades: DataFrame) -> DataFrame:
    """Samples that one side lacks: (sample, missing)."""
    a, b = features.select("sample").distinct(), grades.select("sample").distinct()
    return a.join(b, "sample", "left_anti").withColumn("missing", F.lit("grade")).unionByName(b.join(a, "sample", "left_anti").withColumn("missing", F.lit("features")))


def repeated_grades(grades: DataFrame, n: int) -> DataFrame:
    """Each grade for its n sub-images."""
    return grades.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def tiles(images: DataFrame, n_y: int, n_x: int, height: int, width: int, to_edge: bool = False) -> DataFrame:
    """Pixels by evenly spaced windows that may overlap: image, sub, y, x (in the window), val.

    The step is (length - size) // n, or with to_edge (length - size) // (n - 1). A pixel computes which windows it lies in.
    """
    ends = images.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    t = images.join(ends, "image")
    for a, n, size, length in (("y", n_y, height, "h"), ("x", n_x, width, "w")):
        parts = max(1, n - 1) if to_edge else n
        step = F.greatest(F.floor((F.col(length) - size) / parts), F.lit(1)).cast("int")
        first = F.greatest(F.lit(0), F.ceil((F.col(a) - size + 1) / step)).cast("int")
        last = F.least(F.lit(n - 1), F.floor(F.col(a) / step)).cast("int")
        t = t.withColumn(f"t{a}", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn(f"p{a}", F.col(a) - F.col(f"t{a}") * step)
    return t.select("image", (F.col("ty") * n_x + F.col("tx")).alias("sub"), F.col("py").alias("y"), F.col("px").alias("x"), "val")


def merge_halves(left: DataFrame, right: DataFrame, shift: int) -> DataFrame:
    """Two images that overlap: the right one, moved by `shift` columns, wins."""
    moved = right.withColumn("x", F.col("x") + shift)
    both = left.withColumn("p", F.lit(0)).unionByName(moved.withColumn("p", F.lit(1)))
    return both.groupBy("image", "y", "x").agg(F.max_by("val", "p").alias("val"))


def combined(predictions: DataFrame, combiner: Callable[[str], Column] = F.avg) -> DataFrame:
    """Predictions of sub-images to one for each sample."""
    return predictions.groupBy("sample").agg(combiner("prediction").alias("prediction"))


def without_zero_bins(features: DataFrame) -> DataFrame:
    """Features without bins that are zero in every sample."""
    some = features.groupBy("bin").agg(F.max(F.abs("val")).alias("m")).where("m > 0").select("bin")
    return features.join(some, "bin", "left_semi")


# --- features ---------------------------------------------------------------------------------------------------------


def standardised(features: DataFrame, by: str = "bin", scale: bool = True) -> DataFrame:
    """val minus its mean over the axis (bin: over samples, sample: over bins), over the population deviation."""
    m = features.groupBy(by).agg(F.avg("val").alias("m"), F.stddev_pop("val").alias("s"))
    centred = F.col("val") - F.col("m")
    return features.join(m, by).select("sample", "bin", (centred / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0) if scale else centred).alias("val"))


def listed(features: DataFrame, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """by, at, x: the bins of a sample in order, and its features in that order."""
    t = features.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "val"))).alias("l"))
    return t.select(*by, F.col("l.bin").alias("at"), F.col("l.val").alias("x"))


def rows_of(features: DataFrame) -> DataFrame:
    """sample, x: the features of a sample as an array in order of bin."""
    return listed(features).select("sample", "x")


def gram(features: DataFrame) -> DataFrame:
    """i, j, val for bins i <= j that some sample has both: sums of products over samples."""
    return products(listed(features.where(F.col("sample").isNotNull() & F.col("bin").isNotNull())))


#: Numbers of a block whose products numpy sums at once.
BLOCK = 1_000_000


def products(rows: DataFrame, mean: dict | None = None) -> DataFrame:
    """i, j, val of rows (at, x as listed() gives them) for bins i <= j: sums of products, of features less the mean of their bin.

    numpy multiplies the rows of an Arrow batch in blocks of about BLOCK numbers and hands on its d * d sums, d the bins of the
    batch; they are added before the shuffle. A feature that is null counts in no sum, and sums of nothing are null.
    """
    kind = dict(rows.dtypes)["at"][len("array<") : -1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("at")).to_numpy())
            bins, val = b.column("at").flatten(), b.column("x").flatten()
            name, bin_ = np.unique(bins.to_numpy(zero_copy_only=False), return_inverse=True)
            some, d = val.is_valid().to_numpy(zero_copy_only=False), len(name)
            val = np.where(some, val.to_numpy(zero_copy_only=False), 0).astype(float)
            if mean is not None:
                val = np.where(some, val - np.array([np.nan if mean[k] is None else mean[k] for k in name.tolist()], float)[bin_], 0)
            g, known, met = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
            lot = max(1, BLOCK // max(d, 1))
            for start in range(0, b.num_rows if d else 0, lot):
                n = min(lot, b.num_rows - start)
                own = slice(*np.searchsorted(row, [start, start + n]))
                at = (row[own] - start) * d + bin_[own]
                x, has, here = (np.bincount(at, w, n * d).reshape(n, d) for w in (val[own], some[own], np.ones(len(at))))
                # What isn't finite must not meet the zeros that stand for what is missing.
                odd = ~np.isfinite(x).all(1) & ~(has > 0).all(1)
                g += x[~odd].T @ x[~odd]
                for a, k in zip(x[odd], has[odd] > 0, strict=True):
                    g[np.ix_(k, k)] += np.outer(a[k], a[k])
                known += has.T @ has
                met += here.T @ here
            i, j = np.nonzero(np.triu(met))
            yield pa.RecordBatch.from_arrays([pa.array(name[i], bins.type), pa.array(name[j], bins.type), pa.array(g[i, j], mask=known[i, j] == 0)], names=["i", "j", "val"])

    return rows.select("at", F.col("x").cast("array<double>").alias("x")).mapInArrow(sums, f"i {kind}, j {kind}, val double").groupBy("i", "j").agg(F.sum("val").alias("val"))


# --- metrics ----------------------------------------------------------------------------------------------------------


def confusion(t: DataFrame, actual: str, predicted: str, n: int) -> DataFrame:
    """Counts on the whole grid of labels 0 to n - 1."""
    axis = F.sequence(F.lit(0), F.lit(n - 1))
    grid = t.sparkSession.range(1).select(F.explode(axis).alias("actual")).withColumn("predicted", F.explode(axis))
    counts = t.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dice(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """2 * both / (a + b) of two sparse masks."""
    both = a.select(*keys).withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.select(*keys).withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    t = both.groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return t.groupBy(*by).agg((2.0 * F.sum(F.col("a") * F.col("b")) / (F.sum("a") + F.sum("b") + 1e-9)).alias("dice"))


def regression_metrics(t: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """mse, r2 and the sum of absolute errors, of each value of by."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return t.groupBy(*by).agg(F.avg((y - p) * (y - p)).alias("mse"), (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"), F.sum(F.abs(y - p)).alias("abs_error"))


def class_metrics(t: DataFrame, actual: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, f1, support and accuracy at a threshold."""
    y, p = F.col(actual).cast("int"), (F.col(score) >= threshold).cast("int")
    s = t.agg(F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    one = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select(one(tp, tp + fp).alias("precision"), one(tp, tp + fn).alias("recall"), one(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"), ((F.col("n") - fp - fn) / F.col("n")).alias("accuracy"))


def with_rank(t: DataFrame, value: str, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """t with average ranks of a value, among rows of equal by. Distinct values are counted and ordered, in buckets that take their offsets from the totals of lower ones."""
    counts = t.groupBy(*by, value).agg(F.count("*").alias("c"))
    ranked = _offsets(counts, value, by=by).select(*by, value, (F.col("before") + (F.col("c") + 1) / 2).alias(name))
    return t.join(ranked, [*by, value])


def _below(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts lie below a value, by binary search."""
    if not cuts:
        return F.lit(0)
    n, table = 1 << len(cuts).bit_length(), F.array(*map(F.lit, cuts))
    steps = F.array(*(F.lit(n >> i) for i in range(1, n.bit_length())))
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) < value), step).otherwise(0))


def _offsets(counts: DataFrame, value: str, desc: bool = False, sums: tuple[str, ...] = ("c",), by: tuple[str, ...] = ()) -> DataFrame:
    """counts with `before` (before_<sum>): totals of all rows (of equal by) with a smaller value, without one task that orders all.

    Values are dealt by quantiles to buckets; a bucket is ordered by itself, and takes what lies below it from the bucket
    totals, one row a bucket.
    """
    spark = counts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = counts.select(F.percentile_approx(value, [i / n for i in range(1, n)] or [0.5]).alias("q")).first()[0] or []
    cuts = sorted(set(cuts))
    at = _below(F.col(value), cuts)
    placed = counts.withColumn("bucket", -at if desc else at)
    totals = placed.groupBy(*by, "bucket").agg(*(F.sum(c).alias(f"t_{c}") for c in sums))
    lower = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "bucket", *(F.coalesce(F.sum(f"t_{c}").over(lower), F.lit(0)).alias(f"b_{c}") for c in sums))
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc(value) if desc else F.asc(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"w_{c}") for c in sums)).join(F.broadcast(base), [*by, "bucket"])
    names = {c: "before" if len(sums) == 1 else f"before_{c}" for c in sums}
    return out.select(*counts.columns, *((F.col(f"b_{c}") + F.col(f"w_{c}")).alias(names[c]) for c in sums))


def student_p(t: float, df: float) -> float:
    """Chance of a Student t at least as far from 0: the incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if x > 0 else 0.0

    def fraction(x: float, a: float, b: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 500):
            for e in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                c, d = 1 + e / c, 1 / (1 + e * d)
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def _one_number(f: Callable[..., float]) -> Callable[..., Column]:
    """f for columns of a table of one row (a report)."""
    return F.udf(lambda *x: None if None in x else float(f(*x)), "double")


def spearman(t: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rho and n: the correlation of average ranks; and p of no correlation by Student's t; of each value of by."""
    r = with_rank(with_rank(t.select(*by, a, b), a, "ra", by), b, "rb", by)
    rho = r.groupBy(*by).agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))
    p = _one_number(lambda rho, n: student_p(rho * math.sqrt(max(n - 2, 0) / max(1 - rho * rho, 1e-300)), max(n - 2, 1)))
    return rho.withColumn("p", p("rho", "n"))


def wilcoxon(t: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The smaller of the signed rank sums, n, z and p of the normal approximation, with ties taken into account; zero differences are dropped; of each value of by."""
    d = t.select(*by, (F.col(a) - F.col(b)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    s = with_rank(d, "size", "rank", by).groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0)).alias("minus"), F.count("*").alias("n"))
    c = F.col("c").cast("double")
    ties = d.groupBy(*by, "size").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum(c * c * c - c).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.least("plus", "minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    both = s.join(F.broadcast(ties), list(by)) if by else s.join(F.broadcast(ties))
    return both.select(*by, F.least("plus", "minus").alias("statistic"), "n", z.alias("z")).withColumn("p", _one_number(lambda z: math.erfc(abs(z) / math.sqrt(2)))("z"))


def roc_points(t: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, tp, fp, fn, tn, tpr, fpr, precision at each distinct score, from the highest down."""
    c = t.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("q"))
    o = _offsets(c, "threshold", True, ("p", "q"))
    all_ = t.agg(F.sum(F.col(label).cast("long")).alias("np"), F.sum((1 - F.col(label)).cast("long")).alias("nq"))
    tp, fp = F.col("before_p") + F.col("p"), F.col("before_q") + F.col("q")
    return o.join(F.broadcast(all_)).select("threshold", "p", "q", tp.alias("tp"), fp.alias("fp"), (tp / F.col("np")).alias("tpr"), (fp / F.col("nq")).alias("fpr"), (tp / (tp + fp)).alias("precision"))


def auc(t: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve from rank sums: right under ties; of each value of by."""
    c = t.groupBy(*by, F.col(score).alias("v")).agg(F.count("*").alias("c"), F.sum(F.col(label).cast("long")).alias("p"))
    r = _offsets(c, "v", by=by).groupBy(*by).agg(F.sum(F.col("p") * (F.col("before") + (F.col("c") + 1) / 2)).alias("s"), F.sum("p").alias("np"), F.sum(F.col("c") - F.col("p")).alias("nq"))
    return r.select(*by, ((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nq"))).alias("auc"))


def average_precision(t: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of recall steps times precision, and the share of positives."""
    return roc_points(t, label, score).agg(F.sum(F.col("p") * F.col("precision")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("p") + F.col("q")).alias("n")).select((F.col("s") / F.col("np")).alias("average_precision"), (F.col("np") / F.col("n")).alias("baseline"))


def class_weights(t: DataFrame, label: str) -> DataFrame:
    """Inverse frequencies, scaled so that the largest is 1."""
    c = t.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.min("n").alias("least")))).select("label", "n", (F.col("least") / F.col("n")).alias("weight"))


def curve_at(points: DataFrame, grid: int = 1001, key: list[str] | None = None) -> DataFrame:
    """tpr at evenly spaced fpr by linear interpolation between curve points (fpr, tpr); 0 at the first.

    A segment of the curve makes the grid points that lie in it; of vertical segments the top counts.
    """
    key = key or []
    top = points.groupBy(*key, "fpr").agg(F.max("tpr").alias("tpr"))
    w = Window.partitionBy(*key).orderBy("fpr")
    s = top.select(*key, F.coalesce(F.lag("fpr").over(w), F.lit(0.0)).alias("f0"), F.coalesce(F.lag("tpr").over(w), F.lit(0.0)).alias("t0"), F.col("fpr").alias("f1"), F.col("tpr").alias("t1"))
    n = grid - 1
    lo, hi = F.floor(F.col("f0") * n).cast("int") + 1, F.floor(F.col("f1") * n + 1e-9).cast("int")
    inner = s.withColumn("g", F.explode(F.when(lo <= hi, F.sequence(lo, hi)))).select(*key, "g", (F.col("t0") + (F.col("g") / n - F.col("f0")) / (F.col("f1") - F.col("f0")) * (F.col("t1") - F.col("t0"))).alias("tpr"))
    start = points.select(*key).distinct() if key else points.sparkSession.range(1)
    return inner.unionByName(start.select(*key, F.lit(0).alias("g"), F.lit(0.0).alias("tpr")))


# --- hold-out fits ----------------------------------------------------------------------------------------------------


def fold_sums(rows: DataFrame, d: int) -> DataFrame:
    """Additive statistics of each group from (group_id, x array, y): n, sums, products. One pass, partial sums before the shuffle."""
    x = lambda i: F.get("x", F.lit(i))
    y = F.col("y").cast("double")
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("yy"), *(F.sum(x(i)).alias(f"s{i}") for i in range(d)), *(F.sum(x(i) * y).alias(f"c{i}") for i in range(d)), *(F.sum(x(i) * x(j)).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)))


def ridge(stat: pd.Series, d: int, alpha: float, normalise: bool, lasso: bool = False) -> np.ndarray:
    """Coefficients and intercept from sums; the penalty acts on centred columns over their L2 norm if normalise."""
    n, mx, my = stat["n"], np.array([stat[f"s{i}"] for i in range(d)]) / stat["n"], stat["sy"] / stat["n"]
    g = np.array([[stat[f"g{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) - n * np.outer(mx, mx)
    c = np.array([stat[f"c{i}"] for i in range(d)]) - n * mx * my
    norm = np.sqrt(np.maximum(np.diag(g), 1e-300)) if normalise else np.ones(d)
    if lasso:
        z, b, w = g / np.outer(norm, norm), c / norm, np.zeros(d)
        for _ in range(200):
            for i in range(d):
                r = b[i] - z[i] @ w + z[i, i] * w[i]
                w[i] = np.sign(r) * max(abs(r) - alpha * n, 0) / max(z[i, i], 1e-300)
        w = w / norm
    else:
        w = np.linalg.lstsq(g + alpha * np.diag(norm**2), c, rcond=None)[0]
    return np.append(w, my - mx @ w)


def fold_models(rows: DataFrame, d: int, alpha: float = 1.0, normalise: bool = True, lasso: bool = False) -> DataFrame:
    """group_id, w (array): the linear model fitted without that group, last its intercept."""
    sums = fold_sums(rows, d)
    names = [c for c in sums.columns if c != "group_id"]
    total = sums.agg(*(F.sum(c).alias(f"all_{c}") for c in names))
    left = sums.join(F.broadcast(total)).select("group_id", *((F.col(f"all_{c}") - F.col(c)).cast("double").alias(c) for c in names))

    def solve(parts):
        for pdf in parts:
            yield pd.DataFrame({"group_id": pdf["group_id"], "w": [ridge(r, d, alpha, normalise, lasso).tolist() for _, r in pdf.iterrows()]})

    kind = dict(rows.dtypes)["group_id"]
    return left.mapInPandas(solve, f"group_id {kind}, w array<double>")


def predict(rows: DataFrame, models: DataFrame, d: int) -> DataFrame:
    """rows with the prediction of the model that was fitted without their group."""
    p = sum((F.get("w", F.lit(i)) * F.get("x", F.lit(i)) for i in range(d)), F.get("w", F.lit(d)))
    return rows.join(models, "group_id").withColumn("prediction", p).drop("w")


def coefficient_means(models: DataFrame) -> DataFrame:
    """bin, coef: means over folds; the last is the intercept."""
    return models.select(F.posexplode("w").alias("bin", "c")).groupBy("bin").agg(F.avg("c").alias("coef"))


def group_folds(rows: DataFrame, k: int, key: str = "group_id") -> DataFrame:
    """group, n, fold: groups from the largest down (of equal ones the lowest first), each to the fold with the fewest rows so far (of equal ones the first).

    Rows are counted by group first; the choice is one after the other by nature, over one number a group.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", key], ascending=[False, True], kind="stable")
        load, fold = [(0, i) for i in range(k)], []
        for n in pdf["n"].tolist():
            have, i = heapq.heappop(load)
            fold.append(i)
            heapq.heappush(load, (have + n, i))
        return pdf.assign(fold=fold)[[key, "n", "fold"]]

    return sizes.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(deal, f"{key} {dict(rows.dtypes)[key]}, n long, fold int")


#: Samples of a block whose distances to another block a task finds.
NEAR = 16_384


def knn(rows: DataFrame, k: int = 5) -> DataFrame:
    """sample, prediction: mean of the k nearest other samples' y, weighted by 1 / distance; equal points decide alone. rows: sample, x, y.

    Blocks of at most about NEAR samples are paired, so that a task holds two blocks whatever the size of the table, and each
    block pair keeps its k best before they meet. Products of the points tell which can be among them, differences decide.
    """
    spark = rows.sparkSession
    n = max(2, int(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5), -(-rows.count() // NEAR))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n))
    q = rows.select("sample", F.col("x").alias("qx")).withColumn("a", part("sample")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = rows.select(F.col("sample").alias("other"), "x", "y").withColumn("b", part("other")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def best(_, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"sample": [], "other": [], "d2": [], "y": []})
        a, b = np.stack(left["qx"].to_numpy()).astype(float), np.stack(right["x"].to_numpy()).astype(float)
        mine, other, y = left["sample"].to_numpy(), right["other"].to_numpy(), right["y"].to_numpy().astype(float)
        sa, sb = (a**2).sum(1), (b**2).sum(1)
        out = []
        for i in range(0, len(a), 256):
            some = slice(i, i + 256)
            d2 = sa[some, None] + sb[None] - 2 * a[some] @ b.T
            d2[mine[some, None] == other[None]] = np.inf
            m = min(k, d2.shape[1])
            most = np.partition(d2, m - 1, axis=1)[:, m - 1] + 1e-11 * (sa[some] + sb.max())
            row, at = np.nonzero((d2 <= most[:, None]) & np.isfinite(d2))
            exact = np.concatenate([((a[i + row[j : j + 65536]] - b[at[j : j + 65536]]) ** 2).sum(1) for j in range(0, max(len(row), 1), 65536)])
            by = np.lexsort((other[at], exact, row))
            row, at, exact = row[by], at[by], exact[by]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"sample": mine[some][row[keep]], "other": other[at[keep]], "d2": exact[keep], "y": y[at[keep]]}))
        return pd.concat(out)

    near = q.groupBy("a", "b").cogroup(r.groupBy("a", "b")).applyInPandas(best, "sample long, other long, d2 double, y double")
    rank = F.row_number().over(Window.partitionBy("sample").orderBy("d2", "other"))
    top = near.withColumn("r", rank).where(F.col("r") <= k).withColumn("zero", F.min("d2").over(Window.partitionBy("sample")) == 0)
    w = F.when(F.col("zero"), (F.col("d2") == 0).cast("double")).otherwise(1 / F.sqrt("d2"))
    return top.groupBy("sample").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))


# --- resampling -------------------------------------------------------------------------------------------------------


#: Draws that a task makes or looks up, draws of a block, and rows of a replicate that a task orders.
_TASK, _BLOCK, _ORDERED = 1_000_000, 50_000, 200_000


def _resampled(t: DataFrame, label: str, score: str, key: str, replicates: int, seed: int) -> DataFrame:
    """rep, score, p, q (draws of label 1 and of label 0 with that score), below_p, below_q (those of lower scores), np, nq (all of the replicate).

    Draws are made in blocks, and their number sets that of the tasks, so that a task holds no more of a larger table. Scores
    are dealt to buckets by quantiles of the table; a bucket of a replicate is ordered by itself.
    """
    size = t.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n"))
    total = size.agg(F.sum("n")).first()[0] or 0
    tasks = replicates * total // _TASK + 1
    numbered = order.numbered(t.select(F.col(label).alias("y"), F.col(score).alias("score"), F.col(key).alias("__key")), ["y"], ["__key"], "i").drop("__key")
    blocks = size.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("from", F.explode(F.expr(f"sequence(0, n - 1, {_BLOCK})"))).repartition(tasks)
    draws = blocks.withColumn("j", F.explode(F.sequence("from", F.least(F.col("from") + _BLOCK, F.col("n")) - 1)))
    picks = draws.select("rep", "y", F.pmod(lcg(F.col("rep") * 1000003 + F.col("j") * 7919 + F.col("y") * 104729 + seed), F.col("n")).alias("i"))
    got = picks.repartition(tasks, "y", "i").join(numbered.repartition(tasks, "y", "i"), ["y", "i"])
    cuts = total // _ORDERED
    cuts = sorted(set(t.select(F.percentile_approx(score, [i / (cuts + 1) for i in range(1, cuts + 1)])).first()[0] or [])) if cuts else []
    counts = got.groupBy("rep", "score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum((1 - F.col("y")).cast("long")).alias("q"))
    counts = shared.saved(counts.withColumn("bucket", _below(F.col("score"), cuts)), "drawn")
    lower = Window.partitionBy("rep").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    whole = Window.partitionBy("rep")
    sums = counts.groupBy("rep", "bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    base = sums.select("rep", "bucket", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"b_{c}") for c in "pq"), *(F.sum(c).over(whole).alias(f"n{c}") for c in "pq"))
    within = Window.partitionBy("rep", "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"w_{c}") for c in "pq")).join(base, ["rep", "bucket"])
    return placed.select("rep", "score", "p", "q", *((F.col(f"b_{c}") + F.col(f"w_{c}")).alias(f"below_{c}") for c in "pq"), "np", "nq")


def bootstrap_auc(t: DataFrame, label: str, score: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, auc: stratified resamples. Row i of a stratum's n draws picks a row by plain modular arithmetic on (replicate, i), so any partitioning gives the same."""
    c, before = F.col("p") + F.col("q"), F.col("below_p") + F.col("below_q")
    r = _resampled(t, label, score, key, replicates, seed).groupBy("rep").agg(F.sum(F.col("p") * (before + (c + 1) / 2)).alias("s"), F.max("np").alias("np"), F.max("nq").alias("nq"))
    return r.select(F.col("rep").alias("replicate"), ((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nq"))).alias("auc"))


def interval(t: DataFrame, value: str, alpha: int = 95, exact: bool = False) -> DataFrame:
    """Mean and limits over replicates. By default whole percentiles, (100 - alpha) // 2; exact: half of them."""
    lo = (100 - alpha) / 2 if exact else (100 - alpha) // 2
    hi = 100 - lo if exact else alpha + lo
    return t.agg(F.avg(value).alias("mean"), F.percentile(value, lo / 100).alias("low"), F.percentile(value, hi / 100).alias("high"))


def parameter_sets(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A random set within the ranges for each id, repeatable under any partitioning: odd kernels 3 to 25, sigma up to its kernel, 3 <= large < 28, 1 <= small < large (the radii), odd windows 3 to 15."""
    draw = lambda i, m: F.pmod(lcg(F.col("id") * 15485863 + i * 32452843 + seed), m if isinstance(m, Column) else F.lit(m))
    t = ids.select(F.col("id").alias("par_id"), "id", *((3 + 2 * draw(i, 12)).alias(c) for i, c in enumerate(("ks1", "ks2"))), (3 + draw(2, 25)).alias("large"), *((3 + 2 * draw(i + 3, 7)).alias(c) for i, c in enumerate(("wc", "wl", "ws"))))
    return t.select("par_id", "ks1", "ks2", (1 + draw(6, F.col("ks1"))).alias("sigma1"), (1 + draw(7, F.col("ks2"))).alias("sigma2"), F.lit(8).alias("N"), "large", (1 + draw(8, F.col("large") - 1)).alias("small"), "wc", "wl", "ws")


def best_set(errors: DataFrame, by: list[str]) -> DataFrame:
    """The parameter set with the least error; of ties the lowest id."""
    return errors.groupBy(*by).agg(F.min_by("par_id", F.struct("error", "par_id")).alias("par_id"), F.min("error").alias("error"))


def bootstrap_curves(t: DataFrame, label: str, score: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """replicate, fpr, tpr: the ROC curve of each stratified resample (the draws of bootstrap_auc)."""
    c = _resampled(t, label, score, key, replicates, seed)
    return c.select(F.col("rep").alias("replicate"), ((F.col("nq") - F.col("below_q")) / F.col("nq")).alias("fpr"), ((F.col("np") - F.col("below_p")) / F.col("np")).alias("tpr"))


def mean_band(curves: DataFrame, grid: int = 1001) -> DataFrame:
    """g, mean, sd, upper: tpr at evenly spaced fpr over replicates, the upper edge at most 1."""
    at = curve_at(curves, grid, ["replicate"])
    b = at.groupBy("g").agg(F.avg("tpr").alias("mean"), F.stddev_pop("tpr").alias("sd"))
    return b.select("g", "mean", "sd", F.least(F.col("mean") + F.col("sd"), F.lit(1.0)).alias("upper"))
