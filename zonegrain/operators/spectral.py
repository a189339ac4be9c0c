"""Spectral clustering of pixel graphs of any size.

Neighbouring pixels are joined by exp(-difference / deviation of the image). The leading eigenvectors of the normalised weights
come from subspace iteration with a Chebyshev filter: products of the sparse matrix with a few vectors are stencils, so one pass
over tiles with a halo of `degree` makes `degree` of them exactly; between passes only sums of products of vectors (a few numbers
an image) are brought together, and give the new basis, orthogonal to all others (Rayleigh-Ritz). Pixels of an image then form
clusters on their eigenvector values. Images within one tile take the same steps in one task each, so that many small images are
one shuffle and no image waits for the slowest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import stencil
from zonegrain.sources import shared

PIXEL = stencil.PIXEL
#: Change of an eigenvalue at which the iteration ends, vectors beyond those asked for, and passes after which it's an error.
STILL, SPARE, PASSES = 1e-9, 3, 200
#: Pixels up to which a whole image's matrix is solved as it is.
DENSE = 512


def _weights(val: np.ndarray, on: np.ndarray, sd: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """For each of the four moves: weights to the neighbour there, over the roots of both degrees."""
    raw = []
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        both = on & stencil._shifted(on, dy, dx)
        raw.append((dy, dx, np.where(both, np.exp(-np.abs(stencil._shifted(val, dy, dx) - val) / np.maximum(sd, 1e-9)), 0.0)))
    root = np.sqrt(np.maximum(sum(w for _, _, w in raw), 1e-300))
    return [(dy, dx, np.where(w > 0, w / (root * np.where(stencil._shifted(root, dy, dx) > 0, stencil._shifted(root, dy, dx), 1)), 0)) for dy, dx, w in raw]


def _times(weights: list, v: np.ndarray) -> np.ndarray:
    return sum(w * stencil._shifted(v, dy, dx) for dy, dx, w in weights)


def _basis(gram: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that turn vectors into eigenvectors, from products of the vectors with one another and with what the matrix makes of them; and values, -1 where there is none."""
    m = len(gram)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    value, vector = np.linalg.eigh(gram * np.outer(scale, scale))
    keep = value > 1e-13 * value.max()
    basis = scale[:, None] * vector[:, keep] / np.sqrt(value[keep])
    inner = basis.T @ h @ basis
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    full = np.zeros((m, m))
    full[:, : keep.sum()] = (basis @ vector)[:, ::-1]
    return full, np.append(value[::-1], np.full(m - len(value), -1.0))


def eigenvectors(images: DataFrame, k: int, degree: int = 24, tile: int = stencil.TILE) -> tuple[DataFrame, DataFrame]:
    """(image, y, x, v0 to v(k-1)) and (image, i, value): the k leading eigenvectors of each image's normalised weights, and eigenvalues.

    images: image, y, x, val; pixels of value 0 are background and left out. A vector's sign is free.
    """
    m = k + SPARE
    names = [f"v{i}" for i in range(m)]
    sd = images.where("val <> 0").groupBy("image").agg(F.stddev_pop("val").alias("sd"))
    draw = lambda i: F.pmod(F.xxhash64("y", "x", F.lit(i)), F.lit(1 << 20)) / (1 << 19) - 1
    at = shared.saved(images.where("val <> 0").join(sd, "image").select(*PIXEL, F.col("val").cast("double").alias("val"), F.coalesce("sd", F.lit(0.0)).alias("sd"), F.lit(-0.5).alias("cut"), *(draw(i).alias(n) for i, n in enumerate(names))), "vectors")

    def work(g: stencil.Grid, there: np.ndarray) -> stencil.Grid:
        a = _weights(g["val"], there, g["sd"])
        mid, half = (g["cut"] - 1) / 2, (g["cut"] + 1) / 2  # the filter is small on [-1, cut]
        half = np.where(there, np.maximum(half, 1e-3), 1.0)
        out = {}
        for i, n in enumerate(names):
            old, new = g[n], (_times(a, g[n]) - mid * g[n]) / half
            for _ in range(degree - 1):
                old, new = new, 2 * (_times(a, new) - mid * new) / half - old
            out[f"f{i}"], out[f"a{i}"] = new, _times(a, new)
        return out | {"val": g["val"], "sd": g["sd"]}

    fields = ", ".join(f"f{i} double, a{i} double" for i in range(m))

    def ritz(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
        full, values = _basis(gram, h)
        return pd.DataFrame({"image": [r["image"]], "c": [full.T.tolist()], "value": [values.tolist()]})

    kind = dict(images.dtypes)["image"]
    last = None
    for _ in range(PASSES):
        found = shared.saved(stencil.tiled(at, degree + 2, work, f"{fields}, val double, sd double", tile), "filtered")
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        half = lambda i, j: (F.col(f"f{i}") * F.col(f"a{j}") + F.col(f"f{j}") * F.col(f"a{i}")) / 2
        sums = found.groupBy("image").agg(*(F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"g{i}_{j}") for i, j in pairs), *(F.sum(half(i, j)).alias(f"h{i}_{j}") for i, j in pairs))
        new = shared.saved(sums.groupBy("image").applyInPandas(ritz, f"image {kind}, c array<array<double>>, value array<double>"), "values")
        f = F.array(*(F.col(f"f{i}") for i in range(m)))
        turned = [F.aggregate(F.zip_with(f, F.col("c")[i], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b).alias(n) for i, n in enumerate(names)]
        cut = F.least(F.col("value")[m - 1], F.lit(0.999))
        at = shared.saved(found.join(new, "image").select(*PIXEL, "val", "sd", F.greatest(cut, F.lit(-0.9)).alias("cut"), *turned), "vectors")
        if last is not None:
            gap = F.array_max(F.transform(F.arrays_zip(F.slice("value", 1, k).alias("a"), F.slice("old", 1, k).alias("b")), lambda e: F.abs(e["a"] - e["b"])))
            most = new.join(last.select("image", F.col("value").alias("old")), "image").agg(F.max(gap)).first()[0]
            if most is None or most < STILL:
                break
        last = new
    else:
        raise ValueError(f"eigenvalues still move after {PASSES} passes")
    return at.select(*PIXEL, *names[:k]), new.select("image", F.posexplode(F.slice("value", 1, k)).alias("i", "value"))


def clusters(points: DataFrame, d: int, k: int) -> DataFrame:
    """image, y, x, cluster of points (image, y, x, p: an array of d numbers): Lloyd's steps until no point moves.

    The first centre is the point with the least sum of its numbers, each further one the point farthest from those before. A pass
    sums each cluster; centres are one row an image. Clusters are numbered in order of their centres.
    """
    points = shared.saved(points, "points")
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    total = F.aggregate("p", F.lit(0.0), lambda s, v: s + v)
    centres = points.groupBy("image").agg(F.array(F.min_by("p", F.struct(total, "y", "x"))).alias("c"))
    for _ in range(k - 1):
        near = F.array_min(F.transform("c", lambda c: apart(F.col("p"), c)))
        far = points.join(centres, "image").withColumn("near", near).groupBy("image").agg(F.max_by("p", F.struct("near", F.col("y"), F.col("x"))).alias("new"), F.any_value("c").alias("c"))
        centres = shared.saved(far.select("image", F.concat("c", F.array("new")).alias("c")), "centres")
    nearest = F.array_position(F.transform("c", lambda c: apart(F.col("p"), c)), F.array_min(F.transform("c", lambda c: apart(F.col("p"), c)))) - 1
    while True:
        told = points.join(centres, "image").withColumn("cluster", nearest.cast("int"))
        means = told.groupBy("image", "cluster").agg(F.array(*(F.avg(F.col("p")[i]) for i in range(d))).alias("m"))
        listed = means.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("cluster", "m"))).alias("means"))
        moved = centres.join(listed, "image").select("image", "c", F.transform("c", lambda c, i: F.coalesce(F.element_at("means", i.cast("int")), c)).alias("new"))
        moved = shared.saved(moved, "centres")
        step = moved.agg(F.max(F.array_max(F.transform(F.arrays_zip("c", "new"), lambda e: apart(e["c"], e["new"]))))).first()[0]
        centres = moved.select("image", F.array_sort("new").alias("c"))
        if step is None or step < 1e-20:
            return points.join(centres, "image").select(*PIXEL, nearest.cast("int").alias("cluster"))


def _whole_vectors(val: np.ndarray, there: np.ndarray, sd: float, k: int, degree: int) -> np.ndarray:
    """(pixels, k): the leading eigenvectors of one image, pixels in the order of the grid."""
    weights = _weights(val, there, np.full(val.shape, sd))
    n = int(there.sum())
    if n <= DENSE:
        place = np.cumsum(there).reshape(there.shape) - 1
        a = np.zeros((n, n))
        for dy, dx, w in weights:
            on = w > 0
            a[place[on], stencil._shifted(place, dy, dx)[on]] = w[on]
        vectors = np.linalg.eigh((a + a.T) / 2)[1][:, ::-1][:, :k]
        return np.pad(vectors, ((0, 0), (0, k - vectors.shape[1])))
    m = k + SPARE
    v, cut, last = [np.where(there, x, 0.0) for x in np.random.default_rng(1).uniform(-1, 1, (m, *there.shape))], -0.5, None
    for _ in range(PASSES):
        mid, half = (cut - 1) / 2, max((cut + 1) / 2, 1e-3)
        for i in range(m):
            old, new = v[i], (_times(weights, v[i]) - mid * v[i]) / half
            for _ in range(degree - 1):
                old, new = new, 2 * (_times(weights, new) - mid * new) / half - old
            v[i] = new
        f = np.stack([x[there] for x in v])
        h = f @ np.stack([_times(weights, x)[there] for x in v]).T
        c, value = _basis(f @ f.T, (h + h.T) / 2)
        f = c.T @ f
        for i in range(m):
            v[i] = np.zeros(there.shape)
            v[i][there] = f[i]
        if last is not None and np.abs(value[:k] - last).max() < STILL:
            return f[:k].T
        cut, last = max(min(value[m - 1], 0.999), -0.9), value[:k]
    raise ValueError(f"eigenvalues still move after {PASSES} passes")


def _whole_clusters(p: np.ndarray, k: int) -> np.ndarray:
    """What clusters() answers, for the points (n, d) of one image in the order of y, x."""
    apart = lambda c: ((p[:, None] - c[None]) ** 2).sum(2)
    c = p[[p.sum(1).argmin()]]
    for _ in range(k - 1):
        near = apart(c).min(1)
        c = np.concatenate([c, p[[len(p) - 1 - near[::-1].argmax()]]])
    while True:
        told = apart(c).argmin(1)
        new = np.stack([p[told == i].mean(0) if (told == i).any() else c[i] for i in range(k)])
        step = ((new - c) ** 2).sum(1).max()
        c = new[np.lexsort(new.T[::-1])]
        if step < 1e-20:
            return apart(c).argmin(1)


def _whole_images(images: DataFrame, k: int, degree: int) -> DataFrame:
    """image, y, x, cluster of images (image, y, x, val; no background) that a task can hold one of."""
    kinds = ", ".join(f"{c} {t}" for c, t in images.select(*stencil.PIXEL).dtypes)

    def answer(t: pa.Table) -> pa.RecordBatch:
        y, x = (t.column(c).to_numpy().astype(np.int64) for c in "yx")
        order = np.lexsort((x, y))
        at = y[order] - y.min(), x[order] - x.min()
        there = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
        there[at] = True
        val = np.zeros(there.shape)
        val[at] = t.column("val").to_numpy()[order]
        sd = float(val[there].std())
        v = _whole_vectors(val, there, sd, k, degree)
        v = v * np.where((v**3).sum(0) < 0, -1.0, 1.0)
        root = np.sqrt(np.maximum(_degrees(val, there, np.full(val.shape, sd))[there], 1e-12))
        found = np.empty(len(y), np.int32)
        found[order] = _whole_clusters(np.round(v / root[:, None], 9) + 0.0, k)
        rows = t.select(PIXEL).combine_chunks()
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in PIXEL), pa.array(found)], names=[*PIXEL, "cluster"])

    return stencil.by_key(images.select(*PIXEL, F.col("val").cast("double").alias("val")), ["image"], answer, f"{kinds}, cluster int")


def _degrees(val: np.ndarray, there: np.ndarray, sd: np.ndarray) -> np.ndarray:
    total = np.zeros(there.shape)
    for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
        both = there & stencil._shifted(there, dy, dx)
        total += np.where(both, np.exp(-np.abs(stencil._shifted(val, dy, dx) - val) / np.maximum(sd, 1e-9)), 0.0)
    return total


def spectral_clusters(images: DataFrame, k: int = 3, degree: int = 24, tile: int = stencil.TILE) -> DataFrame:
    """image, y, x, cluster of pixels (image, y, x, val) other than background (0): k clusters on the k leading eigenvectors, each over the root of the pixel's degree."""
    on = images.where("val <> 0")
    wide = shared.saved(stencil.bounds(on).where(f"y_max - y_min >= {tile} or x_max - x_min >= {tile}").select("image"), "wide")
    if wide.isEmpty():
        return _whole_images(on, k, degree)
    return _whole_images(on.join(wide, "image", "left_anti"), k, degree).unionByName(_tiled_clusters(on.join(wide, "image", "left_semi"), k, degree, tile))


def _tiled_clusters(images: DataFrame, k: int, degree: int, tile: int) -> DataFrame:
    vectors, _ = eigenvectors(images, k, degree, tile)
    sd = images.where("val <> 0").groupBy("image").agg(F.coalesce(F.stddev_pop("val"), F.lit(0.0)).alias("sd"))

    def degrees(g: stencil.Grid, there: np.ndarray) -> stencil.Grid:
        return {"degree": _degrees(g["val"], there, g["sd"])}

    source = images.where("val <> 0").join(sd, "image").select(*PIXEL, F.col("val").cast("double").alias("val"), "sd")
    found = stencil.tiled(source, 1, degrees, "degree double", tile).join(vectors, PIXEL)
    root = F.sqrt(F.greatest("degree", F.lit(1e-12)))
    # A vector's sign is free: the one with the larger cube sum is taken.
    sign = found.groupBy("image").agg(*(F.when(F.sum(F.col(f"v{i}") ** 3) < 0, -1.0).otherwise(1.0).alias(f"s{i}") for i in range(k)))
    points = found.join(sign, "image").select(*PIXEL, F.array(*(F.round(F.col(f"v{i}") * F.col(f"s{i}") / root, 9) for i in range(k))).alias("p"))
    return clusters(points, k, k)
