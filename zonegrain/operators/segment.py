"""Components, clustering, tiled scoring and augmentation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.functions.columns import lcg
from zonegrain.operators import regions, stencil
from zonegrain.sources import shared

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
EIGHT = [(dy, dx, 0) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
VOXEL = ["sample", "y", "x", "z"]
#: Voxels along each edge of a brick whose components are found at once.
SIDE = 64


def _least_labels(at: list[np.ndarray], ids: np.ndarray, moves: list[tuple[int, int, int]]) -> np.ndarray:
    """The least id of its component for each voxel (y, x, z in at) of one brick."""
    low = [p.min() for p in at]
    shape = [int(p.max() - m) + 1 for p, m in zip(at, low, strict=True)]
    place = np.full(shape, -1)
    order = np.argsort(ids, kind="stable")
    place[tuple((p - m)[order] for p, m in zip(at, low, strict=True))] = np.arange(len(ids))
    up = np.arange(len(ids))
    a, b = [], []
    for move in moves:
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(move, shape, strict=True))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(move, shape, strict=True))
        if all(abs(d) < n for d, n in zip(move, shape, strict=True)):
            both = (place[here] >= 0) & (place[there] >= 0)
            a.append(place[here][both])
            b.append(place[there][both])
    a, b = (np.concatenate(c) if c else np.empty(0, int) for c in (a, b))
    while len(a):
        ra, rb = up[a], up[b]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (up[up] == up).all():
            up = up[up]
        apart = up[a] != up[b]
        a, b = a[apart], b[apart]
    out = np.empty_like(ids)
    out[order] = ids[order][up]
    return out


def components(points: DataFrame, moves: list[tuple[int, int, int]] = FACES, side: int = SIDE) -> DataFrame:
    """sample, y, x, z, label: the label is the least voxel number of the component (z, then y, then x).

    A brick labels its own voxels; voxels that touch across bricks give edges between labels, and unions of those labels (far
    fewer than voxels) make them one. moves go at most one voxel along each axis, and each has its opposite.
    """
    number = lambda y, x, z: z.cast("long") * (1 << 40) + y.cast("long") * (1 << 20) + x.cast("long")
    keys = ["sample", *(f"__b{a}" for a in "yxz")]
    at = points.select(*VOXEL).distinct().withColumn("id", number(F.col("y"), F.col("x"), F.col("z"))).withColumns({f"__b{a}": F.floor(F.col(a) / side) for a in "yxz"})
    kinds = ", ".join(f"{c} {t}" for c, t in points.select(*VOXEL).dtypes)

    def answer(t: pa.Table) -> pa.RecordBatch:
        rows = t.select([*VOXEL, "id"]).combine_chunks()
        label = _least_labels([t.column(a).to_numpy().astype(np.int64) for a in "yxz"], t.column("id").to_numpy(), moves)
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in rows.column_names), pa.array(label)], names=[*rows.column_names, "label"])

    found = shared.saved(stencil.by_key(at, keys, answer, f"{kinds}, id long, label long"), "brick-labels")
    rim = found.where(" or ".join(f"pmod({a}, {side}) in (0, {side - 1})" for a in "yxz"))
    half = [m for m in moves if m > (0, 0, 0)]
    near = F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(c).alias("dz")) for a, b, c in half))
    moved = {a: F.col(a) + F.col(f"m.d{a}") for a in "yxz"}
    across = reduce(lambda p, q: p | q, (F.floor(F.col(a) / side) != F.floor(moved[a] / side) for a in "yxz"))
    sent = rim.withColumn("m", F.explode(near)).where(across).select("sample", number(*(moved[a] for a in "yxz")).alias("id"), F.col("label").alias("a"))
    edges = sent.join(rim.select("sample", "id", F.col("label").alias("b")), ["sample", "id"]).select(F.col("sample").alias("image"), "a", "b")
    roots = regions.unions(edges).select(F.col("image").alias("sample"), F.col("node").alias("label"), "root")
    return found.join(roots, ["sample", "label"], "left").select(*VOXEL, F.coalesce("root", "label").alias("label"))


def largest_component(points: DataFrame, moves: list[tuple[int, int, int]] = FACES, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """The voxels of the largest component of each sample (or of each slice, with z in `by`); of ties that with the least label."""
    c = components(points, moves)
    sizes = c.groupBy(*by, "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return c.join(top, [*by, "label"], "left_semi").select(*VOXEL)


def bounding_boxes(points: DataFrame, least_area: int = 1600) -> DataFrame:
    """The largest box by width * height of each layer's components; zeros when none is above the area."""
    c = components(points, EIGHT)
    boxes = c.groupBy("sample", "z", "label").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.count("*").alias("area"))
    size = (F.col("x2") - F.col("x1") + 1) * (F.col("y2") - F.col("y1") + 1)
    top = boxes.groupBy("sample", "z").agg(F.max_by(F.struct("x1", "x2", "y1", "y2", "area"), F.struct(size, -F.col("label"))).alias("b"))
    return top.select("sample", "z", *(F.when(F.col("b.area") > least_area, F.col(f"b.{c}")).otherwise(0).alias(c) for c in ("x1", "x2", "y1", "y2")))


def kmeans(images: DataFrame, k: int = 3, steps: int = 25) -> DataFrame:
    """image, y, x, cluster (0 the darkest): Lloyd's steps on the histogram of each image, at most 256 rows a group after the count."""
    counts = images.groupBy("image", "val").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = pdf["val"].to_numpy(float), pdf["n"].to_numpy(float)
        order = np.argsort(v)
        v, n = v[order], n[order]
        c = np.interp((np.arange(k) + 0.5) / k, np.cumsum(n) / n.sum(), v)
        for _ in range(steps):
            near = np.abs(v[:, None] - c).argmin(1)
            w = np.bincount(near, n, k)
            new = np.where(w > 0, np.bincount(near, n * v, k) / np.maximum(w, 1), c)
            if np.allclose(new, c):
                break
            c = new
        rank = np.argsort(np.argsort(c, kind="stable"), kind="stable")
        return pd.DataFrame({"image": pdf["image"].iloc[0], "val": v.astype(int), "cluster": rank[np.abs(v[:, None] - c).argmin(1)].astype(int)})

    found = counts.groupBy("image").applyInPandas(fit, f"image {dict(images.dtypes)['image']}, val int, cluster int")
    return images.join(found, ["image", "val"]).select("image", "y", "x", "cluster")


#: Numbers that a model gets at a time.
SCORED = 262_144


def score_tiles(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], size: int, key: list[str] | None = None) -> DataFrame:
    """image, y, x, p: half-overlapping tiles scored by a user's model, averaged where they overlap.

    model: (tiles, size, size) float array in, probabilities of the same shape out; it runs on the executors, some tiles
    (SCORED numbers, or one tile) at a time, each tile once. A pixel is sent to the blocks that own one of its tiles (a block has
    TILE pixels along each edge, or one tile, and is read as rows), which answer with the sum of its scores and their count.
    """
    step = max(1, size // 2)
    edge = max(1, stencil.TILE // step)
    lot = max(1, SCORED // (size * size))
    block = lambda tile: F.floor(tile / edge).cast("int")
    near = lambda a: F.explode(F.sequence(block(F.greatest(F.floor((F.col(a) - size + step) / step), F.lit(0))), block(F.floor(F.col(a) / step))))
    keys = ["image", "by", "bx"]
    sent = images.withColumn("by", near("y")).withColumn("bx", near("x")).select(*keys, F.col("y").cast("int"), F.col("x").cast("int"), F.col("val").cast("float").alias("v"))

    def scored(t: pa.Table) -> pa.RecordBatch:
        first = np.zeros(t.num_rows, np.int64)
        first[stencil.changes(t, keys)] = 1
        number = np.cumsum(first)
        y, x, by, bx = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "by", "bx"))
        rows, tiles, places = [], [], []
        for dy, dx in np.ndindex(-(-size // step), -(-size // step)):
            ty, tx = y // step - dy, x // step - dx
            py, px = y - ty * step, x - tx * step
            own = np.flatnonzero((ty >= 0) & (tx >= 0) & (py < size) & (px < size) & (ty // edge == by) & (tx // edge == bx))
            rows.append(own)
            tiles.append(((number * edge + ty % edge) * edge + tx % edge)[own])
            places.append((py * size + px)[own])
        rows, tiles, places = (np.concatenate(c) for c in (rows, tiles, places))
        order = np.argsort(tiles, kind="stable")
        rows, tiles, places = rows[order], tiles[order], places[order]
        starts = np.append(np.flatnonzero(np.diff(tiles, prepend=-1)), len(tiles))
        v, p = t.column("v").to_numpy(), np.empty(len(tiles))
        for start in range(0, len(starts) - 1, lot):
            ends = starts[start : start + lot + 1]
            here = slice(ends[0], ends[-1])
            at = np.repeat(np.arange(len(ends) - 1), np.diff(ends)), places[here]
            given = np.zeros((len(ends) - 1, size * size), np.float32)
            given[at] = v[rows[here]]
            p[here] = np.asarray(model(given.reshape(-1, size, size)), float).reshape(len(given), -1)[at]
        sums, n = np.bincount(rows, p, t.num_rows), np.bincount(rows, minlength=t.num_rows)
        return t.select(["image", "y", "x"]).append_column("p", pa.array(sums)).append_column("n", pa.array(n, pa.int32())).combine_chunks().to_batches()[0]

    flat = stencil.by_lots(sent, keys, scored, f"image {dict(images.dtypes)['image']}, y int, x int, p double, n int")
    return flat.groupBy(*stencil.PIXEL).agg(F.try_divide(F.sum("p"), F.sum("n")).alias("p"))


def augment(images: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """Flip (p 0.5) and gamma in 0.5 to 2 (p 0.5), drawn by image, so that a mask gets the same; any partitioning gives the same draw."""
    a, b, c = (lcg(F.col("image") * 7919 + seed + i) for i in range(3))
    gamma = F.when(F.pmod(b, F.lit(2)) == 0, 0.5 + F.pmod(c, F.lit(1000)) * 0.0015).otherwise(1.0)
    return images.select("image", "y", F.when(F.pmod(a, F.lit(2)) == 0, width - 1 - F.col("x")).otherwise(F.col("x")).alias("x"), F.floor(255 * F.pow(F.col("val") / 255, gamma) + 1e-9).cast("int").alias("val"))


def sampled_pixels(images: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n pixels of each image, drawn by a hash of their place."""
    from pyspark.sql import Window

    w = Window.partitionBy("image").orderBy(lcg(F.col("y") * 65537 + F.col("x") * 257 + seed), "y", "x")
    return images.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def graph_edges(images: DataFrame) -> DataFrame:
    """src, dst, weight of neighbouring pixels: exp(-difference / deviation of the image)."""
    sd = images.groupBy("image").agg(F.stddev_pop("val").alias("sd"))
    moved = images.withColumn("m", F.explode(stencil.offsets([(0, 1, 1.0), (1, 0, 1.0)]))).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("val").alias("v0"))
    number = lambda y, x: F.col("image").cast("long") * (1 << 40) + F.col(y).cast("long") * (1 << 20) + F.col(x).cast("long")
    return images.join(moved, stencil.PIXEL).join(sd, "image").select(number("y0", "x0").alias("src"), number("y", "x").alias("dst"), F.exp(-F.abs(F.col("val") - F.col("v0")) / F.greatest("sd", F.lit(1e-9))).alias("weight"))
