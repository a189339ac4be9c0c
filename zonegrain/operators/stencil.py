"""Stencils and textures over images as long tables: image, y, x, val.

Wide stencils (medians, Gaussians, patterns, similarity) go by tiles: a pixel is sent to its tile and to the tiles whose halo
it lies in, one shuffle of little more than the image, and numpy works on one tile at a time. A tile has a bounded size, so
one image of any size is dealt over all tasks. Small stencils are constant tables of offsets, exploded beside each pixel; the
target pixel sums what it is sent, with partial sums before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrain.functions.columns import uniform_code
from zonegrain.sources import shared

PIXEL = ["image", "y", "x"]
Offsets = list[tuple[int, int, float]]


def gauss(size: int, sigma: float) -> list[float]:
    """A Gaussian of `size` points that sums to 1."""
    h = size // 2
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-h, size - h)]
    return [x / sum(w) for x in w]


def box_1d(weights: list[float], axis: str) -> Offsets:
    h = len(weights) // 2
    return [(i - h, 0, w) if axis == "y" else (0, i - h, w) for i, w in enumerate(weights)]


def square(size: int) -> Offsets:
    h = size // 2
    return [(dy, dx, 1.0) for dy in range(-h, h + 1) for dx in range(-h, h + 1)]


def circle(k: int, n: int, radius: float) -> Offsets:
    """Where the k-th of n neighbours on a circle lies: one pixel, or four with bilinear weights."""
    angle = -2 * math.pi * k / n
    x, y = radius * math.cos(angle), radius * math.sin(angle)
    if abs(x - round(x)) < 1e-6 and abs(y - round(y)) < 1e-6:
        return [(round(y), round(x), 1.0)]
    y0, x0 = math.floor(y), math.floor(x)
    return [(y0 + i, x0 + j, (y - y0 if i else 1 - y + y0) * (x - x0 if j else 1 - x + x0)) for i in (0, 1) for j in (0, 1)]


def offsets(table: Offsets) -> Column:
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(float(w)).alias("w")) for dy, dx, w in table))


def bounds(images: DataFrame) -> DataFrame:
    return images.groupBy("image").agg(*(f(a).alias(f"{a}_{n}") for a in "yx" for n, f in (("min", F.min), ("max", F.max))))


def reflected(images: DataFrame, pad: int) -> DataFrame:
    """The image with `pad` more pixels on each side, the edge repeated first. Only border rows are copied."""
    t = images.join(bounds(images), "image")
    for a in "yx":
        lo, hi, at = F.col(f"{a}_min"), F.col(f"{a}_max"), F.col(a)
        copies = F.filter(F.array(at, 2 * lo - 1 - at, 2 * hi + 1 - at), lambda p: (p >= lo - pad) & (p <= hi + pad))  # noqa: B023
        t = t.withColumn(a, F.explode(F.array_distinct(copies)))
    return t.select(*PIXEL, "val")


def _sent(images: DataFrame, table: Offsets) -> DataFrame:
    """Each pixel at each target that it counts for."""
    return images.withColumn("o", F.explode(offsets(table))).select("image", (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "val", F.col("o.w").alias("w"))


def inside(t: DataFrame, images: DataFrame, margin: int = 0) -> DataFrame:
    b = bounds(images)
    return t.join(b, "image").where((F.col("y") >= F.col("y_min") + margin) & (F.col("y") <= F.col("y_max") - margin) & (F.col("x") >= F.col("x_min") + margin) & (F.col("x") <= F.col("x_max") - margin)).drop("y_min", "y_max", "x_min", "x_max")


def correlate(images: DataFrame, table: Offsets, edge: str = "zero") -> DataFrame:
    """Weighted sums of neighbours; beyond the edge are zeros, or the image reflected."""
    pad = max(max(abs(dy), abs(dx)) for dy, dx, _ in table)
    source = reflected(images, pad) if edge == "reflect" else images
    return inside(_sent(source, table).groupBy(*PIXEL).agg(F.sum(F.col("w") * F.col("val")).alias("val")), images)


#: Rows and columns of a tile without its halo, and numbers that a median handles at a time.
TILE, LOT = 256, 4_000_000
#: Answers of keys, empty ones too, that a task holds before it hands them on.
ANSWERS = 500
Grid = dict[str, np.ndarray]


def by_key(sent: DataFrame, keys: list[str], answer: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What answer gives (schema) for the rows of each key: one shuffle, then one key after the other in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, done, size = None, [], 0
        for batch in batches:
            n = batch.num_rows
            new = np.zeros(n + 1, bool)
            new[[0, n]] = True
            for c in keys if n > 1 else ():
                v = batch.column(c)
                new[1:n] |= pc.not_equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(new).tolist() if n else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(batch.column(c)[a].as_py() for c in keys)
                if held and key != last:
                    done.append(answer(pa.Table.from_batches(held)))
                    size, held = size + done[-1].num_rows, []
                    if size > 50_000 or len(done) >= ANSWERS:
                        yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                        done, size = [], 0
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            done.append(answer(pa.Table.from_batches(held)))
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where rows begin whose key isn't that of the row before (a null is that of a null); the first row isn't told."""
    new = np.zeros(max(t.num_rows - 1, 0), bool)
    for c in keys if t.num_rows > 1 else ():
        v = t.column(c).combine_chunks()
        new |= pc.fill_null(pc.not_equal(v.slice(1), v.slice(0, t.num_rows - 1)), False).to_numpy(zero_copy_only=False)
        new |= np.diff(v.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new) + 1


def by_lots(sent: DataFrame, keys: list[str], answer: Callable[[pa.Table], pa.RecordBatch], schema: str, rows: int = 20_000) -> DataFrame:
    """by_key, where answer gets whole keys of about so many rows at once, or one larger key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, rows
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                t = pa.Table.from_batches(held).combine_chunks()
                last = changes(t, keys)[-1:].tolist()
                if last:
                    yield answer(t.slice(0, last[0]))
                    t = t.slice(last[0])
                held, size = t.to_batches(), t.num_rows
                limit = max(rows, 2 * size)
        if size:
            yield answer(pa.Table.from_batches(held).combine_chunks())

    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def by_tile(images: DataFrame, halo: int, answer: Callable[[pa.Table], pa.RecordBatch], schema: str, tile: int = TILE, beside: DataFrame | None = None, lots: bool = False) -> DataFrame:
    """What answer gives (schema) for the rows of each tile of images (image, y, x and values), with those of `halo` pixels around it.

    beside: rows (image, ty, tx, and columns that images lacks) that come to their tile as they are. Tiles are sorted in their
    partition and read one after the other, so many small images share a task and no image needs one task. A pixel isn't sent
    to tiles beyond its image's extent, which own none. lots: answer gets many tiles at once (by_lots).
    """
    if halo and beside is None:
        ends = {f"{c}_{e}": f"__{c}_{e}" for c in "yx" for e in ("min", "max")}
        images = images.join(bounds(images).withColumnsRenamed(ends), "image", "left")
        lo, hi = (lambda c: F.col(f"__{c}_min")), (lambda c: F.col(f"__{c}_max"))
    else:
        lo = hi = lambda c: F.lit(None).cast("double")
    near = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - halo, lo(c)) / tile), F.floor(F.least(F.col(c) + halo, hi(c)) / tile)))
    sent = images.withColumn("ty", near("y")).withColumn("tx", near("x")).drop("__y_min", "__y_max", "__x_min", "__x_max")
    if beside is not None:
        sent = sent.unionByName(beside, allowMissingColumns=True)
    return (by_lots if lots else by_key)(sent, ["image", "ty", "tx"], answer, schema)


def stacks_of(t: pa.Table, names: list[str]) -> Iterator[tuple[np.ndarray, Grid, np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """The tiles of a table in order of (image, ty, tx), those of one height and width beside each other, some LOT places at a time.

    Given are the rows, each value as a stack of grids over them (0 where there is no pixel), where pixels are, the rows' places
    in the stack, and the first y and x of each grid.
    """
    starts = np.concatenate([[0], changes(t, ["image", "ty", "tx"])]).astype(np.int64)
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    y, x = (t.column(c).to_numpy().astype(np.int64) for c in "yx")
    low = [np.minimum.reduceat(v, starts) for v in (y, x)]
    size = np.stack([np.maximum.reduceat(v, starts) - m + 1 for v, m in zip((y, x), low, strict=True)], 1)
    for h, w in np.unique(size, axis=0).tolist():
        which = np.flatnonzero((size == (h, w)).all(1))
        many = max(1, LOT // (h * w))
        for k in range(0, len(which), many):
            some = which[k : k + many]
            number = np.full(len(starts), -1)
            number[some] = np.arange(len(some))
            rows = np.flatnonzero(number[of] >= 0)
            at = number[of[rows]], y[rows] - low[0][of[rows]], x[rows] - low[1][of[rows]]
            there = np.zeros((len(some), h, w), bool)
            there[at] = True
            grids = {}
            for n in names:
                v = t.column(n).to_numpy()[rows]
                grids[n] = np.zeros(there.shape, v.dtype)
                grids[n][at] = v
            yield rows, grids, there, at, low[0][some], low[1][some]


def grids_of(t: pa.Table, names: list[str], tile: int = TILE) -> tuple[Grid, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Each value as a grid over the pixels of a tile's rows (0 where there is none), where pixels are, the rows that are the tile's own, and their places."""
    y, x = (t.column(c).to_numpy().astype(np.int64) for c in "yx")
    at = y - y.min(), x - x.min()
    there = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
    there[at] = True
    grids = {}
    for n in names:
        v = t.column(n).to_numpy()
        grids[n] = np.zeros(there.shape, v.dtype)
        grids[n][at] = v
    own = (y // tile == t.column("ty")[0].as_py()) & (x // tile == t.column("tx")[0].as_py())
    return grids, there, own, (at[0][own], at[1][own])


def tiled(images: DataFrame, halo: int, work: Callable[[Grid, np.ndarray], Grid], out: str, tile: int = TILE, stacked: bool = False) -> DataFrame:
    """image, y, x and what work answers (out, a schema) for each pixel of images (image, y, x and values).

    work gets each value as a grid over the pixels of a tile with `halo` more on each side (0 where there is no pixel), and
    where pixels are; it answers with grids of that shape. stacked: work gets grids of one shape in a stack, its first axis.
    """
    names = [c for c in images.columns if c not in PIXEL]
    fields = [f.strip().split(" ")[0] for f in out.split(",")]
    types = {f.name: f.dataType for f in images.sparkSession.createDataFrame([], out).schema}
    kinds = ", ".join(f"{c} {t}" for c, t in images.select(*PIXEL).dtypes)

    def answer(t: pa.Table) -> pa.RecordBatch:
        grids, there, own, at = grids_of(t, names, tile)
        found = work(grids, there)
        rows = t.select(PIXEL).filter(pa.array(own)).combine_chunks()
        kept = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], t.schema.field(c).type) for c in PIXEL]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(found[f][at], _ARROW[types[f].typeName()]) for f in fields)], names=[*PIXEL, *fields])

    def answer_stacks(t: pa.Table) -> pa.RecordBatch:
        ty, tx, y, x = (t.column(c).to_numpy() for c in ("ty", "tx", "y", "x"))
        found = {f: np.zeros(t.num_rows) for f in fields}
        for rows, grids, there, at, _, _ in stacks_of(t, names):
            for f, v in work(grids, there).items():
                found[f] = found[f].astype(v.dtype, copy=False)
                found[f][rows] = v[at]
        own = (y // tile == ty) & (x // tile == tx)
        rows = t.select(PIXEL).filter(pa.array(own)).combine_chunks()
        kept = [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], t.schema.field(c).type) for c in PIXEL]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(found[f][own], _ARROW[types[f].typeName()]) for f in fields)], names=[*PIXEL, *fields])

    return by_tile(images, halo, answer_stacks if stacked else answer, f"{kinds}, {out}", tile, lots=stacked)


_ARROW = {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[y + dy, x + dx], 0 beyond the grid."""
    out = np.zeros_like(a)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def _along(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """a correlated with the weights along y, then along x."""
    h = len(weights) // 2
    for axis in (0, 1):
        a = sum(w * _shifted(a, *((i - h, 0) if axis == 0 else (0, i - h))) for i, w in enumerate(weights))
    return a


def _medians(a: np.ndarray, size: int) -> np.ndarray:
    h, n = size // 2, size * size
    wide = np.pad(a, ((h, size - 1 - h),) * 2)
    out, step = np.empty_like(a), max(1, LOT // (a.shape[1] * n))
    for y in range(0, len(a), step):
        near = np.lib.stride_tricks.sliding_window_view(wide[y : y + step + size - 1], (size, size))
        out[y : y + step] = np.partition(near.reshape(*near.shape[:2], n), n // 2, -1)[..., n // 2]
    return out


def _reflected(images: DataFrame, pad: int) -> DataFrame:
    """reflected() with `own`: 1 for the pixels of the image itself."""
    t = images.select(*PIXEL, "val").join(bounds(images), "image").withColumn("own", F.lit(1))
    for a in "yx":
        lo, hi, at = F.col(f"{a}_min"), F.col(f"{a}_max"), F.col(a)
        copies = F.filter(F.array_distinct(F.array(at, 2 * lo - 1 - at, 2 * hi + 1 - at)), lambda p: (p >= lo - pad) & (p <= hi + pad))  # noqa: B023
        t = t.withColumn("copy", F.explode(copies)).withColumn("own", F.col("own") * ((F.col("copy") >= lo) & (F.col("copy") <= hi)).cast("int")).withColumn(a, F.col("copy")).drop("copy")
    return t.select(*PIXEL, F.col("val").cast("double").alias("val"), "own")


def blur(images: DataFrame, size: int, sigma: float, edge: str = "reflect") -> DataFrame:
    """Gaussian means; beyond the edge are zeros, or the image reflected."""
    w, h = gauss(size, sigma), size // 2
    source = _reflected(images, h) if edge == "reflect" else images.select(*PIXEL, F.col("val").cast("double").alias("val"), F.lit(1).alias("own"))
    return tiled(source, h, lambda g, there: {"val": _along(g["val"], w), "own": g["own"]}, "val double, own int").where("own = 1").drop("own")


def standardise(images: DataFrame, size1: int, sigma1: float, size2: int, sigma2: float, raw: bool = False) -> DataFrame:
    """Local contrast: val minus its blur, over the root of the blurred square (of the centred image; raw: of the image) + 1e-9. Edges are reflected."""
    w1, w2, halo = gauss(size1, sigma1), gauss(size2, sigma2), size1 // 2 + size2 // 2

    def work(g: Grid, there: np.ndarray) -> Grid:
        centred = g["val"] - _along(g["val"], w1)
        squares = _along((g["val"] if raw else centred) ** 2, w2)
        return {"val": centred / (np.sqrt(np.maximum(squares, 0)) + 1e-9), "own": g["own"]}

    return tiled(_reflected(images, halo), halo, work, "val double, own int").where("own = 1").drop("own")


def median_filter(images: DataFrame, size: int) -> DataFrame:
    """Median of size * size pixels, with zeros beyond the edge."""
    kind = dict(images.dtypes)["val"].replace("bigint", "long")
    return tiled(images.select(*PIXEL, "val"), size // 2, lambda g, there: {"val": _medians(g["val"], size)}, f"val {kind}")


def dilate(images: DataFrame, size: int) -> DataFrame:
    """Largest value of a size * size box, as two passes."""
    return _extreme(images, size, F.max)


def erode(images: DataFrame, size: int) -> DataFrame:
    """Smallest value of a size * size box; the box is cut at the edge."""
    return _extreme(images, size, F.min)


def _extreme(images: DataFrame, size: int, f) -> DataFrame:
    t = images
    for axis in "yx":
        t = inside(_sent(t, box_1d([1.0] * size, axis)).groupBy(*PIXEL).agg(f("val").alias("val")), images)
    return t


def close(images: DataFrame, size: int) -> DataFrame:
    return erode(dilate(images, size), size)


SOBEL_X: Offsets = [(-1, -1, -1), (-1, 1, 1), (0, -1, -2), (0, 1, 2), (1, -1, -1), (1, 1, 1)]
SOBEL_Y: Offsets = [(dx, dy, w) for dy, dx, w in SOBEL_X]


def sobel(images: DataFrame) -> DataFrame:
    """Gradient magnitude by 3 * 3 kernels, edges reflected."""
    gx = correlate(images, SOBEL_X, "reflect").withColumnRenamed("val", "gx")
    gy = correlate(images, SOBEL_Y, "reflect").withColumnRenamed("val", "gy")
    return gx.join(gy, PIXEL).select(*PIXEL, F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).alias("val"))


# --- local binary patterns --------------------------------------------------------------------------------------------


def _circle(a: np.ndarray, n: int, radius: float) -> list[np.ndarray]:
    """The n neighbours of each pixel on a circle."""
    return [sum(w * _shifted(a, dy, dx) for dy, dx, w in circle(k, n, radius)) for k in range(n)]


def _pattern(values: list[np.ndarray]) -> np.ndarray:
    """A bit for each value that isn't negative; rounded, so that equal sums in another order give equal bits."""
    return sum((np.round(v, 9) >= 0).astype(np.int32) << k for k, v in enumerate(values))


def lbp(images: DataFrame, radius: float = 1, n: int = 8) -> DataFrame:
    """The plain pattern of each pixel that has all its neighbours: neighbour >= centre."""
    work = lambda g, there: {"code": _pattern([v - g["val"] for v in _circle(g["val"].astype(float), n, radius)])}
    return inside(tiled(images.select(*PIXEL, "val"), math.ceil(radius), work, "code int"), images, math.ceil(radius))


def codes(images: DataFrame, n: int, large: float, small: float, wc: int, wl: int, ws: int, margin: int) -> DataFrame:
    """Median-robust extended patterns: image, y, x, centre (0 or 1), large, small and radial codes, inside the margin.

    Medians, neighbours and patterns of a tile are one step. Scaling an image by its standard deviation changes no sign here, so values are taken as they are.
    """

    def work(g: Grid, there: np.ndarray) -> Grid:
        medians = {w: _medians(g["val"].astype(float), w) for w in {wc, wl, ws}}
        l, s = _circle(medians[wl], n, large), _circle(medians[ws], n, small)
        ml, ms = sum(l) / n, sum(s) / n
        return {"m": medians[wc], "large": _pattern([v - ml for v in l]), "small": _pattern([v - ms for v in s]), "radial": _pattern([a - b for a, b in zip(l, s, strict=True)])}

    halo = max(math.ceil(large) + wl // 2, math.ceil(small) + ws // 2, wc // 2)
    t = inside(tiled(images.select(*PIXEL, "val"), halo, work, "m double, large int, small int, radial int"), images, margin)
    mean = t.groupBy("image").agg(F.avg("m").alias("mean"))
    return t.join(mean, "image").select(*PIXEL, (F.round(F.col("m") - F.col("mean"), 9) < 0).cast("int").alias("centre"), "large", "small", "radial")


def histogram(coded: DataFrame, n: int = 8, normalise: bool | None = None) -> DataFrame:
    """image, bin, val: 2 centre bins (not below the mean, below), then n + 2 bins each of large, small and radial patterns; bins without pixels are 0.

    normalise: None counts, True shares of all, False shares within each of the four histograms.
    """
    parts = [("centre", 0, 2), *((p, 2 + i * (n + 2), n + 2) for i, p in enumerate(("large", "small", "radial")))]
    bins = F.array(*(F.struct(F.lit(i).alias("part"), (F.col(p) if p == "centre" else uniform_code(F.col(p), n)).cast("int").alias("bin")) for i, (p, _, _) in enumerate(parts)))
    counts = coded.select("image", F.explode(bins).alias("b")).groupBy("image", "b.part", "b.bin").agg(F.count("*").alias("c"))
    start = F.element_at(F.array(*(F.lit(a) for _, a, _ in parts)), F.col("part") + 1)
    counts = counts.select("image", "part", (F.col("bin") + start).alias("bin"), "c")
    grid = coded.select("image").distinct().select("image", F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a + j).alias("bin")) for i, (_, a, m) in enumerate(parts) for j in range(m)))).alias("g")).select("image", "g.part", "g.bin")
    full = grid.join(counts, ["image", "part", "bin"], "left").select("image", "part", "bin", F.coalesce("c", F.lit(0)).alias("c"))
    if normalise is None:
        return full.select("image", "bin", F.col("c").cast("double").alias("val"))
    key = ["image"] if normalise else ["image", "part"]
    return full.join(full.groupBy(*key).agg(F.sum("c").alias("t")), key).select("image", "bin", (F.col("c") / F.greatest("t", F.lit(1))).alias("val"))


def mrelbp(images: DataFrame, n: int = 8, large: int = 2, small: int = 1, wc: int = 3, wl: int = 3, ws: int = 3, normalise: bool | None = None) -> DataFrame:
    return histogram(codes(images, n, large, small, wc, wl, ws, round(large + (wl - 1) / 2)), n, normalise)


def conv_mrelbp(images: DataFrame, n: int = 8, large: int = 2, small: int = 1, wc: int = 3, wl: int = 3, ws: int = 3) -> DataFrame:
    """The same with a margin of R + wl // 2 and each histogram normalised alone."""
    return histogram(codes(images, n, large, small, wc, wl, ws, large + wl // 2), n, False)


#: What a parameter set has.
SET = ("ks1", "sigma1", "ks2", "sigma2", "N", "large", "small", "wc", "wl", "ws")


def uniform_table(n: int) -> np.ndarray:
    """The bin of each n-bit pattern: its ones if at most two neighbours on the circle differ, else n + 1."""
    code = np.arange(1 << n)
    bits = (code[:, None] >> np.arange(n)) & 1
    return np.where((bits != np.roll(bits, 1, 1)).sum(1) <= 2, bits.sum(1), n + 1)


def _shrunk(own: np.ndarray, margin: int) -> np.ndarray:
    """Pixels of a rectangle that are `margin` or more inside it."""
    return own & _shifted(own, -margin, 0) & _shifted(own, margin, 0) & _shifted(own, 0, -margin) & _shifted(own, 0, margin)


def texture_sets(images: DataFrame, sets: list[dict], by_zone: bool = False) -> DataFrame:
    """image, par_id, bin, val: the features of local standardisation and median-robust patterns of every parameter set (par_id and SET).

    Images (image, y, x, val; rectangles) are read in tiles with the largest halo of all sets; a tile answers for every set,
    so that the passes over the data are two, whatever the number of sets: patterns and sums of the medians first, then how
    many medians are below their image's mean. Values are shares of all bins of an image. With by_zone images are named
    "zone/...", and a set with a `zone` answers for that zone alone.
    """
    for p in sets:
        if any(p[c] % 2 == 0 for c in ("ks1", "ks2", "wc", "wl", "ws")) or not 1 <= p["small"] < p["large"]:
            raise ValueError(f"windows are odd and 1 <= small < large: {p}")
    first = max(p["ks1"] // 2 + p["ks2"] // 2 for p in sets)
    halo = first + max(max(p["large"] + p["wl"] // 2, p["small"] + p["ws"] // 2, p["wc"] // 2) for p in sets)
    kind = dict(images.dtypes)["image"]
    source = _reflected(images, first)
    rows = f"image {kind}, par_id long, bin int, c double"
    gaussians = {(p[f"ks{i}"], p[f"sigma{i}"]): gauss(p[f"ks{i}"], p[f"sigma{i}"]) for p in sets for i in (1, 2)}
    bins = {p["N"]: uniform_table(p["N"]) for p in sets}

    def mine(t: pa.Table) -> list[dict]:
        image = t.column("image")[0].as_py()
        return [p for p in sets if not by_zone or p.get("zone") in (None, str(image).split("/", 1)[0])]

    def prepared(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, _, _, at = grids_of(t, ["val", "own"])
        tile = np.zeros(g["own"].shape, bool)
        tile[at] = True
        return g["val"], g["own"] == 1, tile

    def even(v: np.ndarray, own: np.ndarray, p: dict) -> np.ndarray:
        centred = v - _along(v, gaussians[p["ks1"], p["sigma1"]])
        squares = _along(centred**2, gaussians[p["ks2"], p["sigma2"]])
        return np.where(own, centred / (np.sqrt(np.maximum(squares, 0)) + 1e-9), 0.0)

    def margin(p: dict) -> int:
        return round(p["large"] + (p["wl"] - 1) / 2)

    def batch(t: pa.Table, out: list[tuple[int, int, float]]) -> pa.RecordBatch:
        image = pa.array([t.column("image")[0].as_py()] * len(out), t.schema.field("image").type)
        return pa.RecordBatch.from_arrays([image, pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([float(x[2]) for x in out], pa.float64())], names=["image", "par_id", "bin", "c"])

    def patterns(t: pa.Table) -> pa.RecordBatch:
        v, own, tile = prepared(t)
        out: list[tuple[int, int, float]] = []
        for p in mine(t):
            e, n = even(v, own, p), p["N"]
            inner = _shrunk(own, margin(p)) & tile
            medians = {w: _medians(e, w) for w in {p["wc"], p["wl"], p["ws"]}}
            large, small = _circle(medians[p["wl"]], n, p["large"]), _circle(medians[p["ws"]], n, p["small"])
            ml, ms = sum(large) / n, sum(small) / n
            for k, values in enumerate(([x - ml for x in large], [x - ms for x in small], [a - b for a, b in zip(large, small, strict=True)])):
                found = np.bincount(bins[n][_pattern([x[inner] for x in values])], minlength=n + 2)
                out += [(p["par_id"], 2 + k * (n + 2) + i, c) for i, c in enumerate(found.tolist())]
            out += [(p["par_id"], -1, medians[p["wc"]][inner].sum()), (p["par_id"], -2, inner.sum())]
        return batch(t, out)

    def centres(t: pa.Table) -> pa.RecordBatch:
        told = t.filter(pc.is_null(t.column("y")))
        means = dict(zip(told.column("par_id").to_pylist(), told.column("mean").to_pylist(), strict=True))
        t = t.filter(pc.is_valid(t.column("y")))
        if not t.num_rows:
            return batch(told, [])
        v, own, tile = prepared(t)
        out: list[tuple[int, int, float]] = []
        for p in mine(t):
            inner, mean = _shrunk(own, margin(p)) & tile, means.get(p["par_id"])
            below = 0 if mean is None else int((np.round(_medians(even(v, own, p), p["wc"])[inner] - mean, 9) < 0).sum())
            out += [(p["par_id"], 0, int(inner.sum()) - below), (p["par_id"], 1, below)]
        return batch(t, out)

    sums = by_tile(source, halo, patterns, rows).groupBy("image", "par_id", "bin").agg(F.sum("c").alias("c"))
    sums = shared.saved(sums, "patterns")
    n = F.max(F.when(F.col("bin") == -2, F.col("c")))
    means = sums.where("bin < 0").groupBy("image", "par_id").agg((F.max(F.when(F.col("bin") == -1, F.col("c"))) / F.when(n > 0, n)).alias("mean"), n.alias("n"))
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}_min") / TILE), F.floor(F.col(f"{a}_max") / TILE)))
    each = bounds(images).withColumn("ty", span("y")).withColumn("tx", span("x")).select("image", "ty", "tx").join(means.select("image", "par_id", "mean"), "image")
    both = by_tile(source.withColumns({"par_id": F.lit(None).cast("long"), "mean": F.lit(None).cast("double")}), halo, centres, rows, beside=each).unionByName(sums.where("bin >= 0"))
    counted = both.groupBy("image", "par_id", "bin").agg(F.sum("c").alias("c"))
    return counted.join(means.select("image", "par_id", "n"), ["image", "par_id"]).select("image", "par_id", "bin", (F.col("c") / F.greatest(4 * F.col("n"), F.lit(1.0))).alias("val"))


# --- noise ------------------------------------------------------------------------------------------------------------


def noise(images: DataFrame, size: int = 5) -> DataFrame:
    """image, mse, psnr of an image against its median filter; psnr is infinite where they are equal."""
    both = images.join(median_filter(images, size).withColumnRenamed("val", "m"), PIXEL)
    d = (F.col("val") - F.col("m")).cast("double")
    t = both.groupBy("image").agg(F.avg(d * d).alias("mse"), F.max("val").alias("top"))
    return t.select("image", "mse", F.when(F.col("mse") > 0, 20 * F.log10(F.col("top") / F.sqrt("mse"))).otherwise(F.lit(float("inf"))).alias("psnr"))


def ssim(a: DataFrame, b: DataFrame, size: int = 7, span: float = 255.0) -> DataFrame:
    """Mean structural similarity of two images over full size * size windows."""
    n, ones, c1, c2 = size * size, [1.0] * size, (0.01 * span) ** 2, (0.03 * span) ** 2

    def work(g: Grid, there: np.ndarray) -> Grid:
        p, q = g["p"], g["q"]
        mp, mq = _along(p, ones) / n, _along(q, ones) / n
        vp, vq, c = ((_along(u * v, ones) - n * s * t) / (n - 1) for u, v, s, t in ((p, p, mp, mp), (q, q, mq, mq), (p, q, mp, mq)))
        return {"s": (2 * mp * mq + c1) * (2 * c + c2) / ((mp * mp + mq * mq + c1) * (vp + vq + c2)), "full": (np.round(_along(there.astype(float), ones)) == n).astype(np.int32)}

    both = a.join(b.withColumnRenamed("val", "o"), PIXEL).select(*PIXEL, F.col("val").cast("double").alias("p"), F.col("o").cast("double").alias("q"))
    return tiled(both, size // 2, work, "s double, full int").where("full = 1").groupBy("image").agg(F.avg("s").alias("ssim"))


def padded(images: DataFrame, pad: int) -> DataFrame:
    """The image with `pad` rows and columns of zeros on each side; only the border is made new."""
    b = bounds(images)
    span = lambda a: F.sequence(F.col(f"{a}_min") - pad, F.col(f"{a}_max") + pad)
    grid = b.withColumn("y", F.explode(span("y"))).withColumn("x", F.explode(span("x")))
    border = grid.where("y < y_min or y > y_max or x < x_min or x > x_max").select(*PIXEL, F.lit(0).cast(images.schema["val"].dataType).alias("val"))
    return images.select(*PIXEL, "val").unionByName(border)
