"""Regions of images of any size: components by tiles, filled outlines, their area and centre, and the crop of an empty corner.

A tile labels its own pixels; pixels that touch across tile borders give edges between labels, and unions of those labels (a
table of border labels, far smaller than the image) make them one. Filling asks what the border of the image can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import stencil
from zonegrain.sources import shared

PIXEL = stencil.PIXEL
FOUR = [(0, 1), (1, 0)]
EIGHT = [*FOUR, (1, 1), (1, -1)]


def grid_labels(on: np.ndarray, moves: list[tuple[int, int]]) -> np.ndarray:
    """The place of the first pixel of its component for each pixel that is on; -1 elsewhere."""
    place = np.arange(on.size).reshape(on.shape)
    up = np.where(on, place, -1).ravel()
    h, w = on.shape
    a, b = [], []
    for dy, dx in moves:
        rows, left, right = slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)), slice(max(0, dx), w - max(0, -dx))
        both = on[rows, left] & on[dy:, right]
        a.append(place[rows, left][both])
        b.append(place[dy:, right][both])
    a, b = np.concatenate(a), np.concatenate(b)
    while len(a):
        ra, rb = up[a], up[b]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        live = up >= 0
        while True:
            far = np.where(live, up[up], -1)
            if (far == up).all():
                break
            up = far
        open_ = up[a] != up[b]
        a, b = a[open_], b[open_]
    return up.reshape(on.shape)


def unions(edges: DataFrame) -> DataFrame:
    """image, node, root: nodes of edges (image, a, b) with the least node of their component.

    A round points each node to its least neighbour, follows pointers to their ends, and contracts the edges between ends.
    """
    spark = edges.sparkSession
    edges = shared.saved(edges.where("a <> b").distinct(), "edges")
    out = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select("image", F.col("b").alias("a"), F.col("a").alias("b")))
        up = shared.saved(both.groupBy("image", F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "pointers")
        while True:
            far = up.select("image", F.col("node").alias("root"), F.col("root").alias("end"))
            up = shared.saved(up.join(far, ["image", "root"]).select("image", "node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "pointers")
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.drop("moved")
        at = lambda c: up.select("image", F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        edges = shared.saved(edges.join(at("a"), ["image", "a"]).join(at("b"), ["image", "b"]).where("ra <> rb").select("image", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        out = up if out is None else shared.saved(out.join(up.select("image", F.col("node").alias("root"), F.col("root").alias("end")), ["image", "root"], "left").select("image", "node", F.coalesce("end", "root").alias("root")), "roots")
    kind = dict(both.dtypes)["image"] if out is not None else dict(edges.dtypes)["image"]
    return out if out is not None else spark.createDataFrame([], f"image {kind}, node long, root long")


def labelled(images: DataFrame, eight: bool = True, tile: int = stencil.TILE) -> DataFrame:
    """image, y, x, on, label: components of the pixels that are on (image, y, x, on), by edges (or corners: eight) that touch.

    label is y * 2^31 + x of a pixel of the component, -1 where the pixel is off; y and x are not negative.
    """
    moves = EIGHT if eight else FOUR
    kind = dict(images.dtypes)["image"]

    def answer(t: pa.Table) -> pa.RecordBatch:
        label = np.full(t.num_rows, -1)
        for some, g, _, at, y0, x0 in stencil.stacks_of(t, ["on"]):
            # One below the other, with an empty row between.
            n, h, w = g["on"].shape
            place = grid_labels(np.pad(g["on"] != 0, ((0, 0), (0, 1), (0, 0))).reshape(-1, w), moves).reshape(n, h + 1, w)[at]
            row = place // w % (h + 1)
            label[some] = np.where(place >= 0, (y0[at[0]] + row) * (1 << 31) + x0[at[0]] + place % w, -1)
        rows = t.combine_chunks()
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in (*PIXEL, "on")), pa.array(label)], names=[*PIXEL, "on", "label"])

    found = shared.saved(stencil.by_tile(images.select(*PIXEL, F.col("on").cast("int").alias("on")), 0, answer, f"image {kind}, y {dict(images.dtypes)['y']}, x {dict(images.dtypes)['x']}, on int, label long", tile, lots=True), "tile-labels")
    rim = found.where("label >= 0").where(f"y % {tile} in (0, {tile - 1}) or x % {tile} in (0, {tile - 1})")
    near = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in moves))
    sent = rim.select("image", "y", "x", F.col("label").alias("a"), F.explode(near).alias("m")).select("image", (F.col("y") + F.col("m.dy")).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "a")
    roots = unions(sent.join(rim.select(*PIXEL, F.col("label").alias("b")), PIXEL).select("image", "a", "b"))
    return found.join(roots.withColumnRenamed("node", "label"), ["image", "label"], "left").select(*PIXEL, "on", F.coalesce("root", "label").alias("label"))


def filled(images: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """image, y, x, on: what is on, and what it encloses: pixels that the image's border doesn't reach over edges of pixels that are off."""
    off = labelled(images.select(*PIXEL, (1 - F.col("on")).alias("on")), False, tile)
    t = off.join(stencil.bounds(images), "image")
    rim = (F.col("y") == F.col("y_min")) | (F.col("y") == F.col("y_max")) | (F.col("x") == F.col("x_min")) | (F.col("x") == F.col("x_max"))
    outside = t.where(rim & (F.col("label") >= 0)).select("image", "label").distinct().withColumn("out", F.lit(1))
    return off.join(outside, ["image", "label"], "left").select(*PIXEL, (1 - F.coalesce("out", F.lit(0))).alias("on"))


def outlines(labels: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """image, label, area, cy, cx, y1, y2, x1, x2, pixels: the outline through the centres of a component's border pixels.

    labels: image, y, x, label (-1: none), without holes. A square between four pixels of the component counts whole, one with three of
    them half; area and first moments are sums of those, so one pass over tiles makes them. A component without area has null centres.
    """
    kind = dict(labels.dtypes)["image"]
    schema = f"image {kind}, label long, area double, my double, mx double, y1 long, y2 long, x1 long, x2 long, pixels long"

    def answer(t: pa.Table) -> pa.RecordBatch:
        g, _, _, at = stencil.grids_of(t.append_column("lab", pa.array(t.column("label").to_numpy() + 1)), ["lab"], tile)
        lab = np.pad(g["lab"], ((0, 1), (0, 1)))
        y0, x0 = int(t.column("y").to_numpy().min()), int(t.column("x").to_numpy().min())
        four = np.stack([lab[:-1, :-1], lab[:-1, 1:], lab[1:, :-1], lab[1:, 1:]])[:, at[0], at[1]]
        some, which = four > 0, four.max(0)
        n = some.sum(0)
        # The centre of the square, or of the triangle of the three pixels.
        dy, dx = np.array([0, 0, 1, 1])[:, None], np.array([0, 1, 0, 1])[:, None]
        size = np.where(n == 4, 1.0, np.where(n == 3, 0.5, 0.0))
        cy, cx = (at[0] + y0 + (some * dy).sum(0) / np.maximum(n, 1)), (at[1] + x0 + (some * dx).sum(0) / np.maximum(n, 1))
        own = lab[at]
        out = []
        for k in np.unique(np.concatenate([which[size > 0], own[own > 0]])).tolist():
            s, m = np.where(which == k, size, 0.0), own == k
            ys, xs = at[0][m] + y0, at[1][m] + x0
            ends = [int(f(v)) if len(v) else None for v in (ys, xs) for f in (np.min, np.max)]
            out.append((k - 1, s.sum(), (s * cy).sum(), (s * cx).sum(), *ends, int(m.sum())))
        image = pa.array([t.column("image")[0].as_py()] * len(out), t.schema.field("image").type)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), *[pa.float64()] * 3, *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([image, *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=names)

    parts = stencil.by_tile(labels.select(*PIXEL, "label"), 1, answer, schema, tile)
    t = parts.groupBy("image", "label").agg(F.sum("area").alias("area"), F.sum("my").alias("my"), F.sum("mx").alias("mx"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.sum("pixels").alias("pixels"))
    centre = lambda m: F.when(F.col("area") > 0, F.col(m) / F.col("area"))
    return t.select("image", "label", "area", centre("my").alias("cy"), centre("mx").alias("cx"), "y1", "y2", "x1", "x2", "pixels")


def largest_outline(images: DataFrame, tile: int = stencil.TILE) -> tuple[DataFrame, DataFrame]:
    """The outline of largest area of each image (of ties the lowest label), and the labels that it is one of."""
    labels = shared.saved(labelled(filled(images, tile), True, tile), "regions")
    top = outlines(labels, tile).groupBy("image").agg(F.max_by(F.struct("label", "area", "cy", "cx", "y1", "y2", "x1", "x2", "pixels"), F.struct("area", -F.col("label"))).alias("o"))
    return shared.saved(top.select("image", "o.*"), "outlines"), labels


def adaptive_threshold(images: DataFrame, size: int = 11, less: int = 2, tile: int = stencil.TILE) -> DataFrame:
    """image, y, x, on: val, as a byte, is above the rounded mean of size * size pixels minus `less`; the edge is repeated."""
    h = size // 2

    def work(g: stencil.Grid, there: np.ndarray) -> stencil.Grid:
        v = g["val"].astype(np.int64) & 255
        wide = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (h, h), (h, h)), mode="edge"), (size, size), (1, 2))
        return {"on": (v - np.rint(wide.sum((3, 4)) / size**2) > -less).astype(np.int32)}

    return stencil.tiled(images.select(*PIXEL, "val"), h, work, "on int", tile, True)


def _extreme(a: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The largest (least) of size * size pixels of each grid of a stack, of those that are there."""
    h = size // 2
    wide = np.pad(a, ((0, 0), (h, h), (h, h)), constant_values=np.inf if least else -np.inf)
    wide = np.lib.stride_tricks.sliding_window_view(wide, (size, size), (1, 2))
    return wide.min((3, 4)) if least else wide.max((3, 4))


def corner_crop(images: DataFrame, tile: int = stencil.TILE) -> DataFrame:
    """image, y, x, val, cropped: images (image, y, x, val; rectangles) without a corner that has no sample.

    The largest outline of what is above the local mean is filled and painted white; what a closing of 7 * 7 leaves below white
    is empty. If the box of the largest empty region lies in a corner, the rows and columns of the box are cut off, unless half
    the image or less would remain. Places count from 0 after the cut.
    """
    images = shared.saved(images.select(*PIXEL, F.col("val").cast("double").alias("val")), "uncropped")
    top, labels = largest_outline(adaptive_threshold(images, tile=tile), tile)
    inside = labels.join(top.select("image", "label"), ["image", "label"], "left_semi").select(*PIXEL, F.lit(1).alias("white"))
    painted = images.join(inside, PIXEL, "left").select(*PIXEL, F.when(F.col("white") == 1, 255.0).otherwise(F.col("val")).alias("val"))
    work = lambda g, there: {"on": (_extreme(_extreme(g["val"], 7, False), 7, True) < 255).astype(np.int32)}
    empty, _ = largest_outline(shared.saved(stencil.tiled(painted, 6, work, "on int", tile, True), "corners"), tile)
    b = stencil.bounds(images).join(empty, "image", "left")
    h, w = F.col("y2") - F.col("y1") + 1, F.col("x2") - F.col("x1") + 1
    height, width = F.col("y_max") - F.col("y_min") + 1, F.col("x_max") - F.col("x_min") + 1
    left, right, upper, lower = F.col("x1") == F.col("x_min"), F.col("x2") == F.col("x_max"), F.col("y1") == F.col("y_min"), F.col("y2") == F.col("y_max")
    corner = (left | right) & (upper | lower) & (2 * (height - h) * (width - w) > height * width)
    cut = b.select("image", F.coalesce(corner, F.lit(False)).alias("cropped"), *(F.col(f"{a}_{e}").alias(f"{a}_{e}") for a in "yx" for e in ("min", "max")), h.alias("h"), w.alias("w"), upper.alias("upper"), left.alias("left"))
    cut = cut.select("image", "cropped", *(F.when(F.col("cropped") & F.col(side), F.col(f"{a}_min") + F.col(n)).otherwise(F.col(f"{a}_min")).alias(f"{a}_from") for a, side, n in (("y", "upper", "h"), ("x", "left", "w"))), *(F.when(F.col("cropped") & ~F.col(side), F.col(f"{a}_max") - F.col(n)).otherwise(F.col(f"{a}_max")).alias(f"{a}_to") for a, side, n in (("y", "upper", "h"), ("x", "left", "w"))))
    kept = images.join(cut, "image").where("y between y_from and y_to and x between x_from and x_to")
    return kept.select("image", *((F.col(a) - F.col(f"{a}_from")).cast(dict(images.dtypes)[a]).alias(a) for a in "yx"), "val", "cropped")
