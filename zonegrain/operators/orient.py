"""Orientation of a volume: the two angles at which its surface, seen along z, fills the smallest circle around it best.

Every sample has a state (two angles and the moves it found). In a round all samples are turned by four candidates each: a voxel goes to the
places that read it when the grid is turned back, so that no grid is made and no join is needed; what is seen along z is a set of
pixels. Rows of pixels shrink to their two ends, a task joins those to hulls, hulls of tasks to one; the circle is that of the
hull. The sign of the difference of losses moves each angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrain.sources import shared

#: Voxels that a task turns in a round.
TASK = 50_000
#: Angles that a pass looks at beyond those of a sample.
AHEAD = 6


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (n, 2), counter-clockwise; two or one where all lie on a line."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    sides = []
    for some in (p, p[::-1]):
        out: list[np.ndarray] = []
        for q in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        sides.append(out[:-1])
    return np.array(sides[0] + sides[1])


def _through(points: list[np.ndarray]) -> tuple[np.ndarray, float]:
    if len(points) == 1:
        return points[0], 0.0
    if len(points) == 2:
        c = (points[0] + points[1]) / 2
        return c, float(np.linalg.norm(points[0] - c))
    a, b, c = points
    m = 2 * np.array([b - a, c - a])
    if abs(np.linalg.det(m)) < 1e-12:
        return a, -1.0
    o = np.linalg.solve(m, np.array([b @ b - a @ a, c @ c - a @ a]))
    return o, float(np.linalg.norm(a - o))


def smallest_circle(points: np.ndarray) -> tuple[float, float, float]:
    """(y, x, r) of the smallest circle around points (n, 2): points that lie outside are put on it, one after the other."""
    p = np.random.default_rng(1).permutation(np.asarray(points, float))
    c, r = p[0], 0.0
    out = lambda q: np.linalg.norm(q - c) > r * (1 + 1e-12) + 1e-12
    for i in range(1, len(p)):
        if out(p[i]):
            c, r = p[i], 0.0
            for j in range(i):
                if out(p[j]):
                    c, r = _through([p[i], p[j]])
                    for k in range(j):
                        if out(p[k]):
                            c, r = _through([p[i], p[j], p[k]])
    return float(c[0]), float(c[1]), r


def _cells(cy: float, cx: float, r: float, height: int, width: int) -> int:
    """Pixels of a circle, cut at the grid."""
    rr = r * r + 1e-9
    row = np.arange(max(np.ceil(cy - np.sqrt(rr)), 0), min(np.floor(cy + np.sqrt(rr)), height - 1) + 1)
    half = np.sqrt(np.maximum(rr - (row - cy) ** 2, 0))
    return int(np.maximum(np.minimum(np.floor(cx + half), width - 1) - np.maximum(np.ceil(cx - half), 0) + 1, 0).sum())


def _rims(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what a task knows of each group of pixels: corners of the hull, their number, the grid."""
    kinds = ", ".join(f"{c} {t}" for c, t in pixels.select(*keys).dtypes)
    rows = pixels.groupBy(*keys, "y").agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.count("*").alias("pixels"), *(F.first(n).alias(n) for n in ("height", "width")))

    def rim(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for key, own in pdf.groupby(keys):
                corners = hull(np.concatenate([own[["y", "x1"]].to_numpy(float), own[["y", "x2"]].to_numpy(float)]))
                yield pd.DataFrame([[*key, corners[:, 0].tolist(), corners[:, 1].tolist(), own["pixels"].sum(), own["height"].iloc[0], own["width"].iloc[0]]], columns=[*keys, "hy", "hx", "pixels", "height", "width"])

    return rows.mapInPandas(rim, f"{kinds}, hy array<double>, hx array<double>, pixels long, height int, width int")


def _loss(rims: pd.DataFrame) -> float:
    """Of one group. The circle holds all pixels, so what both share is their number."""
    cy, cx, r = smallest_circle(hull(np.column_stack([np.concatenate(rims["hy"].tolist()), np.concatenate(rims["hx"].tolist())])))
    n = int(rims["pixels"].sum())
    return 1 - (2 * n + 1e-9) / (n + _cells(cy, cx, r, int(rims["height"].iloc[0]), int(rims["width"].iloc[0])) + 1e-9)


def circle_loss(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, loss: 1 - the Dice score of the pixels (keys, y, x, height, width: of the grid they lie in) and their smallest circle, cut at the grid."""
    kinds = ", ".join(f"{c} {t}" for c, t in pixels.select(*keys).dtypes)
    return _rims(pixels, keys).groupBy(*keys).applyInPandas(lambda key, pdf: pd.DataFrame([[*key, _loss(pdf)]], columns=[*keys, "loss"]), f"{kinds}, loss double")


_STEPS = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])


def _places(at: np.ndarray, shape: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (m, 3) that read voxels at (n, 3) of grids of a shape (n, 3) turned by a and b (n), and which voxel each reads."""
    trig = lambda rows: (f(np.radians(v[rows])) for v in (a, b) for f in (np.cos, np.sin))
    mid = (shape - 1) / 2
    ca, sa, cb, sb = trig(slice(None))
    y, x, z = (at - mid).T
    # Around y: (x, z); around x: (y, z).
    z1 = sa * x + ca * z
    to = np.floor(np.column_stack([cb * y - sb * z1, ca * x - sa * z, sb * y + cb * z1]) + mid + 0.5)
    # A step is at most 1, so what lies further out has no place inside and takes none.
    near = np.flatnonzero(((to >= -1) & (to <= shape)).all(1))
    place = (to[near][:, None] + _STEPS).reshape(-1, 3)
    of = np.repeat(near, len(_STEPS))
    inside = ((place >= 0) & (place < shape[of])).all(1)
    place, of = place[inside], of[inside]
    ca, sa, cb, sb = trig(of)
    v, u, w = (place - mid[of]).T
    back_z1 = cb * w - sb * v
    back = np.floor(np.column_stack([cb * v + sb * w, ca * u + sa * back_z1, ca * back_z1 - sa * u]) + mid[of] + 0.5)
    reads = (back == at[of]).all(1)
    return place[reads].astype(np.int32), of[reads]


_GRID = ["height", "width", "depth"]


def _turn(t: pa.RecordBatch, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """t (y, x, z, height, width, depth and other columns) with a row for each place."""
    numbers = lambda names: np.column_stack([t.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
    place, of = _places(numbers("yxz"), numbers(_GRID), a, b)
    rows = t.take(pa.array(of))
    return pa.RecordBatch.from_arrays([pa.array(place[:, "yxz".index(c)]) if c in "yxz" else rows.column(c) for c in t.schema.names], names=t.schema.names)


def turned(voxels: DataFrame, a: Column, b: Column) -> DataFrame:
    """The rows of voxels (y, x, z of what is on, and other columns) at their places after turning by a degrees around the y axis and then by b around the x axis, through the middle of the grid (height, width, depth).

    A place of the turned grid reads the nearest voxel of the grid; each voxel goes to all places that read it, inside the grid.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            yield _turn(t.select(t.schema.names[:-2]), t.column("__a").to_numpy(), t.column("__b").to_numpy())

    kinds = ", ".join(f"`{c}` {'int' if c in ('y', 'x', 'z') else k}" for c, k in voxels.dtypes)
    return voxels.withColumns({"__a": a.cast("double"), "__b": b.cast("double")}).mapInArrow(run, kinds)


def find_angles(voxels: DataFrame, alpha: float = 1.0, h: float = 5.0, steps: int = 20) -> DataFrame:
    """sample, a, b, loss: the angles that turn each sample (sample, y, x, z, val: a coarse grid, on where val > 0) so that what is seen from above fills its smallest circle best.

    Both angles move by alpha against the sign of the difference of the losses at +h and -h; alpha is halved after the first
    two rounds of every `steps`; there are steps + 2 rounds. A move depends on nothing but the angles, so a sample that comes
    back to angles it had (many go to and fro) takes the moves it found there, and its voxels aren't turned again; and a pass
    also finds the moves at the angles that come next if both go on as in the last two rounds. A column seen from above counts if its
    highest voxel isn't in the top layer.
    """
    grid = voxels.groupBy("sample").agg(*((F.max(c) + 1).cast("int").alias(n) for c, n in zip("yxz", _GRID, strict=True)))
    on = shared.saved(voxels.where("val > 0").select("sample", "y", "x", "z").join(grid, "sample"), "grid")
    on = shared.saved(on.repartition(on.count() // TASK + 1), "dealt")  # rows are few bytes, so files of them would be a few tasks
    kind, alphas = dict(grid.dtypes)["sample"], []
    for k in range(steps + 2):
        alphas.append(alpha)
        if (k % steps) // 2 == 0:
            alpha /= 2
    rounds = len(alphas)
    tries = [(0.0, 0.0), (h, 0.0), (-h, 0.0), (0.0, h), (0.0, -h)]
    places = ["sample", "y", "x", *_GRID]

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            last = t.column("k").to_numpy() == rounds
            for n, (da, db) in enumerate(tries):
                some = t if n else t.filter(pa.array(last))  # at the angles themselves once, in the end
                asked = n + len(tries) * some.column("ask").to_numpy()
                rows = some.select([*places, "z"]).append_column("try", pa.array(asked.astype(np.int32)))
                mine = _turn(rows, some.column("a").to_numpy() + da, some.column("b").to_numpy() + db)
                best = pa.Table.from_batches([mine]).group_by([*places, "try"]).aggregate([("z", "max")])
                yield from best.combine_chunks().to_batches()

    def moved(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, found = pdf[pdf["try"].isna()].iloc[0], pdf[pdf["try"].notna()]
        k, a, b, known, loss = int(own["k"]), own["a"], own["b"], list(own["known"]), own["loss"]
        losses = {int(n): _loss(rims) for n, rims in found.groupby("try")}
        if k == rounds:
            k, loss = k + 1, losses.get(0, 1.0 if losses else None)
        elif k < rounds:
            for n, at in enumerate(own["asked"]):
                side = [losses.get(len(tries) * n + m, 1.0) for m in range(1, len(tries))]
                known += [at["a"], at["b"], *(np.sign(round(side[m] - side[m + 1], 12)) for m in (0, 2))]
            moves = {(known[i], known[i + 1]): known[i + 2 : i + 4] for i in range(0, len(known), 4)}
            a, b, taken = 0.0, 0.0, []
            while len(taken) < rounds and (a, b) in moves:
                taken.append(moves[a, b])
                a, b = (v - alphas[len(taken) - 1] * d for v, d in zip((a, b), taken[-1], strict=True))
            k = len(taken)
        asked = [(a, b)]
        if 1 < k < rounds:
            for n in range(k, min(k + AHEAD, rounds - 1)):
                taken.append(taken[-2])
                asked.append(tuple(v - alphas[n] * d for v, d in zip(asked[-1], taken[-1], strict=True)))
            asked = [at for at in dict.fromkeys(asked) if at not in moves]
        return pd.DataFrame([[*key, k, a, b, known, loss, [{"a": p, "b": q} for p, q in asked]]], columns=columns)

    state = shared.saved(grid.select("sample", F.lit(0).alias("k"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.array().cast("array<double>").alias("known"), F.lit(None).cast("double").alias("loss"), F.array(F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))).alias("asked")), "angles")
    columns = state.columns
    while not state.where(F.col("k") <= rounds).isEmpty():
        turning = on.join(state.where(F.col("k") <= rounds).select("sample", "k", F.posexplode("asked").alias("ask", "at")).select("sample", "k", "ask", "at.*"), "sample")
        top = turning.mapInArrow(tops, ", ".join(f"{c} {kind if c == 'sample' else 'int'}" for c in [*places, "try", "z"]))
        seen = top.repartition("sample", "try", "y").groupBy("sample", "try", "y", "x").agg(F.max("z").alias("top"), *(F.first(n).alias(n) for n in _GRID))
        rims = _rims(seen.where(F.col("top") < F.col("depth") - 1), ["sample", "try"])
        state = shared.saved(rims.unionByName(state, allowMissingColumns=True).groupBy("sample").applyInPandas(moved, state.schema), "angles")
    return state.select("sample", "a", "b", "loss")
