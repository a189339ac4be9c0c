"""Volumes by bricks: tiles over three axes with a halo, for boxes of any shape and for turns about any axis.

A voxel is sent to its brick and to the bricks whose halo it lies in: one shuffle, then numpy on one brick at a time. A brick
has a bounded size, so a volume of any size is dealt over all tasks. A voxel without a value counts as one that isn't there;
repeated voxels: any one of them counts. Columns but those that an operator names aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonegrain.operators import stencil, volume
from zonegrain.operators.volume import AXES

#: Voxels along each edge of a brick without its halo.
SIDE = 64
VOXEL = ["sample", *AXES]
KEYS = ["sample", *(f"b{a}" for a in AXES)]
Size = tuple[int, int, int]
Grid = dict[str, np.ndarray]


def _near(at: Column, halo: float, side: int) -> Column:
    return F.explode(F.sequence(F.floor((at - halo) / side), F.floor((at + halo) / side)))


def bricked(v: DataFrame, halo: Size, work: Callable[[Grid, np.ndarray], np.ndarray], side: int = SIDE) -> DataFrame:
    """v (sample, y, x, z and numbers) with `val`, a double: what work answers for each voxel.

    work gets each number as a grid over a brick with the halo around it (0 where no voxel is), and where voxels are.
    """
    names = [c for c in v.columns if c not in VOXEL]
    sent = v
    for a, h in zip(AXES, halo, strict=True):
        sent = sent.withColumn(f"b{a}", _near(F.col(a), h, side))

    def answer(t: pa.Table) -> pa.RecordBatch:
        at = [t.column(a).to_numpy().astype(np.int64) for a in AXES]
        place = tuple(p - p.min() for p in at)
        there = np.zeros([p.max() + 1 for p in place], bool)
        there[place] = True
        grids = {}
        for n in names:
            grids[n] = np.zeros(there.shape)
            grids[n][place] = t.column(n).to_numpy()
        own = np.logical_and.reduce([p // side == t.column(f"b{a}")[0].as_py() for a, p in zip(AXES, at, strict=True)])
        rows = t.select([*VOXEL, *names]).filter(pa.array(own))
        found = work(grids, there)[tuple(p[own] for p in place)].astype(float)
        return rows.append_column("_found", pa.array(found)).combine_chunks().to_batches()[0] if rows.num_rows else pa.RecordBatch.from_pylist([], schema=rows.schema.append(pa.field("_found", pa.float64())))

    kinds = ", ".join(f"{c} {dict(v.dtypes)[c]}" for c in [*VOXEL, *names])
    out = stencil.by_key(sent, KEYS, answer, f"{kinds}, _found double")
    return out.drop("val").withColumnRenamed("_found", "val")


def _window(a: np.ndarray, size: int, axis: int, best: np.ufunc, empty: float) -> np.ndarray:
    """best of a over size cells along the axis, from size // 2 before; a window of 2n is made of two of n."""
    pad = [(0, 0)] * a.ndim
    pad[axis] = (size // 2, size - 1 - size // 2)
    a = np.moveaxis(np.pad(a, pad, constant_values=empty), axis, 0)
    n = 1
    while 2 * n <= size:
        a, n = best(a[:-n], a[n:]), 2 * n
    if n < size:
        a = best(a[: n - size], a[size - n :])
    return np.moveaxis(a, 0, axis)


def _extreme(a: np.ndarray, there: np.ndarray, size: Size, largest: bool) -> np.ndarray:
    best, empty = (np.maximum, -np.inf) if largest else (np.minimum, np.inf)
    a = np.where(there, a, empty)
    for axis, n in enumerate(size):
        a = _window(a, n, axis, best, empty)
    return a


def _boxes(v: DataFrame, size: Size, steps: tuple[bool, ...], side: int) -> DataFrame:
    if min(size) < 1:
        raise ValueError(f"a box has one voxel or more along each axis: {size}")

    def work(g: Grid, there: np.ndarray) -> np.ndarray:
        a = g["val"]
        for largest in steps:
            a = _extreme(a, there, size, largest)
        return a

    kind = dict(v.dtypes)["val"]
    out = bricked(v.select(*VOXEL, "val").where("val is not null"), tuple(n // 2 * len(steps) for n in size), work, side)
    return out.withColumn("val", F.col("val").cast(kind))


def dilate(v: DataFrame, size: Size, side: int = SIDE) -> DataFrame:
    """Largest value of a box of size voxels along y, x and z; it begins size // 2 before the voxel and is cut where the volume ends."""
    return _boxes(v, size, (True,), side)


def erode(v: DataFrame, size: Size, side: int = SIDE) -> DataFrame:
    """Smallest value of such a box."""
    return _boxes(v, size, (False,), side)


def close(v: DataFrame, size: Size, side: int = SIDE) -> DataFrame:
    """dilate, then erode by the same box, in one shuffle."""
    return _boxes(v, size, (True, False), side)


def suppressed(v: DataFrame, seed: Column, tissue: Column, kept: Column, size: Size, side: int = SIDE) -> DataFrame:
    """sample, y, x, z, val: 255 where a mask stands after false positives are taken out, else 0.

    Conditions on v: seed, sure voxels of the mask; tissue, voxels of the sample; kept, voxels that the result may hold. The
    tissue outside the seeds is closed by the box; what is left of the seeds outside it is dilated by the box. A condition that
    is null doesn't hold.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    t = v.select(*VOXEL, flag(seed).alias("seed"), flag(tissue).alias("tissue"), flag(kept).alias("kept"))

    def left(g: Grid, there: np.ndarray) -> np.ndarray:
        other = (g["tissue"] > 0) & (g["seed"] == 0)
        shut = _extreme(_extreme(other.astype(float), there, size, True), there, size, False) > 0
        return (g["seed"] > 0) & ~shut

    def grown(g: Grid, there: np.ndarray) -> np.ndarray:
        return (_extreme(g["val"], there, size, True) > 0) & (g["kept"] > 0)

    half = tuple(n // 2 for n in size)
    rest = bricked(t, tuple(2 * h for h in half), left, side).select(*VOXEL, "kept", "val")
    return bricked(rest, half, grown, side).select(*VOXEL, (F.col("val") * 255).cast("int").alias("val"))


def _weights(part: np.ndarray, cubic: bool) -> list[tuple[int, np.ndarray]]:
    """Steps from the cell below to cells that count, and how much each counts."""
    if not cubic:
        return [(0, 1 - part), (1, part)]
    near = lambda t: 1.5 * t**3 - 2.5 * t**2 + 1
    far = lambda t: -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2
    return [(-1, far(part + 1)), (0, near(part)), (1, near(1 - part)), (2, far(2 - part))]


def turned(v: DataFrame, degrees: Column, axis: str = "z", cubic: bool = False, grown: bool = False, least: float = 0.0, most: float = 360.0, side: int = SIDE) -> DataFrame:
    """sample, y, x, z, val: each sample turned about an axis through the middle of its extent.

    degrees: a column of sample. A turn below `least` or above `most` (absolute), or null, is none. Values are linear between
    the neighbours in the plane of the turn, or cubic (four by four, Catmull-Rom); voxels that aren't there count as 0. The result
    holds every voxel of the sample's extent, or (grown) of the box around the turned extent, whose places may be negative.
    What no voxel reaches, as most of a grown box, leaves numpy as rows of a stretch or of a whole brick with its ends, which
    Spark deals out into zeros.
    """
    b, c = (a for a in AXES if a != axis)
    reach = (2 if cubic else 1) * 1.42  # a neighbour of a place lies within 1 or 2 of it along each axis, whatever the turn
    v = v.where("val is not null")
    whole = F.when(F.abs(degrees).between(least, most), degrees).otherwise(0.0).cast("double") * (math.pi / 180)
    turn = volume.extent(v).select("sample", *(F.col(f"{a}_{e}") for a in AXES for e in ("min", "max"))).withColumn("a", whole)
    for a in AXES:
        turn = turn.withColumn(f"c{a}", (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2)
    if grown:
        wide = {a: (F.col(f"{a}_max") - F.col(f"{a}_min")) for a in (b, c)}
        for a, o in ((b, c), (c, b)):
            half = F.round((F.abs(F.cos("a")) * wide[a] + F.abs(F.sin("a")) * wide[o]) / 2, 9)
            turn = turn.withColumn(f"{a}_lo", F.ceil(F.col(f"c{a}") - half)).withColumn(f"{a}_hi", F.floor(F.col(f"c{a}") + half))
    else:
        for a in (b, c):
            turn = turn.withColumn(f"{a}_lo", F.col(f"{a}_min")).withColumn(f"{a}_hi", F.col(f"{a}_max"))
    turn = turn.withColumn(f"{axis}_lo", F.col(f"{axis}_min")).withColumn(f"{axis}_hi", F.col(f"{axis}_max"))

    frame = turn.select("sample", "a", f"c{b}", f"c{c}", *(F.col(f"{a}_{e}").cast("long").alias(f"{a}_{e}") for a in AXES for e in ("lo", "hi")))
    for a in AXES:
        frame = frame.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(f"{a}_lo") / side), F.floor(F.col(f"{a}_hi") / side))))
    db, dc = F.col(b) - F.col(f"c{b}"), F.col(c) - F.col(f"c{c}")
    to = {b: F.col(f"c{b}") + F.cos("a") * db - F.sin("a") * dc, c: F.col(f"c{c}") + F.sin("a") * db + F.cos("a") * dc}
    sent = v.join(turn, "sample").select("sample", *(F.col(a).cast("long").alias(a) for a in AXES), F.col("val").cast("double").alias("val"), F.floor(F.col(axis) / side).alias(f"b{axis}"), to[b].alias("tb"), to[c].alias("tc"))
    sent = sent.withColumn(f"b{b}", _near(F.col("tb"), reach, side)).withColumn(f"b{c}", _near(F.col("tc"), reach, side)).drop("tb", "tc")
    kind = dict(v.dtypes)["sample"]
    ends = [f"{a}_end" for a in AXES]

    def answer(t: pa.Table) -> pa.RecordBatch:
        framed = t.column("a").is_valid().combine_chunks()
        head = t.filter(framed).slice(0, 1).to_pylist()
        some = t.schema.field("sample").type

        def made(name: pa.Array, at: list, val: np.ndarray, last: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([name, *(pa.array(p, pa.int32()) for p in at), pa.array(val, pa.float64()), *(pa.array(p, pa.int32()) for p in last)], names=[*VOXEL, "val", *ends])

        if not head:  # beyond the box
            return made(pa.array([], some), [[]] * 3, np.zeros(0), [[]] * 3)
        h, rows = head[0], t.filter(t.column("val").is_valid())
        span = {a: (max(h[f"b{a}"] * side, h[f"{a}_lo"]), min(h[f"b{a}"] * side + side - 1, h[f"{a}_hi"])) for a in AXES}
        if not rows.num_rows:
            return made(pa.array([h["sample"]], some), [[span[a][0]] for a in AXES], np.zeros(1), [[span[a][1]] for a in AXES])
        place = {a: np.arange(lo, hi + 1) for a, (lo, hi) in span.items()}
        out = np.zeros([len(place[a]) for a in (b, c, axis)])
        reached = np.zeros(out.shape[:2], bool)
        at = {a: rows.column(a).to_numpy() for a in AXES}
        low = {a: at[a].min() for a in (b, c)}
        # One cell of zeros at the end of b and c, for neighbours that aren't there.
        source = np.zeros((at[b].max() - low[b] + 2, at[c].max() - low[c] + 2, out.shape[2]))
        source[at[b] - low[b], at[c] - low[c], at[axis] - place[axis][0]] = rows.column("val").to_numpy()
        pb, pc = np.meshgrid(place[b] - h[f"c{b}"], place[c] - h[f"c{c}"], indexing="ij")
        cos, sin = math.cos(h["a"]), math.sin(h["a"])
        # Rounded so that whole positions stay whole.
        fb, fc = np.round(h[f"c{b}"] + cos * pb + sin * pc, 9), np.round(h[f"c{c}"] - sin * pb + cos * pc, 9)
        for ib, wb in _weights(fb - np.floor(fb), cubic):
            for ic, wc in _weights(fc - np.floor(fc), cubic):
                nb, nc = np.floor(fb).astype(int) + ib - low[b], np.floor(fc).astype(int) + ic - low[c]
                nb[(nb < 0) | (nb >= len(source) - 1)] = -1
                nc[(nc < 0) | (nc >= source.shape[1] - 1)] = -1
                out += (wb * wc)[..., None] * source[nb, nc]
                reached |= (nb >= 0) & (nc >= 0)
        ib, ic = np.nonzero(reached)
        here = {b: np.repeat(place[b][ib], out.shape[2]), c: np.repeat(place[c][ic], out.shape[2]), axis: np.tile(place[axis], len(ib))}
        step = np.diff(np.pad(~reached, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (gb, first), (_, after) = np.nonzero(step == 1), np.nonzero(step == -1)
        gap = {b: place[b][gb], c: place[c][first], axis: np.full(len(gb), span[axis][0])}
        last = {**gap, c: place[c][after - 1], axis: np.full(len(gb), span[axis][1])}
        val = np.concatenate([out[ib, ic].ravel(), np.zeros(len(gb))])
        name = pa.array([h["sample"]], some).take(pa.array(np.zeros(len(val), np.int64)))
        return made(name, [np.concatenate([here[a], gap[a]]) for a in AXES], val, [np.concatenate([here[a], last[a]]) for a in AXES])

    found = stencil.by_key(sent.unionByName(frame, allowMissingColumns=True), KEYS, answer, f"sample {kind}, y int, x int, z int, val double, {', '.join(f'{e} int' for e in ends)}")
    for a, e in zip(AXES, ends, strict=True):
        found = found.withColumn(a, F.explode(F.sequence(a, e)))
    return found.select(*VOXEL, "val")
