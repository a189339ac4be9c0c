"""Bricks against plain loops over whole arrays, with bricks small enough that every border is met."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.operators import brick, volume


def table(spark, volumes):
    rows = [(s, y, x, z, float(a[y, x, z])) for s, a in volumes.items() for y, x, z in np.ndindex(a.shape) if not np.isnan(a[y, x, z])]
    return spark.createDataFrame(rows, "sample int, y int, x int, z int, val double")


def grid(df, sample, shape, low=(0, 0, 0)):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("sample") == sample).collect():
        at = r.y - low[0], r.x - low[1], r.z - low[2]
        assert np.isnan(out[at])
        out[at] = r.val
    return out


def box(a, size, best):
    """By every voxel's own box, cut at the ends; missing voxels don't count."""
    out = np.full(a.shape, np.nan)
    for at in np.ndindex(a.shape):
        if not np.isnan(a[at]):
            near = a[tuple(slice(max(0, p - n // 2), p - n // 2 + n) for p, n in zip(at, size, strict=True))]
            out[at] = best(near)
    return out


@pytest.mark.parametrize("size", [(3, 3, 3), (1, 1, 7), (1, 4, 1), (5, 2, 3), (1, 1, 50)])
def test_boxes(spark, size):
    rng = np.random.default_rng(sum(size))
    a = rng.integers(0, 99, (7, 9, 11)).astype(float)
    a[rng.random(a.shape) < 0.1] = np.nan
    b = rng.integers(0, 99, (4, 4, 4)).astype(float)
    v = table(spark, {1: a, 2: b})
    for s, one in ((1, a), (2, b)):
        assert np.array_equal(grid(brick.dilate(v, size, 4), s, one.shape), box(one, size, np.nanmax), equal_nan=True)
        assert np.array_equal(grid(brick.erode(v, size, 4), s, one.shape), box(one, size, np.nanmin), equal_nan=True)
        assert np.array_equal(grid(brick.close(v, size, 4), s, one.shape), box(box(one, size, np.nanmax), size, np.nanmin), equal_nan=True)


def test_suppression(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (8, 8, 12)).astype(float)
    seed, other = a > 190, (a > 150) & (a <= 190)
    shut = box(box(other.astype(float), (3, 3, 3), np.max), (3, 3, 3), np.min) > 0
    wide = box((seed & ~shut).astype(float), (3, 3, 3), np.max) > 0
    want = np.where(wide & (a > 120), 255, 0)
    got = brick.suppressed(table(spark, {1: a}), F.col("val") > 190, F.col("val") > 150, F.col("val") > 120, (3, 3, 3), 4)
    assert 0 < want.sum() < 255 * want.size and (grid(got, 1, a.shape) == want).all()


def weight(t, cubic):
    t = abs(t)
    if not cubic:
        return max(0.0, 1 - t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


@pytest.mark.parametrize(("axis", "cubic", "grown"), list(itertools.product("yxz", (False, True), (False, True))))
def test_turns(spark, axis, cubic, grown):
    """Every voxel of the result as a weighted sum over all voxels of the plane."""
    a = np.random.default_rng(2).integers(1, 99, (5, 7, 10)).astype(float)
    degrees = {1: 17.0, 2: -33.0, 3: 2.0}
    got = brick.turned(table(spark, dict.fromkeys(degrees, a)), F.when(F.col("sample") == 1, 17.0).when(F.col("sample") == 2, -33.0).otherwise(2.0), axis, cubic, grown, 4, 40, 4)
    p, q = (i for i in range(3) if "yxz"[i] != axis)
    for s, angle in degrees.items():
        t = math.radians(angle if 4 <= abs(angle) <= 40 else 0)
        mid = [(n - 1) / 2 for n in a.shape]
        low, high = [0, 0, 0], [n - 1 for n in a.shape]
        if grown:
            for i, o in ((p, q), (q, p)):
                half = round((abs(math.cos(t)) * (a.shape[i] - 1) + abs(math.sin(t)) * (a.shape[o] - 1)) / 2, 9)
                low[i], high[i] = math.ceil(mid[i] - half), math.floor(mid[i] + half)
        shape = [h - k + 1 for k, h in zip(low, high, strict=True)]
        flat = np.moveaxis(a, "yxz".index(axis), 2)
        want = np.zeros([shape[p], shape[q], flat.shape[2]])
        for i, j in np.ndindex(want.shape[:2]):
            di, dj = i + low[p] - mid[p], j + low[q] - mid[q]
            fi, fj = mid[p] + math.cos(t) * di + math.sin(t) * dj, mid[q] - math.sin(t) * di + math.cos(t) * dj
            for k, m in np.ndindex(flat.shape[:2]):
                want[i, j] += weight(fi - k, cubic) * weight(fj - m, cubic) * flat[k, m]
        want = np.moveaxis(want, 2, "yxz".index(axis))
        assert np.allclose(grid(got, s, shape, low), want, atol=1e-6)


def test_turn_about_z_is_the_joined_turn(spark):
    a = np.random.default_rng(3).integers(0, 99, (6, 9, 5)).astype(float)
    v = table(spark, {1: a})
    assert np.allclose(grid(brick.turned(v, F.lit(12.0), side=4), 1, a.shape), grid(volume.rotated(v, F.lit(12.0)), 1, a.shape))


def test_odd_tables(spark):
    """No voxel, a voxel without a value, one voxel, negative places; an angle that is null turns nothing."""
    empty = spark.createDataFrame([], "sample int, y int, x int, z int, val double")
    assert brick.close(empty, (3, 3, 3)).count() == 0 and brick.turned(empty, F.lit(9.0)).count() == 0
    v = spark.createDataFrame([(1, -5, 2, -70, 3.0), (1, -5, 2, -69, None)], empty.schema)
    assert [tuple(r) for r in brick.dilate(v, (3, 3, 3)).collect()] == [(1, -5, 2, -70, 3.0)]
    assert [tuple(r) for r in brick.turned(v, F.lit(None), "y", grown=True).collect()] == [(1, -5, 2, -70, 3.0)]
    with pytest.raises(ValueError, match="a box has"):
        brick.dilate(v, (0, 3, 3))


def test_empty_part_of_a_grown_box_is_not_made_by_numpy(spark, monkeypatch):
    """A thin sample of 300 layers, turned by 45 degrees: the box has a voxel for each place, of which numpy hands on few."""
    a = np.ones((1, 3, 300))
    handed, by_key = [], brick.stencil.by_key
    monkeypatch.setattr(brick.stencil, "by_key", lambda *args: handed.append(by_key(*args)) or handed[-1])
    got = brick.turned(table(spark, {1: a}), F.lit(45.0), "y", grown=True, side=16)
    n = 2 * math.floor(math.sqrt(0.5) * (2 + 299) / 2 + 0.5)
    assert got.count() == got.distinct().count() == n * (n + 1)
    assert handed[0].count() < n * n / 8
