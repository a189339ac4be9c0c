"""Void tests and drops against loops over columns and windows."""

import numpy as np

from zonegrain.operators import volume


def volume_of(spark, a):
    rows = [(0, int(y), int(x), int(z), int(a[y, x, z])) for y, x, z in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "sample int, y int, x int, z int, val int")


def column_zones(c, surface, deep, calc, offset, threshold):
    """One column: (void, deep voxels, calcified voxels), None where there is no voxel."""
    n = len(c)
    at = lambda i: int(c[i]) if 0 <= i < n else None
    base = deep if surface < deep else n - calc if n - surface < calc else surface - offset
    void = base > deep and any(0 <= base - i < n and c[base - i] < threshold / 2 for i in range(deep))
    start = end = base
    if void:
        start = base + offset if base < n - calc else base
        end = base - (offset if base - deep > offset else 0)
        while c[end] < threshold and end > deep:
            end -= 1
    return int(void), [at(end - deep + i) for i in range(deep)], [at(start + i) for i in range(calc)]


def test_void_zones(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((9, 9, 30)) < 0.3, rng.integers(0, 100, (9, 9, 30)), rng.integers(120, 256, (9, 9, 30)))
    surface = rng.integers(0, 30, (9, 9))
    surface[0, :4] = [2, 28, 10, 4]
    t = spark.createDataFrame([(0, int(y), int(x), int(surface[y, x])) for y, x in np.ndindex(9, 9)], "sample int, y int, x int, surface int")
    got = {}
    for r in volume.void_zones(volume_of(spark, a), t, 4, 5, 2, 200).collect():
        got[r.y, r.x, r.zone, r.z] = r.val
        got[r.y, r.x] = r.void
    seen = set()
    for y, x in np.ndindex(9, 9):
        void, deep, calc = column_zones(a[y, x], int(surface[y, x]), 4, 5, 2, 200)
        seen.add(void)
        assert got[y, x] == void
        assert [got.get((y, x, "deep", i)) for i in range(4)] == deep and [got.get((y, x, "calc", i)) for i in range(5)] == calc
    assert seen == {0, 1}


def test_void_zones_by_hand(spark):
    """Interface 8, offset 2: base 6. A void at 5, tissue upward from 4: the deep zone is 0 to 3, the calcified one starts at 8."""
    column = np.array([200, 200, 200, 200, 200, 10, 200, 200, 210, 220, 230, 240])
    t = spark.createDataFrame([(0, 0, 0, 8)], "sample int, y int, x int, surface int")
    got = sorted(tuple(r) for r in volume.void_zones(volume_of(spark, column[None, None]), t, 3, 3, 2, 100).select("zone", "z", "val", "void").collect())
    assert got == [("calc", 0, 210, 1), ("calc", 1, 220, 1), ("calc", 2, 230, 1), ("deep", 0, 200, 1), ("deep", 1, 200, 1), ("deep", 2, 200, 1)]


def test_drop_cut(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 60, (16, 16, 60))
    for i in range(16):
        first, last = sorted(rng.integers(0, 60, 2))
        y, x = 2 * (i // 4), 2 * (i % 4)
        a[y : y + 2, x : x + 2, first:last] += 120
    a[0:2, 0:2] = 0
    got = {(r.ry, r.rx): r.cut for r in volume.drop_cut(volume_of(spark, a), (0, 15, 0, 15), 100, 0, 50, 4, 6, 20.0, 8.0, 7).collect()}
    for i in range(16):
        y, x = 2 * (i // 4), 2 * (i % 4)
        box, flags = a[y : y + 2, x : x + 2], {}
        for k in range(0, 50, 4):
            w = box[:, :, k : k + 6]
            flags[k] = w[w > 100].sum() / 64 > 20
            if k > 4 and not flags[k] and flags[k - 4]:
                break
        last = max((k for k, f in flags.items() if f), default=0)
        assert got[i // 4, i % 4] == (60 if last == 0 else min(last + 7, 60)), i
