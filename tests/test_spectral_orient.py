"""Spectral clusters against dense eigenvectors and planted regions, circles by brute force, angles of turned bodies."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.operators import orient, spectral


def dense(a):
    """Normalised weights of the pixels that aren't background."""
    on = [(y, x) for (y, x), v in np.ndenumerate(a) if v]
    at, sd = {p: i for i, p in enumerate(on)}, np.std([a[p] for p in on])
    w = np.zeros((len(on), len(on)))
    for (y, x), i in at.items():
        for q in ((y, x + 1), (y + 1, x)):
            if q in at:
                w[i, at[q]] = w[at[q], i] = np.exp(-abs(a[y, x] - a[q]) / max(sd, 1e-9))
    root = np.sqrt(w.sum(0))
    return w / np.outer(root, root)


def table(spark, arrays):
    return spark.createDataFrame([(k, y, x, float(v)) for k, a in enumerate(arrays) for (y, x), v in np.ndenumerate(a)], "image int, y int, x int, val double")


def test_eigenvalues_against_numpy(spark):
    rng = np.random.default_rng(4)
    some = [rng.integers(1, 200, (11, 13)), rng.integers(1, 50, (9, 17))]
    some[1][2:4, 3:9] = 0
    vectors, values = spectral.eigenvectors(table(spark, some), 3, 12, tile=8)
    rows = vectors.collect()
    for k, a in enumerate(some):
        m = dense(a)
        want = np.linalg.eigvalsh(m)[::-1][:3]
        got = [r.value for r in sorted(values.where(f"image = {k}").collect(), key=lambda r: r.i)]
        assert got == pytest.approx(want.tolist(), abs=1e-6)
        mine = sorted((r.y, r.x, r.v0, r.v1, r.v2) for r in rows if r.image == k)
        v = np.array([r[2:] for r in mine])
        assert np.abs(m @ v - v * np.array(got)).max() < 1e-3 and v.T @ v == pytest.approx(np.eye(3), abs=1e-6)


def test_planted_regions(spark):
    rng = np.random.default_rng(5)
    a = np.where(np.arange(20)[None] < 15, 60, 180) + rng.integers(-3, 4, (16, 20))
    b = np.where(np.add.outer(np.arange(14), np.arange(15)) < 20, 40, 150) + rng.integers(-3, 4, (14, 15))
    got = spectral.spectral_clusters(table(spark, [a, b]), 2, 16, tile=8).collect()
    for k, regions in enumerate((a > 120, b > 100)):
        pairs = {(bool(regions[r.y, r.x]), r.cluster) for r in got if r.image == k}
        assert len(pairs) == 2 and len({c for _, c in pairs}) == 2


def brute_circle(p):
    best = None
    for n in (1, 2, 3):
        for some in itertools.combinations(p, n):
            c, r = orient._through([np.array(q, float) for q in some])
            if r >= 0 and (np.hypot(*(np.array(p) - c).T) <= r + 1e-7).all() and (best is None or r < best):
                best = r
    return best


def test_smallest_circle():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 5, 9, 12):
        for _ in range(10):
            p = rng.integers(0, 9, (n, 2)).astype(float)
            y, x, r = orient.smallest_circle(orient.hull(p))
            assert (np.hypot(p[:, 0] - y, p[:, 1] - x) <= r + 1e-6).all() and r == pytest.approx(brute_circle(p.tolist()), abs=1e-6)


def test_circle_loss(spark):
    rng = np.random.default_rng(7)
    on = {(k, int(y), int(x)) for k in range(3) for y, x in rng.integers(0, 14, (9 + 20 * k, 2))}
    rows = spark.createDataFrame([(k, y, x, 14, 15) for k, y, x in on], "sample int, y int, x int, height int, width int").repartition(5)
    for r in orient.circle_loss(rows, ["sample"]).collect():
        p = np.array([(y, x) for k, y, x in on if k == r.sample], float)
        cy, cx, radius = orient.smallest_circle(p)
        grid = np.add.outer((np.arange(14) - cy) ** 2, (np.arange(15) - cx) ** 2) <= radius**2 + 1e-9
        both = sum(grid[int(y), int(x)] for y, x in p)
        assert r.loss == pytest.approx(1 - (2 * both + 1e-9) / (len(p) + grid.sum() + 1e-9), abs=1e-9)


def read_back(on, a, b, shape):
    """Every place of the turned grid reads its nearest voxel."""
    ca, sa, cb, sb = np.cos(np.radians(a)), np.sin(np.radians(a)), np.cos(np.radians(b)), np.sin(np.radians(b))
    mid, out = (np.array(shape) - 1) / 2, set()
    for p in itertools.product(*map(range, shape)):
        v, u, w = np.array(p) - mid
        y, z1 = cb * v + sb * w, -sb * v + cb * w
        x, z = ca * u + sa * z1, -sa * u + ca * z1
        if tuple(np.floor(np.array([y, x, z]) + mid + 0.5).astype(int).tolist()) in on:
            out.add(p)
    return out


def test_turned(spark):
    rng = np.random.default_rng(8)
    shape = (9, 8, 7)
    on = {tuple(p) for p in np.argwhere(rng.random(shape) < 0.3).tolist()}
    rows = spark.createDataFrame([(*p, *shape) for p in on], "y int, x int, z int, height int, width int, depth int")
    for a, b in ((0, 0), (90, 0), (17, -32), (5, 5)):
        got = {(r.y, r.x, r.z) for r in orient.turned(rows, F.lit(a), F.lit(b)).collect()}
        assert got == read_back(on, a, b, shape), (a, b)


def test_angles_of_a_turned_cylinder(spark):
    """A cylinder, turned by a few degrees, is turned back to within one."""
    rows, want = [], {0: (3.0, -3.0, (30, 30, 40), 6.3, 16.5)}
    for k, (a, b, shape, radius, half) in want.items():
        ca, sa, cb, sb = np.cos(np.radians(a)), np.sin(np.radians(a)), np.cos(np.radians(b)), np.sin(np.radians(b))
        for p in itertools.product(*map(range, shape)):
            v, u, w = np.array(p) - (np.array(shape) - 1) / 2
            x, z1 = ca * u - sa * w, sa * u + ca * w
            y, z = cb * v - sb * z1, sb * v + cb * z1
            rows.append((k, *p, int(y * y + x * x <= radius**2 and abs(z) <= half)))
    got = {r.sample: (r.a, r.b) for r in orient.find_angles(spark.createDataFrame(rows, "sample int, y int, x int, z int, val int"), steps=20).collect()}
    for k, (a, b, *_) in want.items():
        assert abs(got[k][0] - a) <= 1 and abs(got[k][1] - b) <= 1, got


def test_many_small_images_take_no_passes(spark, monkeypatch):
    """Images within a tile need no pass over all images: same regions as by tiles, with no passes left to take."""
    rng = np.random.default_rng(8)
    some = [np.where(np.arange(9)[None] < 3 + k % 3, 60, 180) + rng.integers(-3, 4, (8, 9)) for k in range(6)]
    some.append(np.where(np.arange(30)[None] < 20, 60, 180) + rng.integers(-3, 4, (24, 30)))  # beyond what is solved as it is
    t = table(spark, some)
    tiled = {(r.image, r.y, r.x): r.cluster for r in spectral._tiled_clusters(t, 2, 16, 16).collect()}
    monkeypatch.setattr(spectral, "eigenvectors", None)
    whole = {(r.image, r.y, r.x): r.cluster for r in spectral.spectral_clusters(t, 2, 16).collect()}
    assert whole == tiled


def plain_loss(on, a, b):
    """Of a grid of booleans: every place of the turned grid reads its nearest voxel; None where nothing is seen."""
    (ca, sa), (cb, sb) = ((np.cos(np.radians(t)), np.sin(np.radians(t))) for t in (a, b))
    mid = (np.array(on.shape) - 1) / 2
    v, u, w = (np.stack(np.indices(on.shape), -1) - mid).reshape(-1, 3).T
    back = np.stack([cb * v + sb * w, ca * u + sa * (cb * w - sb * v), ca * (cb * w - sb * v) - sa * u], 1)
    at = np.floor(back + mid + 0.5).astype(int)
    inside = ((at >= 0) & (at < on.shape)).all(1)
    out = np.zeros(len(at), bool)
    out[inside] = on[tuple(at[inside].T)]
    top = np.where(out.reshape(on.shape), np.arange(on.shape[2]), -1).max(2)
    pixels = np.argwhere((top >= 0) & (top < on.shape[2] - 1)).astype(float)
    if not len(pixels):
        return None
    cy, cx, r = orient.smallest_circle(pixels)
    circle = np.add.outer((np.arange(on.shape[0]) - cy) ** 2, (np.arange(on.shape[1]) - cx) ** 2) <= r * r + 1e-9
    return 1 - (2 * len(pixels) + 1e-9) / (len(pixels) + circle.sum() + 1e-9)


def test_registered_search_goes_all_rounds(spark):
    """All 62 rounds of the reference's own call (alpha 0.5, h 5, 60 steps), by a plain loop over each sample."""
    from zonegrain.operators import volume
    from zonegrain.plans import registry, views

    data, want = "/root/testdata/sf0.001", {}
    cells = volume.scale_means(views.voxels(spark, data), 2).toPandas()
    for sample, own in cells.groupby("sample"):
        on = np.zeros(own[["y", "x", "z"]].to_numpy().max(0) + 1, bool)
        on[tuple(own.loc[own["val"] > 128, ["y", "x", "z"]].to_numpy().T)] = True
        a, b, alpha = 0.0, 0.0, 0.5
        for k in range(62):
            d1, d2, d3, d4 = (1.0 if (d := plain_loss(on, a + p, b + q)) is None else d for p, q in ((5, 0), (-5, 0), (0, 5), (0, -5)))
            a, b = a - alpha * np.sign(round(d1 - d2, 12)), b - alpha * np.sign(round(d3 - d4, 12))
            if k % 60 // 2 == 0:
                alpha /= 2
        want[sample] = (a, b, plain_loss(on, a, b))
    got = {r.sample: (r.a, r.b, r.loss) for r in registry.QUERIES["orientation"](spark, data).collect()}
    assert got.keys() == want.keys()
    for s, w in want.items():
        assert got[s] == pytest.approx(w, abs=1e-4), s


def test_samples_of_which_nothing_is_seen(spark):
    """One without a voxel that is on, one with its voxel in the top layer, one that is seen, one empty table."""
    rows = [(1, 0, 0, 0, 0), (2, 0, 0, 1, 1), (2, 0, 0, 0, 0), (3, 0, 0, 0, 5), (3, 2, 2, 3, 0)]
    t = spark.createDataFrame(rows, "sample int, y int, x int, z int, val int")
    got = {r.sample: (r.a, r.b, r.loss) for r in orient.find_angles(t, steps=2).collect()}
    assert got[1] == got[2] == (0.0, 0.0, None) and set(got) == {1, 2, 3}
    assert orient.find_angles(t.limit(0)).count() == 0
