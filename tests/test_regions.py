"""Components, filling, outlines and corner crops by tiles, against plain loops over whole images."""

import os
import sys

import numpy as np
import pyarrow as pa
import pytest


from zonegrain.operators import regions, stencil


def table(spark, arrays, name="val", kind="double"):
    rows = [(k, y, x, float(v) if kind == "double" else int(v)) for k, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"image string, y int, x int, {name} {kind}")


def flood(on, eight):
    """Label of each pixel by flooding: the first pixel's place, -1 where off."""
    out, (h, w) = np.full(on.shape, -1), on.shape
    moves = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (eight or not (dy and dx))]
    for y in range(h):
        for x in range(w):
            if on[y, x] and out[y, x] < 0:
                todo = [(y, x)]
                out[y, x] = y * w + x
                while todo:
                    a, b = todo.pop()
                    for dy, dx in moves:
                        p, q = a + dy, b + dx
                        if 0 <= p < h and 0 <= q < w and on[p, q] and out[p, q] < 0:
                            out[p, q] = y * w + x
                            todo.append((p, q))
    return out


def fill(on):
    off = flood(~on, False)
    rim = set(np.concatenate([off[0], off[-1], off[:, 0], off[:, -1]]).tolist()) - {-1}
    return ~np.isin(off, list(rim)) | on


def outline_area(part):
    """Shoelace area of the traced outer border (Moore neighbours, clockwise)."""
    p = np.pad(part, 1)
    y, x = np.argwhere(p)[0]
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    start, at, came, points = (y, x), (y, x), 0, []
    first_move = None
    for _ in range(8 * p.size):
        points.append(at)
        for k in range(1, 9):
            d = (came + k) % 8
            q = at[0] + ring[d][0], at[1] + ring[d][1]
            if p[q]:
                break
        else:
            return 0.0
        if at == start:
            if first_move is None:
                first_move = d
            elif d == first_move:
                break
        at, came = q, (d + 4) % 8
    a = np.array(points, float)
    return abs((a[:-1, 0] * a[1:, 1] - a[1:, 0] * a[:-1, 1]).sum()) / 2


def images(seed, n, size=23):
    rng = np.random.default_rng(seed)
    return {f"i{k}": rng.random((size, size + k)) < (0.35 + 0.08 * k) for k in range(n)}


@pytest.mark.parametrize("eight", [True, False])
def test_labels_against_flooding(spark, eight):
    some = images(1, 5)
    got = regions.labelled(table(spark, some, "on", "int"), eight, tile=8).collect()
    for k, a in some.items():
        mine = np.full(a.shape, -1, np.int64)
        for r in got:
            if r.image == k:
                mine[r.y, r.x] = r.label
        want = flood(a, eight)
        assert ((mine < 0) == (want < 0)).all()
        pairs = {(int(p), int(q)) for p, q in zip(mine[a], want[a], strict=True)}
        assert len({p for p, _ in pairs}) == len({q for _, q in pairs}) == len(pairs)


def test_filled_and_outlines(spark):
    some = images(2, 4)
    blob = np.zeros((20, 31), bool)
    blob[2:15, 3:25] = True
    blob[5:9, 6:20] = False
    blob[6:8, 9:12] = True
    blob[16, 1:30] = True  # a line has no area
    some["blob"] = blob
    got = regions.filled(table(spark, some, "on", "int"), tile=8).collect()
    for k, a in some.items():
        mine = {(r.y, r.x): r.on for r in got if r.image == k}
        assert all(mine[y, x] == int(v) for (y, x), v in np.ndenumerate(fill(a))), k
    solid = {k: fill(a) for k, a in some.items()}
    labels = regions.labelled(table(spark, solid, "on", "int"), True, tile=8)
    found = regions.outlines(labels, tile=8).collect()
    for k, a in solid.items():
        want = flood(a, True)
        mine = sorted((round(r.area, 6), r.pixels, r.y1, r.y2, r.x1, r.x2) for r in found if r.image == k and r.label >= 0)
        parts = [want == v for v in np.unique(want[want >= 0])]
        box = lambda p: (int(p.sum()), *(int(f(np.nonzero(p)[i])) for i in (0, 1) for f in (np.min, np.max)))
        assert mine == sorted((round(outline_area(p), 6), *box(p)) for p in parts), k


def test_outline_centre(spark):
    """A right-angled triangle and a rectangle, by hand."""
    tri, rect = np.tril(np.ones((10, 10), bool)), np.zeros((9, 12), bool)
    rect[2:7, 3:10] = True
    found = {r.image: r for r in regions.outlines(regions.labelled(table(spark, {"t": tri, "r": rect}, "on", "int"), True, tile=4), tile=4).where("label >= 0").collect()}
    assert found["r"].area == 24 and (found["r"].cy, found["r"].cx) == pytest.approx((4, 6))
    assert found["t"].area == 40.5 and (found["t"].cy, found["t"].cx) == pytest.approx((6, 3))


def plain_crop(a):
    v = a.astype(np.int64) & 255
    wide = np.pad(v, 5, mode="edge")
    mean = np.array([[np.rint(wide[y : y + 11, x : x + 11].sum() / 121) for x in range(v.shape[1])] for y in range(v.shape[0])])

    def largest(on):
        labels = flood(fill(on), True)
        parts = [(outline_area(labels == k), -k, labels == k) for k in np.unique(labels[labels >= 0])]
        return max(parts, key=lambda p: p[:2])[2] if parts else None

    white = np.where(largest(v - mean > -2), 255.0, a)

    def extreme(b, f, beyond):
        p = np.pad(b, 3, constant_values=beyond)
        return np.array([[f(p[y : y + 7, x : x + 7]) for x in range(b.shape[1])] for y in range(b.shape[0])])

    part = largest(extreme(extreme(white, np.max, -np.inf), np.min, np.inf) < 255)
    if part is None:
        return a
    ys, xs = np.nonzero(part)
    (h, w), (H, W) = (ys.max() - ys.min() + 1, xs.max() - xs.min() + 1), a.shape
    rows = slice(h, H) if ys.min() == 0 else slice(0, H - h) if ys.max() == H - 1 else None
    cols = slice(w, W) if xs.min() == 0 else slice(0, W - w) if xs.max() == W - 1 else None
    return a[rows, cols] if rows and cols and 2 * (H - h) * (W - w) > H * W else a


def test_corner_crop(spark):
    """The four corners, none, one in the middle, one at a side, and one too large to cut."""
    rng = np.random.default_rng(3)
    size, tissue = (44, 52), lambda: 150.0 + (np.arange(44)[:, None] + np.arange(52)[None]) % 2
    dots = 100.0 * ((np.arange(44)[:, None] % 6 == 1) & (np.arange(52)[None] % 6 == 1))  # nothing but faint specks
    some = {}
    for name, ys, xs in (("tl", slice(0, 14), slice(0, 15)), ("tr", slice(0, 13), slice(38, 52)), ("bl", slice(30, 44), slice(0, 13)), ("br", slice(32, 44), slice(38, 52)), ("middle", slice(15, 30), slice(20, 35)), ("side", slice(0, 14), slice(20, 34)), ("large", slice(0, 36), slice(0, 40))):
        some[name] = tissue()
        some[name][ys, xs] = dots[ys, xs]
    some["none"] = tissue()
    some["noise"] = rng.integers(0, 256, size).astype(float)
    got = regions.corner_crop(table(spark, some), tile=16).collect()
    for k, a in some.items():
        want = plain_crop(a)
        mine = {(r.y, r.x): r.val for r in got if r.image == k}
        assert len(mine) == want.size and all(mine[y, x] == v for (y, x), v in np.ndenumerate(want)), k
        assert {r.cropped for r in got if r.image == k} == {want.shape != size}
    shapes = {k: plain_crop(a).shape for k, a in some.items()}
    assert all(shapes[k] != size for k in ("tl", "tr", "bl", "br")) and all(shapes[k] == size for k in ("none", "large"))


def test_no_tile_beyond_the_image(spark):
    """Small images with a halo come as one tile each, and answers without rows are handed on."""
    t = spark.createDataFrame([(k, y, x, 1) for k in range(40) for y in range(3) for x in range(3)], "image int, y int, x int, val int")
    keys = lambda t: pa.RecordBatch.from_pydict({c: t.column(c).slice(0, 1).combine_chunks() for c in ("image", "ty", "tx")})
    got = stencil.by_tile(t, 2, keys, "image int, ty long, tx long").collect()
    assert sorted(map(tuple, got)) == [(k, 0, 0) for k in range(40)]
    none = lambda t: keys(t).slice(0, 0)
    assert stencil.by_tile(t, 2, none, "image int, ty long, tx long").count() == 0


def test_scored_tiles_come_in_lots(spark, tmp_path):
    """A model gets a bounded number of tiles at a time, in whatever batches they come; each pixel is the mean over its tiles."""
    import numpy as np

    from zonegrain.operators import segment

    seen = str(tmp_path)

    def model(tiles):
        open(f"{seen}/{len(tiles)}", "w").close()
        return tiles / 2

    rows = [(0, y, x, y * 7 + x) for y in range(200) for x in range(70)]
    images = spark.createDataFrame(rows, "image int, y int, x int, val int").repartition(1)
    lot, segment.SCORED = segment.SCORED, 4 * 4 * 100
    try:
        got = {(r.y, r.x): r.p for r in segment.score_tiles(images, model, 4).collect()}
    finally:
        segment.SCORED = lot
    assert len(got) == len(rows) and all(np.isclose(got[y, x], v / 2) for _, y, x, v in rows)
    assert max(int(p.name) for p in tmp_path.iterdir()) == 100


def test_scored_tiles_are_whole_across_blocks(spark, tmp_path):
    """Each tile is scored once with all of its pixels, in images of several blocks with holes, and means are those of a plain loop."""
    import numpy as np

    from zonegrain.operators import segment

    seen = str(tmp_path)

    def model(tiles):
        open(f"{seen}/{os.urandom(8).hex()}-{len(tiles)}", "w").close()
        return tiles / 255 + tiles.mean((1, 2), keepdims=True)

    rng = np.random.default_rng(7)
    some = {"a": np.where(rng.random((300, 70)) < 0.8, rng.integers(0, 256, (300, 70)), np.nan), "b": rng.integers(0, 256, (5, 3)).astype(float), None: rng.integers(0, 256, (9, 280)).astype(float)}
    rows = [(k, y, x, int(v)) for k, a in some.items() for (y, x), v in np.ndenumerate(a) if not np.isnan(v)]
    images = spark.createDataFrame(rows, "image string, y int, x int, val int")
    tiles = 0
    for size in (16, 7, 1):
        step, got = max(1, size // 2), {(r.image, r.y, r.x): r.p for r in segment.score_tiles(images, model, size).collect()}
        assert len(got) == len(rows)
        for k, a in some.items():
            total, n = np.zeros(a.shape), np.zeros(a.shape)
            for y0, x0 in ((y, x) for y in range(0, a.shape[0], step) for x in range(0, a.shape[1], step)):
                here = a[y0 : y0 + size, x0 : x0 + size]
                total[y0 : y0 + size, x0 : x0 + size] += here / 255 + np.nansum(here) / size**2
                n[y0 : y0 + size, x0 : x0 + size] += 1
                tiles += not np.isnan(here).all()
            assert all(np.isclose(got[k, y, x], total[y, x] / n[y, x], rtol=1e-5) for (y, x), v in np.ndenumerate(a) if not np.isnan(v)), (k, size)
    assert sum(int(f.name.split("-")[1]) for f in tmp_path.iterdir()) == tiles


def test_python_holds_few_scored_tiles(spark, tmp_path):
    """The tables that a worker has at hand when the model runs are of some rows, not of thousands of whole tiles (17 MB here)."""
    from zonegrain.operators import segment

    seen = str(tmp_path)

    def model(tiles):
        frame, most = sys._getframe(), 0
        while frame:
            most = max([most, *(v.nbytes for v in frame.f_locals.values() if isinstance(v, pa.RecordBatch | pa.Table))])
            frame = frame.f_back
        open(f"{seen}/{most}-{os.urandom(8).hex()}", "w").close()
        return tiles

    images = spark.range(8192 * 64).selectExpr("0 as image", "cast(id div 64 as int) as y", "cast(id % 64 as int) as x", "cast(id % 256 as int) as val")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert segment.score_tiles(images, model, 16).where("p = (y * 64 + x) % 256").count() == 8192 * 64
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < max(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) < 8_000_000


def test_small_images_share_a_stack(spark):
    """Many images of two shapes are two stacks, with large keys and small ones in a lot, and labels are those of each image alone."""
    import numpy as np
    import pyarrow as pa

    from zonegrain.operators import stencil

    rng = np.random.default_rng(5)
    grids = {i: rng.random((3, 5) if i % 2 else (6, 4)) < 0.5 for i in range(100)}
    rows = [(i, y, x, int(v)) for i, g in grids.items() for (y, x), v in np.ndenumerate(g)]
    t = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("image", "y", "x", "on"))}).append_column("ty", pa.array([0] * len(rows))).append_column("tx", pa.array([0] * len(rows)))
    assert [g["on"].shape for _, g, *_ in stencil.stacks_of(t, ["on"])] == [(50, 3, 5), (50, 6, 4)]
    images = spark.createDataFrame(rows, "image int, y int, x int, on int")
    got = {(r.image, r.y, r.x): r.label for r in regions.labelled(images).collect()}
    for i, g in grids.items():
        place, w = regions.grid_labels(g, regions.EIGHT), g.shape[1]
        assert all(got[i, y, x] == (p // w * (1 << 31) + p % w if p >= 0 else -1) for (y, x), p in np.ndenumerate(place))

    def counted(t):
        keys = t.column("image").to_pylist()
        return pa.RecordBatch.from_pydict({"keys": pa.array([len(set(keys))], pa.int32()), "rows": pa.array([len(keys)], pa.int32()), "ends": pa.array([f"{keys[0]} {keys[-1]}"])})

    many = spark.range(40_000, numPartitions=2).selectExpr("cast(if(id < 30000, 0, id) as int) as image")
    lots = stencil.by_lots(many, ["image"], counted, "keys int, rows int, ends string", 5_000).collect()
    assert sum(r["keys"] for r in lots) == 10_001 and sum(r["rows"] for r in lots) == 40_000 and len(lots) < 12
