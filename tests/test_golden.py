"""Golden tables of small generated images, and properties that hold for any input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonegrain.functions import columns as C
from zonegrain.operators import learn, segment, stencil, study, volume


def quarters(h, w):
    return [(y, x, (1 if y < h // 2 else 2) if x < w // 2 else (3 if y < h // 2 else 4)) for y in range(h) for x in range(w)]


def image(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, x, v in rows], "image int, y int, x int, val int")


def vol(spark, rows):
    return spark.createDataFrame([("a", *r) for r in rows], "sample string, y int, x int, z int, val int")


def test_vector_to_volume(spark):
    vector = spark.createDataFrame([("a", i, (i // 3) + i % 3) for i in range(27)], "sample string, pos int, val int")
    got = {(r.z, r.y, r.x): r.val for r in volume.vector_to_volume(vector, 3, 3).collect()}
    assert [[got[0, y, x] for x in range(3)] for y in range(3)] == [[0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert all(got[z, y, x] == 3 * z + y + x for z, y, x in got)
    back = volume.volume_to_vector(volume.vector_to_volume(vector, 3, 3), 3, 3)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vector.collect()))


def test_wrong_axis(spark):
    with pytest.raises(ValueError, match="Invalid axis given. Give axis as an integer between 0 and 2."):
        volume.slice_axis(vol(spark, [(0, 0, 0, 1)]), 0, 4)
    with pytest.raises(ValueError):
        volume.crop(vol(spark, [(0, 0, 0, 1)]), [1, 2])


@pytest.mark.parametrize("mean,sd,want", [(0, 0, [1, 2, 3, 4]), (2.5, 0, [-1.5, -0.5, 0.5, 1.5]), (2.5, 3, [-0.5, -0.1666667, 0.1666667, 0.5])])
def test_normalise(spark, mean, sd, want):
    t = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "val int")
    assert [r[0] for r in t.orderBy("val").select(C.normalised(F.col("val"), mean, sd)).collect()] == pytest.approx(want, abs=1e-6)


def test_centre_and_surface(spark):
    v = vol(spark, [(y, x, 0, q) for y, x, q in quarters(20, 20)])
    assert tuple(volume.centre(v, 3).select("mass_y", "mass_x").first()) == (14, 14)
    w = vol(spark, [(y, x, z, q if z == 1 else 0) for y, x, q in quarters(20, 20) for z in range(3)])
    part = volume.crop(w, [14, 15, 14, 15, 0, 2])
    assert {r.surface for r in volume.surface(part, 3).collect()} == {1}


def test_subtract_mean(spark):
    f = spark.createDataFrame([(y, x, float(v)) for y, x, v in quarters(4, 4)], "bin int, sample int, val double")
    got = study.standardised(f, "sample", False)
    assert {r.val for r in got.where("bin < 2").collect()} == {-0.5} and {r.val for r in got.where("bin >= 2").collect()} == {0.5}


def test_riu2_class_sizes(spark):
    t = spark.range(256).select(C.uniform_code(F.col("id").cast("int")).alias("c")).groupBy("c").count()
    assert [r[1] for r in sorted(t.collect())] == [1, 8, 8, 8, 8, 8, 8, 8, 1, 198]


def test_rotation_by_nothing_is_identity(spark):
    v = vol(spark, [(y, x, 0, q) for y, x, q in quarters(6, 6)])
    got = volume.rotated(v, F.lit(0.0)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in v.collect()}
    turned = {(r.y, r.x): r.val for r in volume.rotated(v, F.lit(90.0)).collect()}
    a = np.zeros((6, 6))
    for y, x, q in quarters(6, 6):
        a[y, x] = q
    assert any(all(turned[y, x] == pytest.approx(b[y, x]) for y in range(6) for x in range(6)) for b in (np.rot90(a), np.rot90(a, 3)))


def test_crop_commutes_with_projection(spark):
    v = vol(spark, [(y, x, z, (y * 7 + x * 3 + z) % 11) for y in range(6) for x in range(6) for z in range(4)])
    one = volume.projection(volume.crop(v, [1, 4, 2, 5, 0, 3], False), 5)
    two = volume.projection(v, 5).where("y between 1 and 4 and x between 2 and 5")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_histogram_total_and_partitions(spark):
    rows = [(y, x, (y * 31 + x * 17 + y * x) % 251) for y in range(14) for x in range(13)]
    one = image(spark, rows).coalesce(1)
    many = image(spark, rows).repartition(16)
    a, b = (sorted(map(tuple, stencil.mrelbp(i).collect())) for i in (one, many))
    assert a == b and len(a) == 32
    d = 3
    assert sum(r[2] for r in a) == 4 * (14 - 2 * d) * (13 - 2 * d)


def test_median_against_numpy(spark):
    rows = [(y, x, (y * 31 + x * 17) % 97) for y in range(7) for x in range(6)]
    a = np.zeros((9, 8), int)
    for y, x, v in rows:
        a[y + 1, x + 1] = v
    got = {(r.y, r.x): r.val for r in stencil.median_filter(image(spark, rows), 3).collect()}
    assert got == {(y, x): int(np.median(a[y : y + 3, x : x + 3])) for y, x, _ in rows}


def test_ridge_by_subtraction_equals_refit(spark):
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=(60, 3)), np.arange(60) % 5
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=60) * 0.1
    rows = spark.createDataFrame([(int(a), b.tolist(), float(c)) for a, b, c in zip(g, x, y, strict=True)], "group_id int, x array<double>, y double")
    for normalise in (True, False):
        for r in study.fold_models(rows, 3, 0.7, normalise).collect():
            m = g != r.group_id
            c, t = x[m] - x[m].mean(0), y[m] - y[m].mean()
            norm = (c**2).sum(0) if normalise else np.ones(3)
            w = np.linalg.solve(c.T @ c + 0.7 * np.diag(norm), c.T @ t)
            assert r.w == pytest.approx([*w, y[m].mean() - x[m].mean(0) @ w])


def test_logistic_optimum(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(80, 2)), np.arange(80) % 4
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(a), b.tolist(), int(c)) for i, (a, b, c) in enumerate(zip(g, x, y, strict=True))], "row_id int, group_id int, x array<double>, y int")
    got = {r.row_id: r.probability for r in learn.logistic_logo(rows, 2).collect()}
    for k in range(4):
        m, w = g != k, np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[m] @ w))
            w += np.linalg.solve((x[m] * (p * (1 - p))[:, None]).T @ x[m] + np.eye(2), x[m].T @ (y[m] - p) - w)
        for i in np.flatnonzero(~m):
            assert got[i] == pytest.approx(1 / (1 + math.exp(-x[i] @ w)), abs=1e-6)


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4)) * [3, 2, 1, 0.5]
    f = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(4)], "sample int, bin int, val double")
    model = learn.pca(f, 2)
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False) / math.sqrt(29)
    assert model["sv"] == pytest.approx(s[:2].tolist())
    got = np.array([r.scores for r in learn.project(study.rows_of(f), model).orderBy("sample").collect()])
    assert np.cov(got.T) == pytest.approx(np.eye(2), abs=1e-9)
    assert len(learn.pca(f, 0.99)["sv"]) >= 2


def test_largest_component(spark):
    v = vol(spark, [(0, 0, 0, 1), (0, 1, 0, 1), (0, 2, 0, 1), (3, 3, 0, 1), (3, 3, 1, 1), (5, 5, 5, 1)])
    assert {tuple(r)[1:] for r in segment.largest_component(v).collect()} == {(0, 0, 0), (0, 1, 0), (0, 2, 0)}
    snake = vol(spark, [(0, x, 0, 1) for x in range(40)])
    assert segment.components(snake).select("label").distinct().count() == 1


def test_metrics_ties(spark):
    t = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1), (1, 0.1)], "y int, s double")
    assert study.auc(t, "y", "s").first()[0] == pytest.approx((0.5 + 1 + 0 + 1 + 0.5 + 0.0) / 6 + (0.0), abs=0.2)
    p = study.roc_points(t, "y", "s").orderBy(F.desc("threshold")).collect()
    assert [(r.tp, r.fp) for r in p] == [(1, 1), (2, 1), (3, 2)]
