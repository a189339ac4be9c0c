"""Queries over every layer and every group, on small tables made for it."""

import numpy as np
import pandas as pd
import pytest

from zonegrain.operators import learn
from zonegrain.plans import registry


@pytest.fixture
def volumes(tmp_path):
    """Writes embeddings.parquet of volumes by sample, each layers by 8 by 8 with values of voxels."""

    def write(samples):
        rows = [(label, ((layer.reshape(64) - 128 + 0.5) / 256).astype(np.float32)) for label, a in samples.items() for layer in a]
        t = pd.DataFrame({"vec_id": np.arange(len(rows)), "embedding": [r[1] for r in rows], "label": np.array([r[0] for r in rows], np.int32)})
        t.to_parquet(f"{tmp_path}/embeddings.parquet")
        return str(tmp_path)

    return write


def pieces(on):
    """Number of components of a boolean array, over faces."""
    left, n = set(map(tuple, np.argwhere(on))), 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            z, y, x = todo.pop()
            for p in ((z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
    return n


def test_components_of_all_layers(spark, volumes):
    joined = np.full((20, 8, 8), 100)
    joined[:16, 0, [0, 7]] = 200
    joined[15, 0, :] = 200  # two columns meet below layer 12
    joined[19, 7, 7] = 200
    noise = np.where(np.random.default_rng(0).random((30, 8, 8)) < 0.12, 200, 100)
    got = {r["sample"]: (r.components, r.voxels) for r in registry.QUERIES["components_whole"](spark, volumes({0: joined, 1: noise})).collect()}
    assert got == {0: (2, 39), 1: (pieces(noise > 175), (noise > 175).sum())}


def test_rotation_of_all_layers(spark, volumes):
    """A quarter turn of sample 30, against numpy."""
    a = np.random.default_rng(1).integers(0, 256, (15, 8, 8))
    got = np.full(a.shape, -1.0)
    for r in registry.QUERIES["rotate_volume_whole"](spark, volumes({30: a})).collect():
        got[r.z, r.y, r.x] = r.val
    turned = [np.rot90(a, k, (1, 2)) for k in (1, 3)]
    assert any(np.allclose(got, t) for t in turned)


def test_forest_of_all_groups(spark, volumes):
    """Every row is scored by trees of other groups: by the class of its features, whatever its own group's labels say."""
    bright = np.arange(17 * 8) % 2 == 1
    group = np.arange(17 * 8) % 17
    y = np.where(group == 16, ~bright, bright)
    layers = np.where(bright, 200, 50)[:, None, None] * np.ones((1, 8, 8))
    d = volumes({0: layers})
    t = pd.read_parquet(f"{d}/embeddings.parquet")
    t["label"] = np.where(y, 2, 0).astype(np.int32)
    t.to_parquet(f"{d}/embeddings.parquet")
    got = registry.QUERIES["forest_logo"](spark, d).toPandas().sort_values("row_id", ignore_index=True)
    assert got["row_id"].tolist() == list(range(17 * 8))
    assert (got["y"] == y).all()
    assert ((got["probability"] > 0.5) == bright).all()
    assert (got["probability"][group == 16] == bright[group == 16]).all()


def test_forest_has_few_tasks(spark):
    """The same forests however the rows are dealt, and no more tasks than cores for few rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    rows = spark.createDataFrame([(i, i % 3, v.tolist(), int(v.sum() > 0)) for i, v in enumerate(x)], "row_id long, group_id int, x array<double>, y int")
    found = [learn.forest_logo(rows.repartition(n), 2, trees=3) for n in (40, 3)]
    assert all(f.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism for f in found)
    a, b = (sorted((r.row_id, r.probability) for r in f.collect()) for f in found)
    assert len(a) == 120 and a == b
