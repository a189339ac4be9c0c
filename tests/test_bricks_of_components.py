"""Components of volumes by bricks against flooding, with few unions whatever the length of a path."""

import numpy as np
import pytest

from zonegrain.operators import segment


def flood(on, moves):
    """The least voxel number of each voxel's component."""
    number = lambda p: p[2] * (1 << 40) + p[0] * (1 << 20) + p[1]
    left, out = set(map(tuple, np.argwhere(on).tolist())), {}
    while left:
        new = [left.pop()]
        for p in new:
            near = {tuple(np.add(p, m).tolist()) for m in moves} & left
            left -= near
            new.extend(near)
        out |= dict.fromkeys(new, min(map(number, new)))
    return out


@pytest.mark.parametrize("moves", [segment.FACES, segment.EIGHT])
def test_components_by_bricks(spark, moves, monkeypatch):
    rng = np.random.default_rng(3)
    some = {1: rng.random((9, 7, 11)) < 0.35, 2: rng.random((5, 10, 6)) < 0.6}
    t = spark.createDataFrame([(k, *p) for k, a in some.items() for p in np.argwhere(a).tolist()], "sample int, y int, x int, z int")
    asked = []
    monkeypatch.setattr(segment.regions, "unions", lambda edges, f=segment.regions.unions: asked.append(edges.count()) or f(edges))
    for side in (4, 64):
        got = {(r.sample, r.y, r.x, r.z): r.label for r in segment.components(t, moves, side).collect()}
        assert got == {(k, *p): label for k, a in some.items() for p, label in flood(a, moves).items()}
    assert asked[0] > 0 and asked[1] == 0  # a volume within a brick needs no round
