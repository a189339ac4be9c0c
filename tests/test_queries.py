"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import pytest

from zonegrain.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*"):
        c.execute(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: "null" if v is None else f"{float(v) + 0.0:.5f}" if isinstance(v, (int, float)) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE:
        assert rows
        return
    want = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(want.fetchall(), names)
