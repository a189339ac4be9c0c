"""SQL of the training-data queries, run in DuckDB."""

import pytest

from tests.test_queries import duck, plain  # noqa: F401
from zonegrain.llm.queries import ORACLE_SQL, QUERIES


def test_only_sql():
    assert ORACLE_SQL and all(isinstance(v, str) for v in ORACLE_SQL.values())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, data, name):  # noqa: F811
    df = QUERIES[name](spark, data)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)
