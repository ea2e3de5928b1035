"""Every registered library query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

from tidemark.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    cur = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    want = sorted(repr(tuple(map(plain, r))) for r in cur.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
