"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest
from paths import SF

import __spark_entry__ as entry
from stillwater.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def replay(spark):
    return queries.replay(spark, SF)


@pytest.mark.parametrize("f", queries._ALL, ids=lambda f: f.__name__)
def test_equals_sql(replay, db, f):
    got = f(replay)
    want = db.sql(queries.SQL[f.__name__]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    plain = lambda rows: sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=str)
    fixed = want[names].astype(object).where(want[names].notna(), None)
    assert plain(map(tuple, got.select(*names).collect())) == plain(fixed.itertuples(index=False, name=None))


def test_contract(spark):
    assert entry.entry(spark).count() == 62
    assert set(entry.oracle_sql()) <= set(entry.queries())
