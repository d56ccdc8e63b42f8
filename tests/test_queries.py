"""Every query of the engine's own operators against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from cuelake import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    want = want[list(got.columns)]
    keys = [c for c in got.columns if got[c].dtype != float] or list(got.columns)
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry_and_contract():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
