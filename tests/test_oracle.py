"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from changeflow.plans.oracle_sql import ORACLE
from changeflow.plans.registry import QUERIES
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, key, norm

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(ORACLE)
    assert not missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(norm(x) for x in r) for r in df.collect()]
    assert rows
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in df.columns]
    orows = [tuple(norm(r[i]) for i in idx) for r in res.fetchall()]
    assert sorted(rows, key=key) == sorted(orows, key=key)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns
