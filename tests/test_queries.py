"""Every query with SQL gives DuckDB's rows."""

import math

import duckdb
import pandas as pd
import pytest

from reelgraph import catalogue
from reelgraph.plans.fixture_views import TABLES

from .conftest import DATA

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def shown(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    return repr(round(float(x), 6)) if isinstance(x, float) else str(x)


def rows(df):
    return sorted(tuple(map(shown, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    mine, theirs = catalogue.queries()[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
