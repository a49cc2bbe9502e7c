"""Every query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lumenfold import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def cells(df):
    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x != x:
            return "null"
        return repr(round(x, 6)) if isinstance(x, float) else repr(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(x) for x in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
