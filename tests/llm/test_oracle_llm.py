"""The queries of this subpackage that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest
from test_oracle import DATA, cells

from lumenfold.llm import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)
