"""Every registered query of the domain against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted((tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df.itertuples(index=False)))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.sql(ORACLES[name]).df()
    assert isinstance(got, pd.DataFrame) and sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
