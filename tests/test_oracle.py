"""Every query with a SQL counterpart gives DuckDB's rows on the smallest tables."""

import glob
import os

import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df):
    import pandas as pd

    def cell(v):
        if isinstance(v, float):
            return "null" if v != v else f"{v:.6g}"
        return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(cell(v if not isinstance(v, int) or isinstance(v, bool) else float(v)) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)
