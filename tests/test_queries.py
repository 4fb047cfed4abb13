"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from lectern import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if x is None or pd.isna(x):
            return None
        return float(x) if isinstance(x, (int, float, np.integer, np.floating)) else str(x)

    return sorted(repr([cell(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
