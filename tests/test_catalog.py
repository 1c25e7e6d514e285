"""Every query of the catalog against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from quernstone.plans import catalog


def shaped(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return ""
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str([str(x) for x in v])
        return repr(round(float(v), 9)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(text).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(shaped(got), shaped(want))


def test_flagship_is_a_query():
    assert catalog.FLAGSHIP in catalog.QUERIES


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
