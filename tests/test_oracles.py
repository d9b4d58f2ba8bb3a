"""Queries of the engine against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loamgrid.plans import catalog


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    for k in df.columns:
        kind = str(df[k].dtype)
        if kind in ("object", "str", "string"):
            df[k] = df[k].map(lambda v: None if v is None or v != v else str(v))
        elif kind.startswith("datetime"):
            df[k] = df[k].astype(str)
        else:
            df[k] = df[k].astype(float)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, db, name):
    a, b = rows(catalog.QUERIES[name](spark, sf).toPandas()), rows(db.sql(catalog.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for k in a.columns:
        if a[k].dtype == float and b[k].dtype == float:
            assert np.allclose(a[k], b[k], rtol=0, atol=1e-12, equal_nan=True), k
        else:
            assert (a[k].fillna("~") == b[k].fillna("~")).all(), k


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
