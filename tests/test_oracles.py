"""Every query that has SQL gives the rows that the SQL gives, over the whole small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

from conftest import SMALL


def _plain(v):
    if pd.isna(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return str(v) if not isinstance(v, (int, bool)) else int(v)


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted((tuple(map(_plain, r)) for r in pdf.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
