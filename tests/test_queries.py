"""Every registered query against its SQL on the smallest test tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(df):
    def value(v):
        return None if pd.isna(v) else float(v) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(value(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def test_names_match():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    if name not in entry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
