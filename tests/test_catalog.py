"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from recollect.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return connection


def shown(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if hasattr(x, "tolist") and not hasattr(x, "isoformat"):
        x = x.tolist()
    if isinstance(x, list):
        return str([shown(y) for y in x])
    return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(shown(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = sql.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
