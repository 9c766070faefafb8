"""The SQL of the corpus queries against the queries, on the smallest tables."""

import duckdb
import pytest

from recollect.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    want = connection.execute(oracle.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DATA).select(*want.columns).toPandas()
    assert len(got) and rows(got) == rows(want)
