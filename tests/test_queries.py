import os

import duckdb
import pytest

import __spark_entry__
from strandloom.plans import problems, queries

CORE = {**problems.queries(), **queries.queries()}
SQL = {**problems.oracle_sql(), **queries.oracle_sql()}


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else repr(v) if isinstance(v, float) else str(v) for v in r)
                  for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, tables, name):
    found = CORE[name](spark, data).toPandas()
    if name not in SQL:
        assert len(found.columns)
        return
    wanted = tables.sql(SQL[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
