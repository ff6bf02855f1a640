"""Each query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from textframes import oracle, queries

DATA = "/root/testdata/sf0.001"
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    ours = queries.queries()[name](spark, DATA).toPandas()
    theirs = duck.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) > 0
    assert rows(ours) == rows(theirs)


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(ORACLE)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
