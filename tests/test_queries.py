"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from lacuna import queries as named

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v.item() if hasattr(v, "item") else v

    return list(df.columns), sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(named.oracle_sql()))
def test_equals_sql(spark, duck, name):
    names, got = rows_of(named.queries()[name](spark, DATA).toPandas())
    columns, wanted = rows_of(duck.sql(named.oracle_sql()[name]).df())
    assert names == columns
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


def test_every_sql_has_a_query():
    assert set(named.oracle_sql()) <= set(named.queries())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["tenth", "nodes"] and df.agg({"nodes": "sum"}).first()[0] == 512
