"""Every registered recording query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from tapeloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows(frame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted(repr(tuple(plain(x) for x in row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, small, sql):
    got = __spark_entry__.queries()[name](spark, small).toPandas()
    if name not in registry.ORACLE:
        assert list(got.columns)
        return
    want = sql.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
