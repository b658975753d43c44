"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain_rows(df):
    """Rows as text of plain Python values, columns by name."""
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, (str, bool)) or hasattr(v, "year"):
            return v
        return v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(map(plain, r))) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name not in SQL:
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got) == plain_rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "cnt"] and df.count() == 10


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
