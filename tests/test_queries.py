"""The registered queries against their DuckDB texts on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import canonical

QUERIES, TEXTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("conversations", "documents", "embeddings", "events", "labels"):
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def test_texts_belong_to_queries():
    assert set(TEXTS) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["author", "num_posts", "first_date", "last_date"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name not in TEXTS:
        assert len(found.columns) > 0
        return
    expected = duck.execute(TEXTS[name]).fetchdf()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found) == canonical(expected)
