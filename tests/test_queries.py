"""Every registered query against its SQL oracle on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.entries import QUERIES
from catalog.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, DATA)
    columns = sorted(result.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in result.collect())
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(r[i] for i in places)) for r in answer.fetchall())
    assert found == expected and found


def test_whole_crawl_goes_on_to_the_end(spark):
    """Two waves reach at most seven pages of each of the 20 sites."""
    assert QUERIES["crawl_whole"](spark, "/root/testdata/sf0.01").where("reason <> 'not_in_table'").count() > 7 * 20


def test_entry(spark):
    assert entry.entry(spark).columns == ["site_key", "kind", "contact", "n_pages"]
