"""Registered corpus queries against their SQL on the smallest data set, and their schemas."""

import duckdb
import pytest

import __spark_entry__ as entry
from reachmap.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "page_id url text n_chars",
    "op5": "doc_id n_shingles component_id kept",
    "op6": "doc_id start n_tokens ids_crc32",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8": "doc_id held_out score predicted",
    "op9": "doc_id size text_crc32 law shard slot grown_shard",
    "op10": "doc_id keep_id group_size kept text_sha256",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id n_bytes n_tokens over_limit",
}


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = QUERIES[name](spark, DATA)
    columns = sorted(result.columns)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    places = [names.index(c) for c in columns]
    assert names != [] and sorted(names) == columns
    assert sorted(tuple(r[c] for c in columns) for r in result.collect()) == sorted(tuple(r[i] for i in places) for r in answer.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    wanted = COLUMNS.get(name.split("_")[0])
    if wanted:
        result = QUERIES[name](spark, DATA)
        assert result.columns[: len(wanted.split())] == wanted.split()
        assert result.count() == spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op3') else 'documents'}.parquet").count()
