import datetime

import pytest
from pyspark.sql import functions as F

from reachmap.functions import masking
from reachmap.operators import log, options
from reachmap.sources import tables

MAP = "id int, options map<string,string>"


def errors(spark, given):
    return options.validate_options(spark.createDataFrame([(1, given)], MAP)).first().errors


@pytest.mark.parametrize(
    "given, problem",
    [
        ({"unknown_field": "1"}, "unsupported option: unknown_field"),
        ({"max_pages": "0"}, "max_pages must be between 1 and 5000"),
        ({"max_pages": "5001"}, "max_pages must be between 1 and 5000"),
        ({"max_depth": "x"}, "max_depth: not a number: x"),
        ({"max_depth": None}, "max_depth: value is missing"),
        ({"request_timeout": "0.4"}, "request_timeout must be between 0.5 and 120.0"),
        ({"retry_backoff_factor": "nan"}, "retry_backoff_factor must be between 0.0 and 10.0"),
        ({"focused_crawling": "maybe"}, "focused_crawling: invalid boolean value: maybe"),
        ({"log_level": "LOUD"}, "log_level: unknown level: LOUD"),
        ({"user_agent": " "}, "user_agent must have 1 to 512 characters"),
    ],
)
def test_refused(spark, given, problem):
    assert errors(spark, given) == [problem]


def test_accepted_and_typed(spark):
    given = {"max_depth": "0", "max_pages": "15", "focused_crawling": "False", "phone_regions": "RU,BY", "log_level": "debug", "max_seconds": "1.5"}
    assert errors(spark, given) == []
    row = options.site_options(spark.createDataFrame([(1, given), (2, None)], MAP)).orderBy("id").collect()
    assert (row[0].max_depth, row[0].max_pages, row[0].focused_crawling, row[0].phone_regions) == (0, 15, False, ["RU", "BY"])
    assert (row[1].max_pages, row[1].max_depth, row[1].focused_crawling, row[1].include_query) == (200, 0, True, False)
    assert row[1].phone_regions is None and row[1].max_body_bytes == 2_000_000


def test_bool_words(value):
    assert value(options.coerce_bool("x"), ["YES", " on", "0", "Off", "2", None]) == [True, True, False, False, None, None]


def test_later_layer_wins(spark):
    merged = options.merge_options(
        F.create_map(F.lit("max_pages"), F.lit("1"), F.lit("colour"), F.lit("red"), F.lit("max_depth"), F.lit("3")),
        F.create_map(F.lit("max_pages"), F.lit("2")), F.lit(None).cast("map<string,string>"),
    )
    assert spark.range(1).select(merged.alias("m")).first().m == {"max_pages": "2", "max_depth": "3"}


def test_option_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text('{"phone_regions": ["ru", "BY"], "email_domain_allowlist": ["@a.com", ".b.org"]}')
    given = tables.read_option_file(spark, str(path))
    assert given.first().options == {"phone_regions": '["ru","BY"]', "email_domain_allowlist": '["@a.com",".b.org"]'}
    typed = given.select(*options.typed_options("options")).first()
    assert (list(typed.phone_regions), list(typed.email_domain_allowlist)) == (["RU", "BY"], ["a.com", "b.org"])
    path.write_text('{"max_pages": 8,\n "include_query": true}')
    assert tables.read_option_file(spark, str(path)).first().options == {"max_pages": "8", "include_query": "true"}


def test_mask_map(spark):
    data = spark.createDataFrame([({"api_key": "abcdefghijklmnopqrstuvwxyz", "X-Token ": "1234567890", "max_pages": "20", "Cookie": "short", "proxy": None},)], "d map<string,string>")
    masked = data.select(masking.mask_map("d").alias("m")).first().m
    assert masked == {"api_key": "abc***yz", "X-Token ": "123***90", "max_pages": "20", "Cookie": "***", "proxy": "***"}


def test_mask_values(value):
    assert value(masking.mask_value("x"), [None, " ", "123456", " 1234567 "]) == ["***", "***", "***", "123***67"]


def test_mask_nested(spark):
    table = spark.createDataFrame(
        [("top-secret-key", 50, ("u", "password1"), [("tok-1234567",)], {"a": {"secret": "abcdefgh"}})],
        "api_key string, max_pages int, login struct<user:string,password:string>, tokens_list array<struct<name:string>>, deep map<string,map<string,string>>",
    )
    row = masking.mask_columns(table.withColumnRenamed("tokens_list", "names")).first()
    assert (row.api_key, row.max_pages, row.login.user, row.login.password) == ("top***ey", 50, "u", "pas***d1")
    assert row.names[0].name == "tok-1234567" and row.deep["a"]["secret"] == "abc***gh"


def test_mask_maps_of_other_values(spark):
    maps = spark.sql("""SELECT map('cookie', array('abcdefghij'), 'list', array('x')) AS a, map('token', 123456789, 'n', 5) AS b,
        map('password', named_struct('v', 'abcdefgh', 'n', 7), 'p', named_struct('v', 'shown', 'n', 8)) AS c""")
    row = masking.mask_columns(maps).first()
    assert row.a == {"cookie": '["a***"]', "list": '["x"]'} and row.b == {"token": "123***89", "n": "5"}
    assert (row.c["password"].v, row.c["password"].n, row.c["p"].v, row.c["p"].n) == ("abc***gh", None, "shown", 8)


def test_numbers_are_strict(value):
    assert value(options.coerce_double("x"), ["30", "30d", "1f", " 1.5e1 ", ".5", "1_0", "inf"]) == [30.0, None, None, 15.0, 0.5, None, float("inf")]


def test_log(spark):
    rows = [(i, datetime.datetime(2024, 1, 1), "INFO", "x", f"m{i}") for i in range(1, 1501)]
    table = spark.createDataFrame(rows, tables.LOG_SCHEMA)
    ids = lambda t: [r.id for r in t.collect()]
    assert ids(log.tail_after(table, 1490)) == list(range(1491, 1501))
    assert ids(log.tail_after(table, -5, 0)) == [1]
    assert len(ids(log.tail_after(table, 0, 9999))) == 1000
    assert log.next_cursor(log.tail_after(table, 1490), 1490).first().next_after == 1500
    assert log.next_cursor(log.tail_after(table, 2000), 2000).first().next_after == 2000
    assert ids(log.keep_latest(table, 3)) == [1500, 1499, 1498]
