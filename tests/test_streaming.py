"""Streams give what the batch gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalog import entries
from reachmap.operators.contacts import contact_rows, page_contacts
from reachmap.session import new_run_folder
from reachmap.streaming import tables as streams

START = datetime.datetime(2024, 1, 1)


@pytest.fixture()
def stored(spark):
    """Two files of pages; the second repeats a page of the first under another spelling."""
    folder = new_run_folder(spark, "test-pages")
    schema = "page_id bigint, url string, final_url string, html string, crawled_at timestamp"
    first = [
        (1, "http://a.ru/", "http://a.ru/", "a@x.com 8 (800) 555-35-35", START),
        (2, "http://a.ru/2", "http://a.ru/2", "b@x.com a@x.com", START),
    ]
    second = [
        (3, "HTTP://a.ru:80", "http://a.ru/", "a@x.com c@x.com", START + datetime.timedelta(minutes=5)),
        (4, "http://www.b.com/", "http://www.b.com/", "a@x.com", START + datetime.timedelta(minutes=6)),
        (5, "nope", "nope", "z@x.com", START + datetime.timedelta(minutes=6)),
    ]
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_pages_once(spark, stored):
    once = streams.dedupe_pages(streams.stream_pages(spark, stored, files_per_batch=1))
    rows = streams.run_to_table(once, new_run_folder(spark, "test-out")).collect()
    assert sorted((r.site_key, r.url) for r in rows) == [("a.ru", "http://a.ru/"), ("a.ru", "http://a.ru/2"), ("b.com", "http://www.b.com/")]


def test_contacts_of_pages_once(spark, stored):
    found = streams.contacts_once(streams.stream_pages(spark, stored, files_per_batch=1))
    rows = streams.run_to_table(found, new_run_folder(spark, "test-out"), trigger={"availableNow": True}).collect()
    urls = [r.url for r in rows if r.contact == "a@x.com"]
    assert sorted(urls) == ["http://a.ru/", "http://a.ru/2", "http://www.b.com/"]
    assert "html" not in streams.dedupe_pages(streams.stream_pages(spark, stored)).columns


def test_contacts_equal_batch(spark, stored):
    found = streams.contacts_stream(streams.stream_pages(spark, stored, files_per_batch=1))
    rows = streams.run_to_table(found, new_run_folder(spark, "test-out"))
    batch = contact_rows(page_contacts(streams.with_site_key(spark.read.parquet(stored))))
    key = lambda t: sorted(map(tuple, t.select("site_key", "page_id", "kind", "contact").collect()))
    assert key(rows) == key(batch) and ("a.ru", 1, "phone", "+78005553535") in key(rows)


def test_site_contacts_over_batches(spark, stored):
    found = streams.contacts_stream(streams.stream_pages(spark, stored, files_per_batch=1))
    state = streams.run_site_contacts(found, new_run_folder(spark, "test-state"))
    rows = sorted((r.site_key, r.kind, r.contact) for r in state.collect())
    assert rows == [
        ("a.ru", "email", "a@x.com"), ("a.ru", "email", "b@x.com"), ("a.ru", "email", "c@x.com"), ("a.ru", "phone", "+78005553535"),
        ("b.com", "email", "a@x.com"),
    ]
    assert state.select("batch").distinct().count() == 2


def test_known_contacts_are_state(spark, stored, capsys):
    """A batch reads its own pages only; what was stored before is looked up in the state."""
    found = streams.contacts_stream(streams.stream_pages(spark, stored, files_per_batch=1))
    folder = new_run_folder(spark, "test-state")
    query = streams.start_site_contacts(found, folder)
    query.awaitTermination()
    progress = query.recentProgress
    assert [sum(s["numInputRows"] for s in p["sources"]) for p in progress if p["sources"][0]["numInputRows"]] == [2, 3]
    assert progress[-1]["stateOperators"][0]["operatorName"] == "dedupe"
    assert any("rocksdb" in name.lower() for name in progress[-1]["stateOperators"][0]["customMetrics"])
    query.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == 1 and "StreamingDeduplicate" in plan
    # A run that goes on from its checkpoint keeps the state: pages sent again bring nothing.
    spark.read.parquet(stored).coalesce(1).write.mode("append").parquet(stored)
    again = streams.run_site_contacts(found, folder)
    assert again.count() == 5 and again.where("batch > 1").count() == 0


def test_contact_counts(spark, stored):
    counted = streams.contact_counts(streams.contacts_stream(streams.stream_pages(spark, stored, files_per_batch=1)))
    rows = streams.run_counts(counted, ["site_key", "kind", "contact"], new_run_folder(spark, "test-out")).collect()
    found = {(r.site_key, r.contact): (r.n_pages, r.first_seen.minute, r.last_seen.minute) for r in rows}
    assert found["a.ru", "a@x.com"] == (3, 0, 5) and found["b.com", "a@x.com"] == (1, 6, 6) and len(rows) == 5


def test_late_rows_are_kept_aside(spark):
    folder = new_run_folder(spark, "test-late")
    schema = "page_id bigint, url string, final_url string, html string, crawled_at timestamp"
    minutes = [[0, 10], [100, 5], [-30, 60, 99], [95, None, 35, 34]]
    for number, batch in enumerate(minutes):
        rows = [(100 * number + k, "http://a.com/", None, None, None if m is None else START + datetime.timedelta(minutes=m)) for k, m in enumerate(batch)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    out = new_run_folder(spark, "test-out")
    split = streams.run_split_late(streams.stream_pages(spark, folder, files_per_batch=1), out, "65 minutes")
    assert sorted(r.page_id for r in split.late.collect()) == [200, 303]  # the newest time before them is minute 100
    assert sorted(r.page_id for r in split.kept.collect()) == [0, 1, 100, 101, 201, 202, 300, 301, 302]
    assert {r.batch for r in split.late.collect()} == {2, 3}


def test_failure_counts(spark):
    folder = new_run_folder(spark, "test-responses")
    rows = [
        (i, "http://a.com/", "http://a.com/", status, "text/html", b"x", None, START + datetime.timedelta(minutes=minute))
        for i, (status, minute) in enumerate([(404, 1), (500, 59), (200, 5), (404, 61)])
    ]
    schema = "page_id bigint, url string, final_url string, status int, content_type string, body binary, error string, crawled_at timestamp"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    counted = streams.failure_counts(streams.stream_responses(spark, folder, files_per_batch=1))
    found = streams.run_counts(counted, ["window_start", "reason"], new_run_folder(spark, "test-out"))
    rows = found.select(F.date_format("window_start", "HH:mm"), "reason", "n_pages").collect()
    assert sorted(map(tuple, rows)) == [("00:00", "http_status", 2), ("01:00", "http_status", 1)]


def test_arrivals_in_any_number_of_files(spark):
    """A slot of rows may be many files, written by many tasks, and is one micro-batch all the same."""
    rows = spark.range(0, 600, 1, 6).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"))
    folder = new_run_folder(spark, "test-data")
    rows.write.parquet(f"{folder}/pages.parquet")
    seen = []
    with_setting = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for path in entries._arriving(spark, folder, rows):
            seen.append((len(spark.read.parquet(path).inputFiles()), spark.read.parquet(path).count()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_setting)
    assert [n for _, n in seen] == [50 * (k + 1) for k in range(12)]
    assert seen[-1][0] > 12
