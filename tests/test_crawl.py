"""Crawls of small sites, page by page."""

import pytest

from reachmap.operators import options
from reachmap.plans import results
from reachmap.plans.crawl import crawl
from reachmap.sources import tables

PAGES = [
    # Two contact pages and a loop.
    ("http://one.com/", None, 'Root@Example.com\n8 (800) 555-35-35 <a href="/contact">c</a><a href="/loop?x=1">l</a>'),
    ("http://one.com/contact", None, '<a href="mailto:sales@example.com?subject=Hello">m</a><a href="tel:+1 (415) 555-2671">c</a>'),
    ("http://one.com/loop", None, '<a href="/loop?x=2">loop</a>'),
    # A link to another host.
    ("http://two.com/", None, 'a@example.com <a href="http://evil.com/">e</a><a href="mailto:x@y">m</a><a href="javascript:x">j</a>'),
    ("http://evil.com/", None, "evil@example.com"),
    # Focus decides which of two pages the budget admits.
    ("http://focus.com/", None, '<a href="/docs">docs</a><a href="/contact">contact</a>'),
    ("http://focus.com/docs", None, "docs"),
    ("http://focus.com/contact", None, "contact@example.com"),
    # The seed is redirected to another host, which becomes the site.
    ("http://old.com/", "http://www.new.ru/start/", '<a href="page">p</a><a href="http://old.com/x">x</a> 8 (800) 555-35-35'),
    ("http://www.new.ru/start/page", None, "in@new.com +1 (415) 555-2671"),
    ("http://old.com/x", None, "out@old.com"),
    # Order of documents, and a page without HTML.
    ("http://order.com/", None, "".join(f'<a href="/p{i}">x</a>' for i in (3, 1, 2, 3, 1))),
    ("http://order.com/p1", None, None),
    ("http://order.com/p2", None, '<a href="/deep">d</a>'),
    ("http://order.com/p3", None, '<a href="/p2">x</a><a href="/also">d</a>'),
    ("http://order.com/deep", None, "d@order.com"),
    # With and without query.
    ("http://query.com/", None, '<a href="?a=1">1</a><a href="/?a=2">2</a>'),
    ("http://query.com/?a=1", None, "one@query.com"),
    ("http://query.com/?a=2", None, "two@query.com"),
    # A page that was redirected to something which is no page.
    ("http://lost.com/", None, '<a href="/gone">g</a>'),
    ("http://lost.com/gone", "ftp://lost.com/", "x@lost.com"),
]
REQUESTS = {
    1: ("http://one.com/", {"max_pages": "10", "max_depth": "3", "phone_regions": "RU,US"}),
    2: ("http://two.com/", {"max_pages": "10", "max_depth": "2"}),
    3: ("http://focus.com/", {"max_pages": "2", "max_depth": "1"}),
    4: ("http://focus.com/", {"max_pages": "2", "max_depth": "1", "focused_crawling": "no"}),
    5: ("not-a-url", {}),
    6: ("HTTP://old.com:80", {"max_depth": "2"}),
    7: ("http://order.com/", {"max_depth": "2", "focused_crawling": "no"}),
    8: ("http://order.com/", {"max_depth": "2", "max_links_per_page": "2", "focused_crawling": "no"}),
    9: ("http://query.com/", {"max_depth": "1", "include_query": "yes"}),
    10: ("http://query.com/?a=1", {"max_depth": "1"}),
    11: ("http://nowhere.com/", {"max_depth": "1"}),
    12: ("http://one.com/", {"phone_regions": "US"}),
    13: ("http://lost.com/", {"max_depth": "1"}),
}


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, url, final or url, html) for i, (url, final, html) in enumerate(PAGES)]
    # Copies of every page, which must change nothing.
    rows += [(100 + i, *row[1:]) for i, row in enumerate(rows)]
    pages = spark.createDataFrame(rows, tables.PAGES_SCHEMA)
    asked = spark.createDataFrame([(i, *r) for i, r in REQUESTS.items()], tables.REQUESTS_SCHEMA)
    return crawl(pages, options.site_options(asked))


@pytest.fixture(scope="module")
def visits(done):
    rows = done.visited.orderBy("site_id", "depth", "fetch_rank").collect()
    return {i: [(r.depth, r.url.split(".com", 1)[-1] if ".com" in r.url else r.url, r.reason) for r in rows if r.site_id == i] for i in REQUESTS}


@pytest.fixture(scope="module")
def found(done):
    return {r.site_id: r for r in results.result_rows(done, diagnostics=True).collect()}


def test_invalid_seed(done, found):
    assert [r.site_id for r in done.rejected.collect()] == [5] and 5 not in found


def test_contacts_across_pages(found, visits):
    assert found[1].url == "http://one.com"
    assert found[1].emails == ["root@example.com", "sales@example.com"]
    assert found[1].phones == ["+14155552671", "+78005553535"]
    assert visits[1] == [(0, "/", "ok"), (1, "/contact", "ok"), (1, "/loop", "ok")]


def test_other_hosts_are_left_alone(found, visits):
    assert found[2].emails == ["a@example.com"] and visits[2] == [(0, "/", "ok")]


def test_focus(found, visits):
    assert found[3].emails == ["contact@example.com"] and found[4].emails == []
    assert visits[3][1] == (1, "/contact", "ok") and visits[4][1] == (1, "/docs", "ok")
    assert found[3].diagnostics.stop_reason == "max_pages"


def test_redirected_seed(found, visits):
    assert found[6].url == "http://www.new.ru"
    assert visits[6] == [(0, "/", "ok"), (1, "http://www.new.ru/start/page", "ok")]
    # The region follows the final host, and keeps foreign numbers out.
    assert found[6].emails == ["in@new.com"] and found[6].phones == ["+78005553535"]


def test_order_and_depth(visits, found):
    assert visits[7] == [(0, "/", "ok"), (1, "/p3", "ok"), (1, "/p1", "ok"), (1, "/p2", "ok"), (2, "/also", "not_in_table"), (2, "/deep", "ok")]
    counters = found[7].diagnostics.counters
    assert (counters.scheduled_pages, counters.fetched_pages, counters.failed_pages, counters.processed_pages) == (6, 5, 1, 4)
    assert (counters.skipped_soup_parse, counters.links_examined, counters.links_enqueued, counters.max_depth_reached) == (1, 5 + 2 + 1, 5, 2)
    assert found[7].diagnostics.failure_reasons == {"not_in_table": 1}
    assert found[7].diagnostics.stop_reason == "completed"


def test_links_per_page(visits, found):
    assert visits[8] == [(0, "/", "ok"), (1, "/p3", "ok"), (1, "/p1", "ok"), (2, "/p2", "ok"), (2, "/also", "not_in_table")]
    assert found[8].diagnostics.counters.links_examined == 2 + 2


def test_queries(visits, found):
    assert visits[9] == [(0, "/", "ok"), (1, "/?a=1", "ok"), (1, "/?a=2", "ok")]
    assert found[9].emails == ["one@query.com", "two@query.com"]
    assert visits[10] == [(0, "/", "ok")] and found[10].diagnostics.counters.links_examined == 2


def test_missing_seed(found, visits):
    assert visits[11] == [(0, "/", "not_in_table")]
    assert (found[11].emails, found[11].phones, found[11].diagnostics.counters.failed_pages) == ([], [], 1)


def test_unusable_final_url(found, visits):
    assert visits[13] == [(0, "/", "ok"), (1, "/gone", "url_normalize")]
    assert found[13].emails == [] and found[13].diagnostics.failure_reasons == {"url_normalize": 1}


def test_default_depth_reads_one_page(found, visits):
    assert visits[12] == [(0, "/", "ok")]
    # Seen from the US, the part in front of the 8 is a toll-free number.
    assert (found[12].emails, found[12].phones) == (["root@example.com"], ["+18005553535"])


def test_contact_counts(found):
    assert (found[1].diagnostics.contacts_found.emails, found[1].diagnostics.contacts_found.phones) == (2, 2)


def test_result_files(spark, done, tmp_path):
    rows = results.result_rows(done)
    tables.write_results(rows, str(tmp_path / "json"))
    back = {r.url: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert back["http://www.new.ru"].phones == ["+78005553535"]
    line = tables.result_json(rows.where("site_id = 2")).first().value
    assert back["http://www.new.ru"].site_id is not None and (back["http://www.new.ru"].part, back["http://www.new.ru"].parts) == (0, 1)
    assert line == '{"site_id":2,"url":"http://two.com","part":0,"parts":1,"emails":["a@example.com"],"phones":[]}'
