"""URL expressions against hand-made cases and against urllib on generated URLs."""

import random
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from reachmap.functions import scoring, urls


def test_normalize(value):
    cases = {
        "HTTP://User:pw@WWW.Example.COM:80": "http://www.example.com/",
        "https://a.com:443/x?y=1#z": "https://a.com/x",
        "https://a.com:80/": "https://a.com:80/",
        "http://a.com:0080/": "http://a.com/",
        "http://a.com:/p": "http://a.com/p",
        "http://a.com/A b/%C3%A9;p?Q#f": "http://a.com/A b/%C3%A9;p",
        "http://a.com?q=1": "http://a.com/",
        " \thttp://a.com/\nx": "http://a.com/x",
        "http://a.com:99999/": None,
        "http://a.com:x/": None,
        "ftp://a.com/": None,
        "not-a-url": None,
        "//a.com/": None,
        "http:///x": None,
        "": None,
        None: None,
    }
    assert value(urls.normalize_url("x"), list(cases)) == list(cases.values())


def test_normalize_keeps_query_on_request(value):
    rows = ["http://a.com/p?b=1&a=/?#f", "http://a.com/p?#f", "http://a.com?x"]
    assert value(urls.normalize_url("x", True), rows) == ["http://a.com/p?b=1&a=/?", "http://a.com/p", "http://a.com/?x"]


def test_ipv6_hosts_are_not_supported(value):
    assert value(urls.normalize_url("x"), ["http://[::1]/"]) == [None]


def test_keys(value):
    assert value(urls.site_key("x"), ["http://WWW.A.com:8080/", "https://blog.a.com/", "http://www.www.a.com", "/x"]) == [
        "a.com", "blog.a.com", "www.a.com", None,
    ]
    assert value(urls.strip_www("x"), [" WWW.a.com ", "m.a.com"]) == ["a.com", "m.a.com"]
    assert value(urls.origin("x"), ["HTTPS://A.com:8443/x", "a.com"]) == ["https://A.com:8443", None]
    assert value(urls.is_same_site("x", F.lit("a.com")), ["https://www.a.com:1/", "http://b.com/", "x"]) == [True, False, False]


def test_phone_region(value):
    rows = ["http://a.co.uk/", "http://a.ru./x", "http://a.com/", "http://a.DE", "nope"]
    assert value(urls.phone_region_of_url("x"), rows) == ["GB", "RU", "ZZ", "DE", "ZZ"]


def test_page_hrefs(value):
    rows = ["/x", " MailTo:a@b.c", "tel:1", "javascript:void(0)", "DATA:x", "  ", "", "http://mailto:80/", "#top"]
    assert value(urls.is_page_href("x"), rows) == [True, False, False, False, False, False, False, True, True]


def _expected(base, href, query=False):
    try:
        parts = urlsplit(urljoin(base, href))
        port = parts.port
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return None
    shown = "" if port in (None, {"http": 80, "https": 443}[parts.scheme]) else f":{port}"
    tail = f"?{parts.query}" if query and parts.query else ""
    return f"{parts.scheme}://{parts.hostname.lower()}{shown}{parts.path or '/'}{tail}"


def test_resolve_against_urllib(value):
    rng = random.Random(7)
    bases = ["http://a.com/", "http://a.com/b/c/d", "https://a.com:8443/b/c/", "http://a.com/b?x=1", "http://a.com//p//q"]
    pieces = ["..", ".", "a", "..;x", ";p", "a;b;c", ".;", "b.html", "", "x y", "%2F", "...", "é"]
    hrefs = ["", "#f", "?q=2", "?", "//h.org/p", "///p", "http:c", "HTTP://H.org:80", "https:c", "http://", "ftp://x/", "/", "a:b", "1:2", "//", "?x#y", "/a//b/../c", "/../../x", "../../../g", "a//b", "./", "..", "."]
    for _ in range(600):
        path = "/".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        hrefs.append(rng.choice(["", "/", "/"]) + path + rng.choice(["", "", "?k=v", "#frag"]))
    rows = [(b, h) for b in bases for h in hrefs if h == h.strip()]
    for query in (False, True):
        found = value(urls.resolve_href("b", "h", query), rows, "b string, h string")
        wrong = [(r, e, g) for r, g in zip(rows, found) if (e := _expected(*r, query)) != g]
        assert not wrong, wrong[:5]


def test_scores(value):
    cases = {
        "http://a.com/": -5,
        "http://a.com/index.HTML": -5 + 1,
        "http://a.com/contact": -50 + 1,
        "http://a.com/Contact/contact-us.php": -50 + 2,
        "http://a.com/docs/rfc/spec.pdf": 40 + 40 + 30 + 3 + 250,
        "http://a.com/a.tar.gz": 300 + 300 * 0 + 1,
        "http://a.com/.gz": 1,
        "http://a.com/dir.zip/x": 2,
        "http://a.com/x?help=1": -25 + 10 + 1,
        "http://a.com/a/b/c/d/e/f/g/h/i/j/k/l": 10,
        "http://a.com//about//": -20 + 1,
        "http://a.com/about_us": -20 + 1,
        "http://a.com/aboutus": 1,
    }
    assert value(scoring.url_priority_score("x"), list(cases)) == list(cases.values())
