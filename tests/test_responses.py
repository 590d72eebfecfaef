from pyspark.sql import functions as F

from reachmap.operators import options
from reachmap.operators import responses as R
from reachmap.sources.tables import RESPONSES_SCHEMA

COLUMNS = "url string, final_url string, status int, content_type string, body binary, error string"
HTML = "text/html; charset=utf-8"


def classify(spark, rows):
    return [r.reason for r in R.classify_responses(spark.createDataFrame(rows, COLUMNS).coalesce(1)).collect()]


def test_reasons(spark):
    ok = "http://a.com/"
    rows = [
        (ok, ok, 200, HTML, b"x", None),
        (ok, ok, 404, "application/pdf", b"x", None),
        (ok, ok, 200, "application/pdf", b"x", None),
        (ok, ok, 302, "", b"x", None),
        (ok, ok, 200, None, b"x", None),
        (ok, ok, 200, "APPLICATION/XHTML+XML", b"x", None),
        (ok, "ftp://a.com/", 200, HTML, b"x", None),
        (ok, None, None, None, None, "timeout"),
        (ok, ok, 200, "text/html; charset=x-none", b"x", None),
        (ok, "ftp://a.com/", 200, "text/html; charset=x-none", b"x", None),
    ]
    assert classify(spark, rows) == [
        "ok", "http_status", "content_type", "ok", "ok", "ok", "url_normalize", "request_error", "future_exception", "future_exception",
    ]


def test_decoding(spark):
    u = "http://a.com/"
    text = "Привет, мир"
    cases = [
        ("text/html; charset=utf-8", "é€".encode() + b"\xff", "é€�"),
        ("text/html", "é".encode("latin-1"), "é"),
        ("application/xhtml+xml", "é".encode(), "é"),
        ("text/html; charset=windows-1251", text.encode("cp1251"), text),
        ('text/html; Charset="KOI8-R"', text.encode("koi8_r"), text),
        ("text/html;charset=ISO-8859-5", text.encode("iso8859_5"), text),
        ("text/html; charset=gb2312", "汉字".encode("gb2312"), "汉字"),
        ("text/html; charset=Shift_JIS", "日本".encode("shift_jis"), "日本"),
        ("text/html; charset=ascii", b"a\xe9", "a�"),
        ("text/html; charset=utf-16", "ab".encode("utf-16"), "ab"),
    ]
    rows = [(i, u, u, 200, kind, body, None) for i, (kind, body, _) in enumerate(cases)]
    table = spark.createDataFrame(rows, "page_id int, " + COLUMNS)
    found = R.pages_of_responses(table).orderBy("page_id").collect()
    assert [r.html for r in found] == [c[2] for c in cases]


def test_truncation_cuts_bytes(spark):
    u = "http://a.com/"
    table = spark.createDataFrame([(1, u, u, 200, HTML, "aé€".encode(), None)], "page_id int, " + COLUMNS)
    cut = lambda n: R.pages_of_responses(table, n).first().html
    assert [cut(1), cut(2), cut(3), cut(6)] == ["a", "a�", "aé", "aé€"]


def test_body_is_not_read_for_classification(spark, tmp_path):
    u = "http://a.com/"
    spark.createDataFrame([(1, u, u, 200, HTML, b"x", None)], "page_id int, " + COLUMNS).write.parquet(str(tmp_path / "r"))
    plan = R.classify_responses(spark.read.parquet(str(tmp_path / "r"))).groupBy("reason").agg(F.count("*"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in text and "body" not in text.split("ReadSchema")[1]


def test_only_wide_charsets_meet_python(spark):
    """Two branches: the plan has one Python stage, and it sits above the filter for wide charsets."""
    rows = [
        (1, "http://a.com/", "http://a.com/", 200, "text/html; charset=utf-8", "é 1".encode(), None), (2, "http://a.com/", "http://a.com/", 200, "text/html; charset=GBK", "漢".encode("gbk"), None),
        (3, "http://a.com/", "http://a.com/", 404, "text/html; charset=GBK", "漢".encode("gbk"), None), (4, "http://a.com/", "http://a.com/", 200, None, b"x", None),
    ]
    table = spark.createDataFrame(rows, RESPONSES_SCHEMA)
    pages = R.pages_of_responses(table)
    assert {r.page_id: r.html for r in pages.collect()} == {1: "é 1", 2: "漢", 3: None, 4: "x"}
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    plain, wide = plan[plan.index("Union") :].split(":- ", 1)[1].split("\n+- ", 1)
    assert "ArrowEvalPython" not in plain and "ArrowEvalPython" in wide
    without = R.pages_of_responses(table, wide=False)
    assert {r.page_id: r.html for r in without.collect()} == {1: "é 1", 2: None, 3: None, 4: "x"}
    assert "ArrowEvalPython" not in without._jdf.queryExecution().optimizedPlan().toString()


def test_budgets_of_hosts(spark):
    body = ("ab" * 2000).encode()
    rows = [(k, f"http://{host}/", f"http://{host}/", 200, "text/html; charset=utf-8", body, None) for k, host in enumerate(("a.com", "www.b.com", "c.com", "nope"))]
    table = spark.createDataFrame([*rows, (9, "no url", None, 200, None, body, None)], RESPONSES_SCHEMA)
    asked = spark.createDataFrame(
        [(1, "http://a.com/x", {"max_body_bytes": "1024"}), (2, "http://b.com", {"max_body_bytes": "1500"}), (3, "http://b.com/y", {"max_body_bytes": "1600"}), (4, "http://c.com", {}), (5, "not-a-url", {"max_body_bytes": "1100"})],
        "site_id long, start_url string, options map<string,string>",
    )
    found = {r.page_id: r.max_body_bytes for r in R.with_body_budgets(table, options.site_options(asked)).collect()}
    assert found == {0: 1024, 1: 1600, 2: 2_000_000, 3: 2_000_000, 9: 2_000_000}
    pages = R.pages_of_responses(R.with_body_budgets(table, options.site_options(asked)), F.col("max_body_bytes"))
    assert {r.page_id: len(r.html) for r in pages.where("html IS NOT NULL").collect()} == {0: 1024, 1: 1600, 2: 4000, 3: 4000}
