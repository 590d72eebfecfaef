"""HTML projections against a plain tokenizer of pages, real and generated; time on markup left open."""

import random
import time
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from reachmap.functions import html

DATA = "/root/testdata/sf0.01/pages.parquet"
NAMES = {n.rstrip(";"): c for n, c in html5.items()}


class Reader(HTMLParser):
    """Text and links in the order of the markup."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.links, self.hidden = [""], [], []

    def cut(self):
        self.nodes.append("")

    def add(self, text):
        if not self.hidden and self.cdata_elem is None:
            self.nodes[-1] += text

    def handle_starttag(self, tag, attrs):
        self.cut()
        if tag in ("template", "rt", "rp"):
            self.hidden.append(tag)
        href = (dict(attrs).get("href") or "").strip()
        if tag in ("a", "area") and href:
            self.links.append((tag, href))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.cut()
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        self.add(data)

    def handle_entityref(self, name):
        self.add(NAMES.get(name, "&" + name))

    def handle_charref(self, name):
        self.add(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.cut()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def text(self):
        return " ".join(n for n in (n.strip() for n in self.nodes) if n)


def read(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return reader


def compare(value, pages):
    texts = value(html.visible_text("x"), pages)
    links = value(html.page_links("x"), pages)
    for page, text, found in zip(pages, texts, links):
        reader = read(page)
        assert text == reader.text(), page
        assert [(k.tag, k.href) for k in found] == reader.links, page


def test_stored_pages(spark, value):
    compare(value, [r.html for r in spark.read.parquet(DATA).select("html").collect()])


def test_generated_pages(value):
    rng = random.Random(11)
    parts = [
        "text", " spaced  out ", "\n", "&amp;", "&lt;b&gt;", "&eacute;", "&copy 2024", "&unknown;", "&#233;", "&#x20AC; ", "&nbsp;", "a&b ",
        "<p>", "</p>", "<br/>", "<b class='x>y'>", "</b >", "<!-- c <a href=/no> -->", "<!DOCTYPE html>", "<?pi x?>",
        "<script>var a='<a href=\"/no\">'; // <!-- </script>", "<style>p > a {}</style>", "<SCRIPT type=x>x</script >",
        "<template>gone <b>too</b></template>", "<ruby>k<rp>(</rp><rt>r</rt></ruby>",
        "<a href=/plain>", "<a  HREF = \"/two words\" >", "<a data-href='/no' href='/q?a=1&amp;b=2'>", "<area href=\" /map#x \" alt='a>b'>",
        "<a name=x>", "<a href=''>", "<a title=\"href='/no'\" href=/last href=/later>", "<abbr href=/no>", "</a>", "<a\nhref=\n'/nl'\n>",
        "<a href=\"/c&copy=1&eacute\">", "1 < 2 ", "x > y ", "<img src=x/>", "info<b>@</b>x.com", "<script/>seen</x>",
    ]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) + "<i>end</i>" for _ in range(1500)]
    compare(value, pages)


def test_references(value):
    samples = [
        "a&amp;lt;b", "&copyright;", "&notit;", "&#38;lt;", "&#x41;&#65&#97x", "&#128;&#150;", "&#0;", "&#xD800;", "&#99999999;",
        "&AMP;&amp", "&;", "&", "&&amp;&", "&CounterClockwiseContourIntegral;", "&fjlig;", "no reference", "&nope;", "&eacute=1",
    ]
    assert value(html.html_unescape("x"), samples) == [unescape(s) for s in samples]


def test_anchors_and_scripts(value):
    page = "<a href='MAILTO:a@b.c'>x</a><area href='mailto:no@b.c'><a href='tel:1'>y</a><script>var addy1 = 1</script><script>other</script><!--<script>addy</script>-->"
    assert value(html.anchor_hrefs(html.page_links("x"), "mailto"), [page]) == [["MAILTO:a@b.c"]]
    assert value(html.anchor_hrefs(html.page_links("x"), "tel"), [page]) == [["tel:1"]]
    assert value(html.script_bodies("x"), [page, "<script>none</script>"]) == [["var addy1 = 1"], []]


def test_missing_page(value):
    assert value(html.visible_text("x"), [None, ""]) == [None, ""]


@pytest.mark.parametrize("opener", ["<!-- ", "<!--", "<!-->", "<a ", "<template>", '<a href="x ', "<a b='", "<![CDATA[ ", "<rt>", "<script>", "</template ", "<!x ", "</x "])
def test_open_markup_takes_linear_time(value, opener):
    def seconds(n):
        started = time.perf_counter()
        value(F.struct(F.length(html.visible_text("x")), F.size(html.page_links("x"))), ["text " + opener * (n // len(opener))])
        return time.perf_counter() - started

    seconds(100)
    assert seconds(200_000) < 4 * seconds(50_000) + 2


def test_comments_that_end_abruptly(value):
    pages = [
        "<p>a</p><!--><p>info@b.com</p><a href='/x'>", "a<!--->b<a href=/x>", "a<!-- <a href=/no>n --!>b<a href=/x>", "a<!---->b<a href=/x>",
        "a<!-- - -> <a href=/no> -->b<a href=/x>", "a<!----!>b<a href=/x>", "<!--><script>var addy = '<!-->'</script>b<a href=/x>",
    ]
    assert value(html.visible_text("x"), pages) == ["a info@b.com", *["a b"] * 5, "b"]
    assert [[link.href for link in row] for row in value(html.page_links("x"), pages)] == [["/x"]] * 7
    assert value(html.script_bodies("x"), pages[-1:]) == [["var addy = '<!-->'"]]


def test_open_markup_goes_to_the_end(value):
    pages = ["a <b>b</b> <!-- c <p>d", "a <a href='x'>b</a> <a href=\"y <p>c", "a <template><p>b", "a <p c='d' e"]
    assert value(html.visible_text("x"), pages) == ["a b", "a b", "a", "a"]
