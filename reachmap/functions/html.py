"""Projections of raw HTML: visible text, links, script bodies, character references.

No document tree is built. One left-to-right regular expression recognises the pieces of the
markup (comment, raw-text element, tag), so a comment opener inside a script, or a tag inside
a comment, is read the way an HTML tokenizer reads it.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, literal_map, strip

_BREAK = "\ufdd0"  # a Unicode noncharacter marks the place of removed markup

# Whatever is opened and never closed goes to the end of the page as one piece. So a page is read
# once, whatever it holds: no opener scans ahead in vain for the next one to scan ahead again.

# The rest of a start tag; a quote counts only directly after "=".
_TAG_REST = r"""(?:[^>=]|=(?!\s*["'])|=\s*"[^"]*+(?:"|\z)|=\s*'[^']*+(?:'|\z))*+"""
# Every piece of markup starts with "<", which the patterns below factor out: a scan then
# compares one character at most places.
# ``<!-->`` and ``<!--->`` are whole comments, and ``--!>`` ends one too.
_COMMENT = r"!--(?:-?>|.*?(?:--!?\s*>|\z))"
_CDATA = r"!\[CDATA\[.*?(?:\]\s*\]\s*>|\z)"
_CDATA_TEXT = _CDATA.replace(".*?", "(.*?)")
_OTHER_TAG = rf"[a-zA-Z]{_TAG_REST}(?:>|\z)|[!/?][^>]*+(?:>|\z)"


def _raw_element(name: str, body: str = ".*?") -> str:
    return rf"{name}(?=[\s/>]){_TAG_REST}(?<!/)>{body}(?:</\s*{name}\s*>|\z)"


_STYLE = _raw_element("style")
_SCRIPT = _raw_element("script")
# Elements whose text is not part of the page text.
_HIDDEN = "|".join(
    rf"{name}(?=[\s/>]){_TAG_REST}(?<!/)>.*?(?:</{name}(?=[\s/>])[^>]*+(?:>|\z){end}|\z)"
    for name, end in (("template", ""), ("rt", "|(?=</ruby[\\s>])"), ("rp", "|(?=</ruby[\\s>])"))
)
_MARKUP = rf"(?is)<(?:{_COMMENT}|{_CDATA_TEXT}|{_SCRIPT}|{_STYLE}|{_HIDDEN}|{_OTHER_TAG})"
_LINK_TAGS = (
    rf"(?is)<(?:{_COMMENT}|{_CDATA}|{_SCRIPT}|{_STYLE}|(a(?:rea)?(?=[\s/>]){_TAG_REST}>)|{_OTHER_TAG})"
)
_SCRIPT_BODIES = rf"(?is)<(?:{_COMMENT}|{_CDATA}|{_raw_element('script', '(.*?)')}|{_STYLE}|{_OTHER_TAG})"
_ATTRIBUTE = r"""(?s)[^\s/>=][^\s/>=]*(?:\s*=+\s*(?:"[^"]*"|'[^']*'|(?!["'])[^>\s]*))?"""

# References that make up nearly all of those on real pages; looked up before the full table.
_COMMON = {
    n: html5[n + ";"]
    for n in ("amp", "lt", "gt", "quot", "nbsp", "copy", "middot", "laquo", "raquo", "ndash", "mdash", "hellip")
}
_LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)


def _lookup(name: Column) -> Column:
    full = {n.rstrip(";"): c for n, c in html5.items()}
    return F.coalesce(
        F.try_element_at(literal_map(_COMMON), name), F.try_element_at(literal_map(full), name)
    )


def _lookup_legacy(name: Column) -> Column:
    return F.try_element_at(literal_map({n: html5[n] for n in _LEGACY}), name)


def _code_point(reference: Column) -> Column:
    """The character of ``&#233;`` or ``&#xe9;``."""
    hexadecimal = F.regexp_extract(reference, "^&#[xX]0*([0-9a-fA-F]{1,7});?$", 1)
    decimal = F.regexp_extract(reference, "^&#0*([0-9]{1,8});?$", 1)
    number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", decimal).cast("bigint")
    windows = {str(b): bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)}
    bad = number.isNull() | (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return (
        F.when(bad, F.lit("\ufffd"))
        .when(number.between(128, 159), F.try_element_at(literal_map(windows), number.cast("string")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def _decode_references(text: Column, tokens: str, named) -> Column:
    """Split into references and the text between them, decode each reference once, join."""
    decoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(tokens), F.lit(0)),
            lambda t: F.when(~t.startswith("&") | (F.length(t) == 1), t)
            .when(t == "&amp;", F.lit("&"))
            .when(t.startswith("&#"), _code_point(t))
            .otherwise(named(t)),
        ),
        "",
    )
    return (
        F.when(~text.contains("&"), text)
        .when(~text.rlike("&(?!amp;)[a-zA-Z#]"), F.replace(text, F.lit("&amp;"), F.lit("&")))
        .otherwise(decoded)
    )


def unescape_text(text: Column | str) -> Column:
    """Character references in page text: the semicolon is optional, unknown names lose it."""

    def named(token: Column) -> Column:
        name = F.regexp_replace(token, "^&|;$", "")
        return F.coalesce(_lookup(name), F.concat(F.lit("&"), name))

    tokens = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][-.a-zA-Z0-9]*;?|[^&]++|&"
    return _decode_references(as_column(text), tokens, named)


def html_unescape(text: Column | str) -> Column:
    """Character references in attributes and script literals, by the HTML5 rules.

    Names need their semicolon, but for the old Latin-1 names, which also count as the longest
    prefix of a longer word (``&copyright`` gives the sign and ``right``).
    """

    def named(token: Column) -> Column:
        name = F.regexp_replace(token, "^&|;$", "")
        prefix = F.regexp_extract(token, "^&(" + "|".join(_LEGACY) + ")", 1)
        tail = F.substring(token, F.length(prefix) + F.lit(2), F.length(token))
        return F.coalesce(
            F.when(token.endswith(";"), _lookup(name)),
            F.when(prefix != "", F.concat(_lookup_legacy(prefix), tail)),
            token,
        )

    tokens = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[^\t\n\f <&#;]{1,32};?|[^&]++|&"
    return _decode_references(as_column(text), tokens, named)


def visible_text(html: Column | str) -> Column:
    """Text nodes of a page, stripped, blank ones dropped, joined by one space."""
    marked = F.regexp_replace(as_column(html), _MARKUP, f"{_BREAK}$1{_BREAK}")
    nodes = F.transform(F.split(marked, _BREAK), lambda node: strip(unescape_text(node)))
    return F.array_join(F.filter(nodes, lambda node: node != ""), " ")


def _href_of(tag: Column) -> Column:
    attributes = F.filter(
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(r"(?is)^href(?:\s*=|$)")
    )
    value = F.regexp_replace(F.try_element_at(attributes, F.lit(-1)), r"(?is)^href\s*=*\s*", "")
    quoted = value.rlike(r"""(?s)^(?:".*"|'.*')$""")
    bare = F.when(quoted, F.regexp_replace(value, r"""(?s)^.|.$""", "")).otherwise(value)
    return strip(html_unescape(bare))


def page_links(html: Column | str) -> Column:
    """``href`` of every <a> and <area>, in document order, duplicates kept, blanks dropped.

    An array of ``struct<tag, href>``; explode it with its position to get link rows.
    """
    tags = F.filter(F.regexp_extract_all(as_column(html), F.lit(_LINK_TAGS), F.lit(1)), lambda t: t != "")
    links = F.transform(
        tags,
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, "(?i)^(a(?:rea)?)", 1)).alias("tag"), _href_of(t).alias("href")
        ),
    )
    return F.filter(links, lambda link: link["href"] != "")


def anchor_hrefs(links: Column | str, scheme: str) -> Column:
    """Hrefs of <a> links (not <area>) with the given scheme, from a ``page_links`` column."""
    wanted = F.filter(
        as_column(links),
        lambda link: (link["tag"] == "a") & F.lower(link["href"]).startswith(f"{scheme}:"),
    )
    return F.transform(wanted, lambda link: link["href"])


def script_bodies(html: Column | str, words: tuple[str, ...] = ("cloak", "addy")) -> Column:
    """Bodies of the <script> elements which contain one of ``words``."""
    html = as_column(html)

    def holds(text: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        return found

    bodies = F.filter(F.regexp_extract_all(html, F.lit(_SCRIPT_BODIES), F.lit(1)), holds)
    return F.when(holds(html), bodies).otherwise(F.array().cast("array<string>"))
