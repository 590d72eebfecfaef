"""Priority of a URL in a focused crawl: contact-like pages first, downloads last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, lookup_weight
from .urls import url_path, url_query

# Weight of a word in the path or query.
KEYWORD_WEIGHTS = {
    "contact": -50, "contacts": -50, "support": -40, "help": -25, "about": -20,
    "impressum": -50, "legal": -20, "privacy": -20, "policy": -15, "terms": -15,
    "faq": -10, "feedback": -10, "company": -5, "team": -5, "docs": 40, "doc": 20,
    "spec": 30, "rfc": 40, "archive": 30, "blog": 20, "news": 20, "press": 20,
    "media": 20, "release": 10, "releases": 10, "changelog": 10, "events": 10,
    "jobs": 10, "careers": 10,
}

# Weight of a file extension.
EXTENSION_WEIGHTS = {
    "pdf": 250, "zip": 300, "7z": 300, "rar": 300, "tar": 300, "gz": 300, "bz2": 300,
    "xz": 300, "exe": 300, "msi": 300, "dmg": 300, "iso": 300, "png": 200, "jpg": 200,
    "jpeg": 200, "gif": 200, "webp": 200, "svg": 100, "ico": 100, "css": 100, "js": 100,
    "json": 80, "xml": 80, "txt": 50, "md": 50, "rss": 80,
}

QUERY_WEIGHT = 10
MAX_DEPTH_WEIGHT = 10
HOME_PATHS = ("/", "/index.html", "/index.htm")
HOME_WEIGHT = -5


def url_priority_score(url: Column | str) -> Column:
    """Integer score of a URL; lower is fetched earlier."""
    url = as_column(url)
    raw_path = F.lower(url_path(url))
    path = F.when(raw_path == "", F.lit("/")).otherwise(raw_path)
    query = F.lower(url_query(url))
    words = F.array_distinct(
        F.regexp_extract_all(F.concat(path, F.lit("?"), query), F.lit("[a-z0-9]+"), F.lit(0))
    )
    word_score = F.aggregate(words, F.lit(0), lambda total, w: total + lookup_weight(KEYWORD_WEIGHTS, w))
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    extension = F.regexp_extract(path, r"[^/.][^/]*\.([^/.]*)$", 1)
    return (
        word_score
        + F.when(query != "", F.lit(QUERY_WEIGHT)).otherwise(F.lit(0))
        + F.least(depth, F.lit(MAX_DEPTH_WEIGHT))
        + lookup_weight(EXTENSION_WEIGHTS, extension)
        + F.when(path.isin(*HOME_PATHS), F.lit(HOME_WEIGHT)).otherwise(F.lit(0))
    ).cast("int")
