"""Stored responses: classify, cut, decode into pages."""

from __future__ import annotations

import codecs
from encodings.aliases import aliases

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import as_column
from ..functions.urls import normalize_url, normalized_site_key
from ..sources.workspace import Workspace

# Outcome of a stored response, and the content types that count as pages.
OK = "ok"
HTTP_STATUS = "http_status"
CONTENT_TYPE = "content_type"
URL_NORMALIZE = "url_normalize"
REQUEST_ERROR = "request_error"
FUTURE_EXCEPTION = "future_exception"
ALLOWED_CONTENT_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
DEFAULT_MAX_BODY_BYTES = 2_000_000
DEFAULT_CHARSET = "utf-8"
DEFAULT_TEXT_CHARSET = "iso-8859-1"  # for text/* without a charset


def _charset_tables() -> tuple[list[str], dict[str, str], list[str]]:
    """Codec names: those of UTF-8, one-byte charsets with their characters 1-255, all others."""
    utf8: list[str] = []
    one_byte: dict[str, str] = {}
    wide: list[str] = []
    for name in sorted(set(aliases) | set(aliases.values())):
        try:
            codec = codecs.lookup(name).name
            table = bytes(range(1, 256)).decode(codec, "replace")
            alone = all(len(bytes([b]).decode(codec, "replace")) == 1 for b in range(1, 256))
        except (LookupError, UnicodeError):
            continue
        if codec == "utf-8":
            utf8.append(name)
        elif len(table) == 255 and alone and "utf" not in codec:
            one_byte[name] = table
        else:
            wide.append(name)
    return utf8, one_byte, wide


_UTF8, _ONE_BYTE, _WIDE = _charset_tables()


def allowed_content_type(content_type: Column | str) -> Column:
    """True for a missing or blank content type and for those that name a page format."""
    value = F.lower(F.coalesce(as_column(content_type), F.lit("")))
    allowed = value == ""
    for token in ALLOWED_CONTENT_TYPES:
        allowed = allowed | value.contains(token)
    return allowed


def truncate_body(body: Column | str, max_body_bytes: Column | int = DEFAULT_MAX_BODY_BYTES) -> Column:
    """The first bytes of a body; a cut page is still used."""
    limit = F.lit(max_body_bytes) if isinstance(max_body_bytes, int) else max_body_bytes
    return F.substring(as_column(body), F.lit(1), limit)


def header_charset(content_type: Column | str) -> Column:
    """Charset named by the content type, by its default for text, or UTF-8; in codec spelling."""
    value = F.coalesce(as_column(content_type), F.lit(""))
    named = F.btrim(F.regexp_extract(value, r"(?i);\s*charset\s*=\s*([^;]+)", 1), F.lit(" \t'\""))
    kind = F.lower(F.substring_index(value, ";", 1))
    charset = (
        F.when(named != "", named)
        .when(kind.contains("text"), F.lit(DEFAULT_TEXT_CHARSET))
        .otherwise(F.lit(DEFAULT_CHARSET))
    )
    return F.regexp_replace(F.lower(charset), "[^a-z0-9.]+", "_")


def known_charset(charset: Column) -> Column:
    return charset.isin(*_UTF8, *_ONE_BYTE, *_WIDE)


@F.pandas_udf(StringType())
def _decode_wide(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Multi-byte charsets Spark has no decoder for; every other row arrives as NULL."""
    return pd.Series(
        [None if b is None else bytes(b).decode(c, "replace") for b, c in zip(body, charset)], dtype=object
    )


def decode_body(body: Column | str, charset: Column | str, wide: bool = True) -> Column:
    """Text of a body; malformed bytes become the replacement character, unknown charsets NULL.

    UTF-8 and all one-byte charsets are decoded in the JVM. ``wide=False`` leaves out the
    Python step for multi-byte Asian charsets (their rows become NULL).
    """
    body, charset = as_column(body), as_column(charset)
    latin = F.decode(body, "iso-8859-1")
    packed = "\x02".join(f"{name}\x03{index}" for index, name in enumerate(_ONE_BYTE))
    position = F.try_element_at(F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x03")), charset).cast("int")
    table = F.try_element_at(F.array(*[F.lit(t) for t in _ONE_BYTE.values()]), position + 1)
    text = (
        F.when(charset.isin(*_UTF8), F.make_valid_utf8(body.cast("string")))
        .when(charset.isin("iso_8859_1", "latin_1", "latin1"), latin)
        .when(charset.isin(*_ONE_BYTE), _translate(latin, table))
    )
    if wide:
        needs_python = charset.isin(*_WIDE)
        return F.coalesce(text, _decode_wide(F.when(needs_python, body), F.when(needs_python, charset)))
    return text


def _translate(text: Column, table: Column) -> Column:
    source = "".join(map(chr, range(1, 256)))
    return F.call_function("translate", text, F.lit(source), table)


def response_reason(
    status: Column | str,
    content_type: Column | str,
    error: Column | str,
    final_url: Column | str,
    include_query: Column | bool = False,
) -> Column:
    """Outcome of a stored response; the first rule that applies counts."""
    return (
        F.when(as_column(status) >= 400, F.lit(HTTP_STATUS))
        .when(~allowed_content_type(content_type), F.lit(CONTENT_TYPE))
        .when(as_column(error).isNotNull(), F.lit(REQUEST_ERROR))
        .when(~known_charset(header_charset(content_type)), F.lit(FUTURE_EXCEPTION))
        .when(normalize_url(final_url, include_query).isNull(), F.lit(URL_NORMALIZE))
        .otherwise(F.lit(OK))
    )


def classify_responses(responses: DataFrame) -> DataFrame:
    """Add ``reason``; reads the header columns only, so the body stays unread where not needed."""
    return responses.withColumn(
        "reason", response_reason("status", "content_type", "error", "final_url")
    )


def pages_of_responses(
    responses: DataFrame, max_body_bytes: Column | int = DEFAULT_MAX_BODY_BYTES, wide: bool = True
) -> DataFrame:
    """Responses as pages: ``reason`` for all rows, ``html`` for the usable ones.

    Rows in a multi-byte Asian charset take a branch of their own; all others are decoded in the JVM and
    meet no Python stage. ``wide=False`` leaves that branch, and its scan, out: such rows have no ``html``.
    """
    classified = classify_responses(responses)
    charset = header_charset("content_type")
    body = F.when(F.col("reason") == OK, truncate_body("body", max_body_bytes))
    kept = [c for c in responses.columns if c not in ("body", "html")]
    if not wide:
        return classified.select(*kept, "reason", decode_body(body, charset, wide=False).alias("html"))
    needs_python = (F.col("reason") == OK) & charset.isin(*_WIDE)
    plain = classified.where(~needs_python).select(*kept, "reason", decode_body(body, charset, wide=False).alias("html"))
    other = classified.where(needs_python).select(*kept, "reason", _decode_wide(body, charset).alias("html"))
    return plain.unionByName(other)


def with_body_budgets(responses: DataFrame, requests: DataFrame, default: int = DEFAULT_MAX_BODY_BYTES) -> DataFrame:
    """Responses with ``max_body_bytes``: what the requests for their host allow, the largest of several.

    ``requests``: start_url and typed option columns. Only hosts with a budget of their own are joined, from a
    written table of two narrow columns; while that is small, bodies stay where they are.
    """
    own = requests.where(F.col("max_body_bytes") != default).select(normalized_site_key(normalize_url("start_url")).alias("budget_key")).distinct()
    asked = requests.select(normalized_site_key(normalize_url("start_url")).alias("budget_key"), "max_body_bytes")
    largest = asked.join(own, "budget_key", "left_semi").groupBy("budget_key").agg(F.max("max_body_bytes").alias("max_body_bytes"))
    largest = Workspace(responses.sparkSession, "budgets").write(largest.where(F.col("budget_key").isNotNull()), "budgets")
    keyed = responses.withColumn("budget_key", normalized_site_key(normalize_url("url")))
    joined = keyed.join(largest, "budget_key", "left").drop("budget_key")
    return joined.withColumn("max_body_bytes", F.coalesce("max_body_bytes", F.lit(default)))
