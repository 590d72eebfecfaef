"""URL expressions: normalisation, site keys, reference resolution.

All of them are Column -> Column compositions of built-in functions, so they run inside the
scan stage and also work unchanged on streams. Invalid URLs give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, bind, literal_map, strip

# Country-code top-level domains with a known phone region.
TLD_REGIONS = {
    "ru": "RU", "by": "BY", "kz": "KZ", "ua": "UA", "kg": "KG", "uz": "UZ", "am": "AM",
    "az": "AZ", "ge": "GE", "md": "MD", "ee": "EE", "lv": "LV", "lt": "LT", "pl": "PL",
    "de": "DE", "fr": "FR", "it": "IT", "es": "ES", "pt": "PT", "nl": "NL", "be": "BE",
    "ch": "CH", "at": "AT", "se": "SE", "no": "NO", "fi": "FI", "dk": "DK", "ie": "IE",
    "uk": "GB", "gb": "GB", "us": "US", "ca": "CA", "au": "AU", "nz": "NZ", "jp": "JP",
    "cn": "CN", "in": "IN",
}
UNKNOWN_REGION = "ZZ"

# Schemes of hrefs that never lead to a page.
NON_PAGE_SCHEMES = ("mailto", "tel", "javascript", "data")

_CONTROL_OR_SPACE = "".join(map(chr, range(0x21)))
_SEP = "\ufdd0"
# scheme, host, port, path, query; user info and fragment are matched and left out.
_HTTP_URL = (
    r"(?is)^(https?)://(?:[^/?#]*@)?([^/?#@:\[\]]+)(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
)
_HOST = r"(?is)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@:\[\]]+)"
_ORIGIN = r"(?is)^([a-z][a-z0-9+.-]*)://([^/?#]+)"
_PATH = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"


# URLs that are their own normal form, but for a query that may have to go.
_PLAIN = r"^https?://[a-z0-9.-]+/[^?#\x00-\x1f]*+(?:\?[^#\x00-\x1f]++)?$"
# Hrefs from the root of the host, without fragment, dot segments, empty parameters and characters to clean.
_ROOTED = r"^(?!.*/\.{1,2}(?:[/?;]|$))(?![^?]*;(?:\?|$))/(?!/)[^?#\x00-\x20]*+(?:\?[^#\x00-\x20]++)?$"


def _clean(url: Column) -> Column:
    """Drop tabs and line ends anywhere, control characters and blanks in front."""
    cleaned = F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_CONTROL_OR_SPACE))
    return F.when(url.rlike(r"^[\x00-\x20]|[\t\r\n]"), cleaned).otherwise(url)


def normalize_url(url: Column | str, include_query: Column | bool = False) -> Column:
    """Canonical form used to compare pages; NULL for anything that is not http(s) with a host.

    Scheme and host are lower-cased, user info, fragment and default port dropped, an empty
    path becomes ``/``. Path and query keep their case and encoding. The query is kept only
    if ``include_query`` is true (a Python bool or a boolean column).
    """
    url = as_column(url)
    keep_query = F.lit(include_query) if isinstance(include_query, bool) else include_query
    return F.when(
        url.rlike(_PLAIN), F.when(keep_query, url).otherwise(drop_query(url))
    ).otherwise(_normalize(_clean(url), keep_query))


def _normalize(url: Column, keep_query: Column) -> Column:
    pieces = F.split(F.regexp_replace(url, _HTTP_URL, _SEP.join("$%d" % i for i in range(1, 6))), _SEP)

    def assemble(part: Column) -> Column:
        scheme = F.lower(part[0])
        digits = F.regexp_replace(part[2], "^0+(?=[0-9])", "")
        port = F.when(F.length(digits).between(1, 5), digits.cast("int"))
        default_port = F.when(scheme == "http", F.lit(80)).otherwise(F.lit(443))
        port_text = F.when(port.isNull() | (port == default_port), F.lit("")).otherwise(
            F.concat(F.lit(":"), port.cast("string"))
        )
        path = F.when(part[3] == "", F.lit("/")).otherwise(part[3])
        query = F.when(keep_query & (part[4] != ""), F.concat(F.lit("?"), part[4])).otherwise(F.lit(""))
        usable = (F.size(part) == 5) & (F.length(digits) <= 5) & (port.isNull() | (port <= 65535))
        return F.when(usable, F.concat(scheme, F.lit("://"), F.lower(part[1]), port_text, path, query))

    return bind(pieces, assemble)


def drop_query(normalized: Column | str) -> Column:
    """The normal form without query of a URL normalised with its query."""
    return F.substring_index(as_column(normalized), "?", 1)


def strip_www(host: Column | str) -> Column:
    """Trim, lower-case and drop one leading ``www.``; other sub-domains stay distinct."""
    return F.regexp_replace(F.lower(strip(host)), r"^www\.", "")


def url_host(url: Column | str) -> Column:
    host = F.lower(F.regexp_extract(_clean(as_column(url)), _HOST, 1))
    return F.when(host != "", host)


def site_key(url: Column | str) -> Column:
    """Key which tells sites apart: the host without ``www.``; NULL without a host."""
    return strip_www(url_host(url))


def normalized_site_key(url: Column | str) -> Column:
    """``site_key`` of a URL known to be in normal form, read off in one match."""
    key = F.regexp_extract(as_column(url), r"^https?://(?:www\.)?([^/:?#]+)", 1)
    return F.when(key != "", key)


def origin(url: Column | str) -> Column:
    """``scheme://host[:port]`` of an absolute URL, else NULL."""
    text = _clean(as_column(url))
    scheme = F.lower(F.regexp_extract(text, _ORIGIN, 1))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.regexp_extract(text, _ORIGIN, 2)))


def is_same_site(url: Column | str, base_key: Column | str) -> Column:
    """True if the URL's site key equals ``base_key``; scheme and port don't count."""
    return F.coalesce(site_key(url) == as_column(base_key), F.lit(False))


def phone_region_of_url(url: Column | str) -> Column:
    """Phone region suggested by the top-level domain; ``ZZ`` if it suggests none."""
    label = F.substring_index(F.btrim(url_host(url), F.lit(".")), ".", -1)
    return F.coalesce(F.try_element_at(literal_map(TLD_REGIONS), label), F.lit(UNKNOWN_REGION))


def is_page_href(href: Column | str) -> Column:
    """False for blank hrefs and for mailto, tel, javascript and data links."""
    text = strip(href)
    schemes = "|".join(NON_PAGE_SCHEMES)
    return (text != "") & ~_clean(text).rlike(f"(?i)^(?:{schemes}):")


def _remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` of an absolute path."""
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return (
            F.when(segment == "..", parent)
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_directory = path.rlike(r"/\.{1,2}$")
    joined = F.array_join(
        F.when(ends_in_directory, F.concat(folded, F.array(F.lit("")))).otherwise(folded), "/"
    )
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def resolve_href(base: Column | str, href: Column | str, include_query: Column | bool = False) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986) and normalise the result.

    ``base`` must be a normalised URL. NULL if the target is not an http(s) page.
    """
    base, href = as_column(base), as_column(href)
    keep_query = F.lit(include_query) if isinstance(include_query, bool) else include_query
    rooted = F.concat(_root(base), href)
    return F.when(
        href.rlike(_ROOTED), F.when(keep_query, rooted).otherwise(drop_query(rooted))
    ).otherwise(
        bind(
            bind(_clean(href), lambda text: _join(base, text)), lambda url: normalize_url(url, keep_query)
        )
    )


def _root(base: Column) -> Column:
    return F.regexp_extract(base, r"(?s)^([a-z]+://[^/?#]*)", 1)


def _join(base: Column, text: Column) -> Column:
    """The absolute URL of any cleaned reference."""
    base_scheme = F.substring_index(base, ":", 1)
    scheme = F.lower(F.regexp_extract(text, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    foreign = (scheme != "") & (scheme != base_scheme)
    rest = F.when(scheme != "", F.regexp_replace(text, r"(?s)^[^:]*:", "")).otherwise(text)
    return F.when(foreign, text).otherwise(
        bind(
            F.regexp_replace(rest, r"(?s)^//(?=[/?#]|$)", ""),
            lambda r: F.when(
                r.startswith("//"),
                F.concat(base_scheme, F.lit(":"), F.regexp_replace(r, r"(?s)^((?:[^?#]*/)?[^;/?#]*);(?=[?#]|$)", "$1")),
            ).otherwise(
                F.concat(_root(base), _join_path(base, r))
            ),
        )
    )


def _join_path(base: Column, reference: Column) -> Column:
    """Path and query of a reference without scheme and host."""
    path = F.regexp_extract(reference, r"(?s)^([^?#]*)", 1)
    query = F.regexp_extract(reference, _QUERY, 1)
    base_path = F.regexp_extract(base, _PATH, 1)
    # Parameters of the last segment (from its first semicolon on) take no part in dot segments; empty ones go.
    parameters = F.regexp_extract(path, r"(?s)(;[^/]+)$", 1)
    bare = F.regexp_replace(path, r"(?s);[^/]*$", "")
    merged = F.when(bare.startswith("/"), bare).otherwise(
        F.regexp_replace(F.concat(F.regexp_replace(base_path, r"[^/]*$", ""), bare), "/{2,}", "/")
    )
    resolved = bind(
        merged, lambda p: F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), _remove_dot_segments(p)).otherwise(p)
    )
    return F.when(
        path == "",
        F.concat(
            base_path, F.lit("?"), F.when(query == "", F.regexp_extract(base, _QUERY, 1)).otherwise(query)
        ),
    ).otherwise(F.concat(resolved, parameters, F.lit("?"), query))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), _PATH, 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(as_column(url), _QUERY, 1)
