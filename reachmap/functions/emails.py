"""E-mail expressions: candidates in text, mailto links and cloaking scripts, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import anchor_hrefs, html_unescape, script_bodies
from .text import as_column, split_list, strip, url_unquote

# What counts as an e-mail candidate in text, and the characters cut off its ends.
EMAIL_PATTERN = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
EDGE_PUNCTUATION = ".,;:()[]<>\"'"

# The same matches found in linear time. A failed run of address characters can't match from a
# later start either, so each run is tried once, from its first word boundary: at its start (or
# right behind a match), or behind what a letter or symbol in front of it rules out.
_RUN = "[a-zA-Z0-9._%+-]"
_WORD = r"[\p{L}\p{M}\p{N}_]"
_FIND_EMAIL = (
    rf"(?U)(?:(?<!{_RUN})|\G)(?:(?<!{_WORD})[.%+-]*+(?=[a-zA-Z0-9_])|(?<={_WORD})[a-zA-Z0-9_]*+(?=[.%+-]))"
    rf"({_RUN}++@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}\b)"
)

# Special-use top-level domains (RFC 6761 and successors) no mail goes to.
SPECIAL_USE_TLDS = ("arpa", "invalid", "local", "localhost", "onion", "test")

_ATEXT = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"(?!(?!xn)..--)[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_VALID = (
    rf"^(?=.{{3,254}}$)(?=[^@]{{1,64}}@){_ATEXT}++(?:\.{_ATEXT}++)*+@(?=[^@]{{3,253}}$)"
    rf"(?:{_LABEL}\.)+{_LABEL}(?<=[a-z])(?<!\.(?:{'|'.join(SPECIAL_USE_TLDS)}))$"
)

# An assignment in a cloaking script, and the tokens of its right-hand side.
CLOAK_ASSIGNMENT = r"^(?:var\s+)?(addy_text[a-z0-9]+|addy[a-z0-9]+)\s*=\s*(.+)"
CLOAK_TOKEN = (
    r"'([^'\\]*(?:\\\\.[^'\\]*)*)'|\"([^\"\\]*(?:\\\\.[^\"\\]*)*)\"|([A-Za-z_][A-Za-z0-9_]*)"
)
# The same tokens, found without giving characters back: a long literal needs no deep recursion.
_FIND_TOKEN = CLOAK_TOKEN.replace(")*)", ")*+)").replace("]*(?:", "]*+(?:").replace("]*)*+", "]*+)*+")
_STATEMENT = r"""(?s)(?:[^;'"]|'(?:[^'\\]|\\.)*+(?:'|\z)|"(?:[^"\\]|\\.)*+(?:"|\z))++"""


def _empty() -> Column:
    return F.array().cast("array<string>")


def email_candidates(text: Column | str) -> Column:
    """Every e-mail-like run of a text, in order, with punctuation cut off both ends."""
    text = as_column(text)
    found = F.regexp_extract_all(text, F.lit(_FIND_EMAIL), F.lit(1))
    trimmed = F.transform(found, lambda e: F.btrim(e, F.lit(EDGE_PUNCTUATION)))
    return F.when(text.contains("@"), trimmed).otherwise(_empty())


def mailto_address(href: Column | str) -> Column:
    """The one address of a mailto href: no header fields, percent-decoded, first of a list."""
    target = F.regexp_replace(as_column(href), r"(?s)^[^:]*:", "")
    decoded = url_unquote(F.substring_index(target, "?", 1))
    return strip(F.substring_index(decoded, ",", 1))


def mailto_candidates(links: Column | str) -> Column:
    return F.transform(anchor_hrefs(links, "mailto"), mailto_address)


def split_js_statements(script: Column | str) -> Column:
    """Statements of a script; a semicolon inside a quoted string doesn't end one."""
    return F.transform(F.regexp_extract_all(as_column(script), F.lit(_STATEMENT), F.lit(0)), strip)


def eval_js_concat(expression: Column, variables: Column) -> Column:
    """Value of a concatenation of string literals and known variables (unknown ones are empty)."""
    tokens = F.regexp_extract_all(expression, F.lit(_FIND_TOKEN), F.lit(0))

    def value(token: Column) -> Column:
        literal = F.substring(token, F.lit(2), F.length(token) - 2)
        literal = F.replace(literal, F.lit("\\\\'"), F.lit("'"))
        literal = F.replace(literal, F.lit("\\\\\\\\"), F.lit("\\\\"))
        return F.when(token.rlike("^['\"]"), html_unescape(literal)).otherwise(
            F.coalesce(F.try_element_at(variables, token), F.lit(""))
        )

    return F.array_join(F.transform(tokens, value), "")


def cloaked_candidates_of_script(script: Column) -> Column:
    """Values with ``@`` which the assignments of one cloaking script build up, in order."""
    assignments = F.filter(
        split_js_statements(script), lambda s: s.rlike("(?i)" + CLOAK_ASSIGNMENT)
    )
    pairs = F.transform(
        assignments,
        lambda s: F.struct(
            F.regexp_extract(s, "(?i)" + CLOAK_ASSIGNMENT, 1).alias("name"),
            F.regexp_extract(s, "(?i)" + CLOAK_ASSIGNMENT, 2).alias("expr"),
        ),
    )
    start = F.struct(
        F.create_map().cast("map<string,string>").alias("variables"), _empty().alias("found"),
        F.lit("").alias("value"),
    )

    def step(state: Column, pair: Column) -> Column:
        # The value is put in the state first, so the two uses below read it, not recompute it.
        valued = F.transform(
            F.array(eval_js_concat(pair["expr"], state["variables"])),
            lambda v: F.struct(
                F.when(
                    v != "",
                    F.map_concat(
                        F.map_filter(state["variables"], lambda k, _: k != pair["name"]),
                        F.create_map(pair["name"], v),
                    ),
                ).otherwise(state["variables"]).alias("variables"),
                F.when(v.contains("@"), F.concat(state["found"], F.array(v)))
                .otherwise(state["found"]).alias("found"),
                v.alias("value"),
            ),
        )
        return valued[0]

    return F.aggregate(pairs, start, step, lambda state: state["found"])


def cloaked_candidates(html: Column | str) -> Column:
    """E-mail candidates hidden in the cloaking scripts of a page."""
    return F.flatten(F.transform(script_bodies(html), cloaked_candidates_of_script))


def is_valid_email(address: Column | str) -> Column:
    """Syntax check of a trimmed, lower-cased ASCII address; no DNS look-up."""
    return as_column(address).rlike(_VALID)


def normalize_email(candidate: Column | str) -> Column:
    """Trimmed and lower-cased address, NULL if it is not a valid one."""
    address = F.lower(strip(candidate))
    return F.when(is_valid_email(address), address)


def valid_emails(candidates: Column | str) -> Column:
    """Distinct normalised addresses of an array of candidates."""
    normal = F.transform(as_column(candidates), lambda c: F.lower(strip(c)))
    return F.array_distinct(F.filter(normal, is_valid_email))


def normalize_allowlist(domains: Column | str) -> Column:
    """Domain suffixes: trimmed, lower-cased, without leading ``@`` or ``.``, distinct, in order."""
    cleaned = F.transform(
        as_column(domains), lambda d: F.ltrim(F.ltrim(F.lower(strip(d)), F.lit("@")), F.lit("."))
    )
    return F.array_distinct(F.filter(cleaned, lambda d: d.isNotNull() & (d != "")))


def parse_allowlist(option: Column | str) -> Column:
    """Allow-list written as one string; NULL if nothing is left."""
    domains = normalize_allowlist(split_list(option))
    return F.when(F.size(domains) > 0, domains)


def domain_allowed(email: Column | str, allowlist: Column | str) -> Column:
    """True if the list is empty or NULL, or the domain equals or is below one of its suffixes."""
    domain = F.lower(F.substring_index(as_column(email), "@", -1))
    allowlist = as_column(allowlist)
    listed = F.exists(allowlist, lambda s: (domain == s) | domain.endswith(F.concat(F.lit("."), s)))
    return F.coalesce(F.size(allowlist) <= 0, F.lit(True)) | F.coalesce(listed, F.lit(False))


def emails_of_page(text: Column | str, links: Column | str, html: Column | str) -> Column:
    """Distinct valid addresses of a page from its text, mailto links and cloaking scripts."""
    return valid_emails(
        F.concat(email_candidates(text), mailto_candidates(links), cloaked_candidates(html))
    )
