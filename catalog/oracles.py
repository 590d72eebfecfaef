"""The same answers in plain SQL over the same views."""

from __future__ import annotations

from reachmap.functions.numbering import NUMBERING_PLAN
from reachmap.functions.scoring import EXTENSION_WEIGHTS, KEYWORD_WEIGHTS
from reachmap.functions.urls import TLD_REGIONS

from .views import ALLOWED, ARRIVALS, COMMENT_PAGES, CONTACT_PAGES, CRAWL_LOG, DOC_PAGES, LINKED_PAGES, ODD_PAGES, ODD_PHONES, ODD_REQUESTS, REQUESTS, RESPONSES, SCORED_URLS, inline

_WITH = {
    "contact_pages": CONTACT_PAGES, "doc_pages": DOC_PAGES, "linked_pages": LINKED_PAGES,
    "responses": RESPONSES, "requests": REQUESTS, "crawl_log": CRAWL_LOG, "comment_pages": COMMENT_PAGES, "arrivals": ARRIVALS, "lists_given": ALLOWED,
}


def _with(*names: str, **more: str) -> str:
    parts = [f"{n} AS ({inline(_WITH[n])})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return "WITH " + ",\n".join(parts) + "\n"


_ALL_PAGES = "SELECT page_id, url, final_url, html FROM contact_pages UNION ALL SELECT page_id, url, final_url, html FROM doc_pages"


# --- expressions --------------------------------------------------------------------------------

_SPACE = r"[\s\p{Z}]"
_HIDDEN = r"<!---?>|<!--.*?(?:--!?>|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _unescape(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·")):
        x = f"replace({x}, '&{name};', '{char}')"
    return f"regexp_replace(regexp_replace({x}, '&amp;?', '&', 'g'), '&am;', '&am', 'g')"


def _text(html: str) -> str:
    marked = f"regexp_replace({html}, '(?is){_HIDDEN}|<[!/?a-zA-Z][^>]*(?:>|\\z)', chr(64976), 'g')"
    nodes = f"list_transform(string_split({_unescape(marked)}, chr(64976)), lambda x: {_strip('x')})"
    return f"array_to_string(list_filter({nodes}, lambda x: x <> ''), ' ')"


def _tags(html: str) -> str:
    return f"regexp_extract_all(regexp_replace({html}, '(?is){_HIDDEN}', '', 'g'), '(?is)<a(?:rea)?\\s[^>]*href=\"[^\"]*\"[^>]*>', 0)"


def _link_rows(pages: str, columns: str = "page_id, final_url") -> str:
    return f"""
SELECT {columns}, pos, regexp_extract(t, '^<(a(?:rea)?)', 1) AS tag, {_strip(_unescape("regexp_extract(t, 'href=\"([^\"]*)\"', 1)"))} AS href
FROM (SELECT {columns}, unnest(range(len(tags))) AS pos, unnest(tags) AS t
      FROM (SELECT {columns}, {_tags('html')} AS tags FROM {pages}) AS tagged) AS numbered"""


def _is_page(href: str) -> str:
    return f"NOT regexp_matches({href}, '(?i)^(mailto|tel|javascript|data):')"


def _normal(url: str, query: bool = False) -> str:
    """http(s) URLs without user info; the shapes the views hold."""
    host = f"lower(regexp_extract({url}, '(?i)^https?://([^/?#:]+)', 1))"
    scheme = f"lower(regexp_extract({url}, '(?i)^(https?)://', 1))"
    port = f"regexp_extract({url}, '(?i)^https?://[^/?#:]+:([0-9]*)', 1)"
    path = f"regexp_extract({url}, '(?i)^https?://[^/?#]+([^?#]*)', 1)"
    search = f"regexp_extract({url}, '^[^#?]*(\\?[^#]+)', 1)" if query else "''"
    shown = f"CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') THEN '' ELSE ':' || {port} END"
    return f"CASE WHEN {host} <> '' THEN {scheme} || '://' || {host} || {shown} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {search} END"


def _key(url: str) -> str:
    return f"regexp_replace(lower(regexp_extract({url}, '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', '')"


def _resolve(base: str, href: str, query: bool = True) -> str:
    root = f"regexp_extract({base}, '^(https?://[^/?#]+)', 1)"
    absolute = f"CASE WHEN regexp_matches({href}, '(?i)^https?://') THEN {href} ELSE {root} || {href} END"
    return _normal(f"({absolute})", query)


def _region(url: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in TLD_REGIONS.items())
    return f"CASE regexp_extract(regexp_extract({url}, '^https?://([^/?#:]+)', 1), '[^.]+$') {cases} ELSE 'ZZ' END"


def _score(url: str) -> str:
    path = f"lower(regexp_extract({url}, '^https?://[^/]*(/[^?#]*)', 1))"
    words = " ".join(f"WHEN '{w}' THEN {n}" for w, n in KEYWORD_WEIGHTS.items())
    extensions = " ".join(f"WHEN '{w}' THEN {n}" for w, n in EXTENSION_WEIGHTS.items())
    return (
        f"CAST(coalesce(list_sum(list_transform(list_distinct(regexp_extract_all({path}, '[a-z0-9]+')), lambda w: CASE w {words} ELSE 0 END)), 0)"
        f" + least(len(list_filter(string_split({path}, '/'), lambda s: s <> '')), 10)"
        f" + CASE regexp_extract({path}, '[^/.][^/]*\\.([^/.]*)$', 1) {extensions} ELSE 0 END"
        f" - CASE WHEN {path} IN ('/', '/index.html', '/index.htm') THEN 5 ELSE 0 END AS INTEGER)"
    )


# --- e-mails ------------------------------------------------------------------------------------

# An ASCII word boundary would differ next to accented letters, so the character before a
# candidate is read along and what it forbids is cut off.
_CANDIDATE = r"[^\x00-\x7F]?[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def _email_candidates(text: str) -> str:
    cut = (
        "CASE WHEN regexp_matches(e, '^[^\\x00-\\x7F]') THEN"
        " CASE WHEN regexp_matches(e, '^[\\p{L}\\p{N}]') THEN regexp_replace(substr(e, 2), '^[a-zA-Z0-9_]+', '') ELSE regexp_replace(substr(e, 2), '^[.%+-]+', '') END"
        " ELSE regexp_replace(e, '^[.%+-]+', '') END"
    )
    edges = """'.,;:()[]<>"'''"""
    return f"list_transform(regexp_extract_all({text}, '{_CANDIDATE}', 0), lambda e: trim({cut}, {edges}))"


_LOCAL = "[a-z0-9!#$%&''*+/=?^_`{|}~-]+"
_LABEL = "[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def _valid_email(e: str) -> str:
    return (
        f"(regexp_full_match({e}, '{_LOCAL}(?:\\.{_LOCAL})*@(?:{_LABEL}\\.)+{_LABEL}') AND regexp_matches({e}, '[a-z]$')"
        f" AND NOT regexp_matches({e}, '\\.(arpa|invalid|local|localhost|onion|test)$') AND length({e}) <= 254"
        f" AND strpos({e}, '@') <= 65)"
    )


def _mailto(href: str) -> str:
    target = f"regexp_replace(regexp_replace({href}, '(?i)^mailto:', ''), '\\?.*$', '')"
    return _strip(f"regexp_replace(url_decode({target}), ',.*$', '')")


_CLOAKED = "SELECT page_id, 'office@plant' || CAST(page_id % 10000 AS VARCHAR) || '.example.org' AS candidate FROM contact_pages WHERE html LIKE '%var addy%'"
_MAILTO = f"SELECT page_id, {_mailto('href')} AS candidate FROM ({_link_rows('contact_pages')}) AS l WHERE tag = 'a' AND lower(href) LIKE 'mailto:%'"
_EMAIL_ROWS = f"""
SELECT DISTINCT page_id, url, lower(trim(candidate)) AS contact
FROM (SELECT page_id, url, unnest({_email_candidates('text')}) AS candidate FROM texts
      UNION ALL SELECT m.page_id, p.url, m.candidate FROM ({_MAILTO} UNION ALL {_CLOAKED}) AS m JOIN contact_pages AS p ON m.page_id = p.page_id) AS c
WHERE {_valid_email('lower(trim(candidate))')}"""
_ALLOWED = " OR ".join(
    f"regexp_extract(contact, '@(.*)$', 1) = '{d}' OR contact LIKE '%@%.{d}'" for d in ("mail.example.com", "example.org", "mail3.example.com")
)


# --- phones -------------------------------------------------------------------------------------

_PUNCT = r"[-x\x{2010}-\x{2015}\x{2212}\x{30FC}\x{FF0D}-\x{FF0F} \x{A0}\x{AD}\x{200B}\x{2060}\x{3000}()\x{FF08}\x{FF09}\x{FF3B}\x{FF3D}.\[\]/~\x{2053}\x{223C}]"
_CORE = rf"[0-9]{{1,20}}(?:{_PUNCT}{{0,4}}[0-9]{{1,20}}){{0,20}}"
_SPOIL = r"[\p{Latin}%\p{Sc}]"
_RUN = rf"(?:(?:[(\[+]{_PUNCT}{{0,4}}){{1,2}}|{_SPOIL}?){_CORE}{_SPOIL}?"
_CUTS = (r"/+", r"\s-|-\s", r"[\x{2012}-\x{2015}\x{FF0D}]\s*", r"\.+\s*", r"\s+")

_PLAN = "VALUES " + ", ".join(
    f"({rank}, '{r.region}', '{r.calling_code}', '{r.trunk.strip('[]')}', {str(r.trunk_required).lower()}, '{r.idd}', '{r.pattern}')"
    for rank, r in enumerate(NUMBERING_PLAN)
)
_PLAN_CTE = f"SELECT * FROM ({_PLAN}) AS v(rank, region, code, trunk, required, idd, pattern)"


def _phone_ctes(candidates: str, regions: str, in_text: bool = True) -> dict[str, str]:
    """Read candidates: (unit, page_id, raw, levels?) under (page_id, region, rank) rows.

    ``candidates``: unit, page_id, raw, whole (only the whole counts). ``regions``: page_id,
    region, view_rank.
    """
    levels = " UNION ALL ".join(
        ["SELECT unit, page_id, 0 AS level, raw AS piece FROM cand",
         "SELECT unit, page_id, 2 AS level, unnest(string_split(replace(raw, '(', '@('), '@')) AS piece FROM cand WHERE NOT whole AND raw LIKE '%(%'"]
        + [
            f"SELECT unit, page_id, {n} AS level, unnest(string_split_regex(raw, '{cut}')) AS piece FROM cand WHERE NOT whole AND regexp_matches(raw, '{cut}')"
            for n, cut in zip((1, 3, 4, 5, 6), _CUTS)
        ]
    )
    return {
        "plan": _PLAN_CTE,
        "cand": candidates,
        "views": regions,
        "cut": levels,
        "pieces": r"""
SELECT unit, page_id, level, piece, regexp_replace(piece, '[^0-9]', '', 'g') AS digits, regexp_matches(piece, '^[^0-9+]*\+') AS plus
FROM (SELECT unit, page_id, level, regexp_replace(regexp_replace(piece, '^[^0-9\p{L}%\p{Sc}+(\[]+|[^0-9\p{L}%\p{Sc}]+$', '', 'g'), '(?i)[ ]*(x|#|ext\.?)[ .]*[0-9]{1,7}$', '') AS piece FROM cut) AS t
WHERE length(regexp_replace(piece, '[^0-9]', '', 'g')) >= 5 AND NOT regexp_matches(piece, '^[\p{L}%\p{Sc}]|[\p{L}%\p{Sc}]$')
  AND regexp_full_match(piece, '[(\[]?(?:[^()\[\]]+[)\]])?[^()\[\]]+(?:[(\[][^()\[\]]+[)\]]){0,3}[^()\[\]]*')
  AND NOT regexp_matches(piece, '\d{1,5}-+\d{1,5}\s{0,4}\(\d{1,4}')""",
        "readings": f"""
SELECT unit, p.page_id, level, view_rank, piece, digits AS number, 1 AS choice FROM pieces AS p JOIN views AS v ON p.page_id = v.page_id WHERE plus
UNION ALL SELECT unit, p.page_id, level, view_rank, piece, substr(digits, length(idd) + 1), 1 FROM pieces AS p JOIN views AS v ON p.page_id = v.page_id JOIN plan AS n ON n.region = v.region WHERE NOT plus AND starts_with(digits, idd)
UNION ALL SELECT unit, p.page_id, level, view_rank, piece, code || substr(digits, 2), 3 FROM pieces AS p JOIN views AS v ON p.page_id = v.page_id JOIN plan AS n ON n.region = v.region WHERE NOT plus AND trunk <> '' AND contains(trunk, digits[1])
UNION ALL SELECT unit, p.page_id, level, view_rank, piece, code || digits, 4 FROM pieces AS p JOIN views AS v ON p.page_id = v.page_id JOIN plan AS n ON n.region = v.region WHERE NOT plus {'AND NOT required' if in_text else ''}
UNION ALL SELECT unit, p.page_id, level, view_rank, piece, digits, 5 FROM pieces AS p JOIN views AS v ON p.page_id = v.page_id JOIN plan AS n ON n.region = v.region WHERE NOT plus AND starts_with(digits, code)""",
        "with_inner": """
SELECT * FROM readings
UNION ALL SELECT unit, r.page_id, level, view_rank, piece, code || substr(number, length(code) + 2), 2
FROM readings AS r JOIN plan ON starts_with(number, code) AND trunk <> '' AND contains(trunk, number[length(code) + 1]) WHERE choice = 1""",
        "valid": """
SELECT unit, page_id, level, view_rank, piece, choice, number, min_by(region, rank) AS own
FROM (SELECT r.*, n.rank, n.region FROM with_inner AS r JOIN plan AS n ON starts_with(r.number, n.code) AND regexp_full_match(r.number, n.code || '(?:' || n.pattern || ')')) AS t
GROUP BY ALL""",
        "chosen": "SELECT DISTINCT unit, page_id, level, view_rank, piece, first_value(number) OVER w AS number, first_value(own) OVER w AS own FROM valid WINDOW w AS (PARTITION BY unit, page_id, level, view_rank, piece ORDER BY choice)",
        "best_level": "SELECT * FROM chosen QUALIFY level = min(level) OVER (PARTITION BY unit, page_id, view_rank)",
        "allowed": "SELECT b.* FROM best_level AS b WHERE NOT EXISTS (SELECT 1 FROM views AS v WHERE v.page_id = b.page_id AND v.region <> '') OR EXISTS (SELECT 1 FROM views AS v WHERE v.page_id = b.page_id AND v.region = b.own)",
        "numbers": """
SELECT DISTINCT page_id, '+' || number AS phone
FROM (SELECT *, min(CASE WHEN view_rank < 1000 THEN view_rank END) OVER (PARTITION BY unit, page_id) AS first_view FROM allowed) AS t
WHERE view_rank = first_view OR view_rank = 1000""",
    }


_RUNS = f"""
SELECT page_id || '/' || pos AS unit, page_id, raw, false AS whole FROM (SELECT page_id, unnest(range(len(runs))) AS pos, unnest(runs) AS raw FROM (SELECT page_id, regexp_extract_all(text, '{_RUN}', 0) AS runs FROM texts) AS r) AS u
WHERE NOT regexp_matches(raw, '(?:[0-3]?\\d/[01]?\\d|[01]?\\d/[0-3]?\\d)/(?:[12]\\d)?\\d{{2}}') """
_IDD = r"""
SELECT page_id || '/i' || pos AS unit, page_id, regexp_replace(trim(raw), '^(00|011)', '+') AS raw, true AS whole
FROM (SELECT page_id, unnest(range(len(found))) AS pos, unnest(found) AS raw FROM (SELECT page_id, regexp_extract_all(text, '(?:^|[^\d+])((?:00|011)[\s().-]*[1-9](?:[\s().-]*\d){6,})', 1) AS found FROM texts) AS f) AS u"""
_TEL_RAW = r"regexp_replace(trim(url_decode(regexp_replace(regexp_replace(href, '(?i)^tel:', ''), '[?;].*$', ''))), '^(00|011)', '+')"
_TEL = f"SELECT page_id || '/t' || pos AS unit, page_id, {_TEL_RAW} AS raw, true AS whole FROM ({_link_rows('contact_pages')}) AS l WHERE tag = 'a' AND lower(href) LIKE 'tel:%'"


def _views_of(pages: str, *regions: str) -> str:
    rows = ", ".join([f"('{r}', {i})" for i, r in enumerate(regions)] + ["('', 1000)"])
    return f"SELECT page_id, region, view_rank FROM (SELECT DISTINCT page_id FROM {pages}) AS p, (VALUES {rows}) AS v(region, view_rank)"


# Page ids of the two kinds of pages overlap, so ids are made distinct first.
_TEXTS_ALL = f"SELECT 'c' || page_id AS page_id, url, {_text('html')} AS text FROM contact_pages UNION ALL SELECT 'd' || page_id, url, {_text('html')} FROM doc_pages"
_INFERRED = f"SELECT page_id, {_region('url')} AS region, 0 AS view_rank FROM texts WHERE {_region('url')} <> 'ZZ' UNION ALL SELECT page_id, '', 1000 FROM texts"


def _phones_in_text(texts: str, regions: str, out: str, candidates: str | None = None) -> str:
    ctes = _phone_ctes(candidates or f"{_RUNS} UNION ALL {_IDD}", regions)
    return _with("contact_pages", "doc_pages", texts=texts, **ctes) + out


_TEXTS_CONTACT = f"SELECT page_id, {_text('html')} AS text FROM contact_pages"
_TEXTS_DOC = f"SELECT page_id, {_text('html')} AS text FROM doc_pages"
_PER_PHONE = "SELECT phone, count(*) AS n_pages FROM numbers GROUP BY phone"

# In running text and in tel links local numbers are read by slightly different rules.
_TEL_ALL = _TEL.replace("page_id || '/t'", "'c' || page_id || '/t'").replace("AS unit, page_id", "AS unit, 'c' || page_id AS page_id")


def _all_phone_rows() -> dict[str, str]:
    """CTEs ending in ``phone_rows(page_id, phone)`` for both kinds of pages."""
    text = _phone_ctes(f"{_RUNS} UNION ALL {_IDD}", _INFERRED)
    tel = {f"tel_{k}": v for k, v in _phone_ctes(_TEL_ALL, "SELECT * FROM views", in_text=False).items() if k not in ("plan", "views")}
    names = [k[4:] for k in tel]
    for key in tel:
        for name in names:
            for before in ("FROM ", "JOIN "):
                tel[key] = tel[key].replace(f"{before}{name} ", f"{before}tel_{name} ").replace(f"{before}{name}\n", f"{before}tel_{name}\n").replace(f"{before}{name})", f"{before}tel_{name})")
                if tel[key].endswith(f"{before}{name}"):
                    tel[key] = tel[key][: -len(name)] + f"tel_{name}"
    return {**text, **tel, "phone_rows": "SELECT * FROM numbers UNION SELECT * FROM tel_numbers"}


_EMAILS_ALL = _EMAIL_ROWS.replace("m.page_id, p.url", "'c' || m.page_id, p.url")


def _site_contact_ctes() -> dict[str, str]:
    return {
        "texts": _TEXTS_ALL,
        "email_rows": _EMAILS_ALL,
        **_all_phone_rows(),
        "rows": f"SELECT page_id, url, 'email' AS kind, contact FROM email_rows UNION ALL SELECT p.page_id, t.url, 'phone', p.phone FROM phone_rows AS p JOIN texts AS t ON p.page_id = t.page_id",
        "site_contacts": f"SELECT {_key('url')} AS site_key, kind, contact, count(*) AS n_pages FROM rows GROUP BY ALL",
    }


# --- crawl --------------------------------------------------------------------------------------


def _crawl_ctes(depth: int = 2, links: str = "200", seed: str = "r.start_url") -> dict[str, str]:
    score = f"CASE WHEN focused = 'yes' THEN {_score('dst')} ELSE 0 END"
    ctes = {
        "hrefs": _link_rows("linked_pages", "page_id, url, final_url"),
        "edges": f"SELECT page_id, pos, {_resolve('final_url', 'href', False)} AS dst FROM hrefs WHERE {_is_page('href')}",
        "sites": f"""
SELECT r.*, CAST(r.max_pages AS BIGINT) AS budget, p.page_id AS seed_id, coalesce(p.reason, 'not_in_table') AS seed_reason,
       CASE WHEN p.reason = 'ok' THEN p.final_url ELSE {seed} END AS effective_start
FROM requests AS r LEFT JOIN linked_pages AS p ON p.url = {seed}""",
        "wave0": f"SELECT site_id, 0 AS depth, {seed.replace('r.', '')} AS url, seed_id AS page_id, seed_reason AS reason, CAST(1 AS BIGINT) AS fetch_rank, focused, budget, "
        f"{_key('effective_start')} AS base_key, CAST(1 AS BIGINT) AS discovered FROM sites",
    }
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT site_id, url FROM wave{i}" for i in range(d))
        ctes[f"cand{d}"] = f"""
SELECT * FROM (SELECT w.site_id, e.dst, w.fetch_rank AS parent, {score} AS score, e.pos, w.focused, w.budget, w.base_key, w.discovered
FROM wave{d - 1} AS w JOIN edges AS e ON e.page_id = w.page_id
WHERE w.reason = 'ok' AND e.pos < {links} AND {_key('e.dst')} = w.base_key) AS c
WHERE NOT EXISTS (SELECT 1 FROM ({seen}) AS s WHERE s.site_id = c.site_id AND s.url = c.dst)
QUALIFY row_number() OVER (PARTITION BY site_id, dst ORDER BY parent, score, pos) = 1"""
        ctes[f"adm{d}"] = f"SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY parent, score, pos) AS admission FROM cand{d}"
        ctes[f"wave{d}"] = f"""
SELECT a.site_id, {d} AS depth, a.dst AS url, p.page_id, coalesce(p.reason, 'not_in_table') AS reason,
       row_number() OVER (PARTITION BY a.site_id ORDER BY a.score, a.admission) AS fetch_rank, a.focused, a.budget, a.base_key,
       a.discovered + count(*) OVER (PARTITION BY a.site_id) AS discovered
FROM adm{d} AS a LEFT JOIN linked_pages AS p ON p.url = a.dst WHERE a.admission <= a.budget - a.discovered"""
    ctes["visited"] = " UNION ALL ".join(f"SELECT * FROM wave{d}" for d in range(depth + 1))
    ctes["capped"] = " UNION ".join(f"SELECT site_id FROM adm{d} WHERE admission > budget - discovered" for d in range(1, depth + 1))
    ctes["n_hrefs"] = "SELECT page_id, count(*) AS n_links FROM hrefs GROUP BY page_id"
    ctes["done"] = f"""
SELECT v.*, CASE WHEN v.reason = 'ok' AND v.depth < {depth} AND h.n_links > 0 THEN least(h.n_links, {links.replace('w.', 'v.')}) ELSE 0 END AS links_examined
FROM visited AS v LEFT JOIN n_hrefs AS h ON h.page_id = v.page_id"""
    return ctes


def _crawl_contact_ctes() -> dict[str, str]:
    mail = f"SELECT h.page_id, {_mailto('href')} AS candidate FROM hrefs AS h WHERE tag = 'a' AND lower(href) LIKE 'mailto:%'"
    tel = f"SELECT page_id || '/t' || pos AS unit, page_id, {_TEL_RAW} AS raw, true AS whole FROM hrefs WHERE tag = 'a' AND lower(href) LIKE 'tel:%'"
    ctes = {
        **_crawl_ctes(),
        "texts": f"SELECT page_id, {_text('html')} AS text FROM linked_pages",
        "reached": "SELECT site_id, page_id FROM visited WHERE reason = 'ok'",
        "found": f"""
SELECT DISTINCT r.site_id, 'email' AS kind, lower(trim(c.candidate)) AS contact, s.domains
FROM reached AS r JOIN sites AS s ON s.site_id = r.site_id
JOIN ({mail} UNION ALL SELECT page_id, unnest({_email_candidates('text')}) FROM texts) AS c ON c.page_id = r.page_id
WHERE {_valid_email('lower(trim(c.candidate))')}
  AND (s.domains IS NULL OR regexp_matches(lower(trim(c.candidate)), '[@.]example\\.(org|net)$'))""",
        **_phone_ctes(
            f"{_RUNS} UNION ALL {_IDD} UNION ALL {tel}",
            "SELECT r.page_id, v.region, v.view_rank FROM reached AS r JOIN sites AS s ON s.site_id = r.site_id,"
            " (VALUES ('RU', 0), ('US', 1), ('', 1000)) AS v(region, view_rank) WHERE s.regions IS NOT NULL OR v.region = ''",
        ),
        "contacts": "SELECT site_id, kind, contact FROM found UNION SELECT r.site_id, 'phone', n.phone FROM numbers AS n JOIN reached AS r ON r.page_id = n.page_id",
        "lists": "SELECT site_id, coalesce(string_agg(contact, ',' ORDER BY contact) FILTER (kind = 'email'), '') AS emails, coalesce(string_agg(contact, ',' ORDER BY contact) FILTER (kind = 'phone'), '') AS phones,"
        " count(*) FILTER (kind = 'email') AS n_emails, count(*) FILTER (kind = 'phone') AS n_phones FROM contacts GROUP BY site_id",
    }
    return ctes


def _crawl(out: str) -> str:
    return _with("linked_pages", "requests", **_crawl_ctes()) + out


def _crawl_contacts(out: str) -> str:
    return _with("linked_pages", "requests", **_crawl_contact_ctes()) + out


# How many links of a page count for the site of a row ``w``.
_MAX_LINKS = "(SELECT CAST(max_links AS BIGINT) FROM sites AS s WHERE s.site_id = w.site_id)"


def _crawl_odd() -> str:
    """Seeds as callers write them: with a port and a fragment, or not to be followed."""
    usable = "regexp_matches(start_url, '(?i)^ *https?://')"
    ctes = {
        "linked_pages": inline(ODD_PAGES), "asked": inline(ODD_REQUESTS),
        "requests": f"SELECT *, {_normal('trim(start_url)')} AS seed_url FROM asked WHERE {usable}",
        **_crawl_ctes(links=_MAX_LINKS, seed="r.seed_url"),
    }
    return _with(**ctes) + f"""
SELECT d.site_id, CAST(d.depth AS INTEGER) AS depth, d.url, d.page_id, d.reason, d.reason = 'ok' AND p.html IS NOT NULL AS processed, links_examined
FROM done AS d LEFT JOIN linked_pages AS p ON p.page_id = d.page_id
UNION ALL SELECT site_id, NULL, start_url, NULL, 'rejected', NULL, NULL FROM asked WHERE NOT {usable}"""


# Weights as they must be, apart from those the library holds.
_WORD_WEIGHTS = {
    -50: "contact contacts impressum", -40: "support", -25: "help", -20: "about legal privacy", -15: "policy terms", -10: "faq feedback", -5: "company team",
    40: "docs rfc", 30: "spec archive", 20: "doc blog news press media", 10: "release releases changelog events jobs careers",
}
_FILE_WEIGHTS = {
    300: "zip 7z rar tar gz bz2 xz exe msi dmg iso", 250: "pdf", 200: "png jpg jpeg gif webp", 100: "svg ico css js", 80: "json xml rss", 50: "txt md",
}


def _score_all() -> str:
    def weight(value: str, table: dict[int, str]) -> str:
        return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(repr(w) for w in words.split())}) THEN {n}" for n, words in table.items()) + " ELSE 0 END"

    return f"""
WITH scored AS ({inline(SCORED_URLS)}),
parts AS (SELECT *, lower(regexp_extract(url, '^https?://[^/]*([^?]*)', 1)) AS path, lower(regexp_extract(url, '[?](.+)$', 1)) AS query FROM scored),
words AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(path || ' ' || query, '[a-z0-9]+')) AS word FROM parts),
sums AS (SELECT page_id, sum({weight('word', _WORD_WEIGHTS)}) AS total FROM words GROUP BY page_id)
SELECT p.page_id, p.url, CAST(total + len(string_split(path, '/')) - 1 + {weight("regexp_extract(path, '[.]([^.]*)$', 1)", _FILE_WEIGHTS)}
  + CASE WHEN query <> '' THEN 10 ELSE 0 END AS INTEGER) AS score
FROM parts AS p JOIN sums USING (page_id)"""


# The first region that accepts a number decides: 415 is an area code of both.
_ODD_PHONES = f"""
WITH odd AS ({inline(ODD_PHONES)})
SELECT page_id, unnest(CASE page_id % 6 WHEN 0 THEN ['+7953640' || d, '+1212555' || d] WHEN 1 THEN ['+1212555' || d, '+7953640' || d] WHEN 2 THEN ['+1800356' || d]
  WHEN 3 THEN ['+1415555' || d, '+1415556' || d] WHEN 4 THEN ['+7415555' || d, '+7953640' || d] ELSE ['+7953640' || d] END) AS phone FROM odd"""


def _crawl_whole(out: str) -> str:
    """The same without bounds: all that links lead to, as a recursive set."""
    reach = f"""
SELECT site_id, url, base_key FROM wave0
UNION
SELECT r.site_id, e.dst, r.base_key FROM reach AS r JOIN linked_pages AS p ON p.url = r.url JOIN edges AS e ON e.page_id = p.page_id
WHERE p.reason = 'ok' AND e.pos < 200 AND {_key('e.dst')} = r.base_key"""
    more = {
        "reach": reach,
        "arrived": "SELECT r.site_id, r.url, p.page_id, coalesce(p.reason, 'not_in_table') AS reason FROM reach AS r LEFT JOIN linked_pages AS p ON p.url = r.url",
    }
    ctes = {**_crawl_ctes(), **more, **_crawl_contact_ctes(), "reached": "SELECT site_id, page_id FROM arrived WHERE reason = 'ok'"}
    return _with("linked_pages", "requests", **ctes).replace("WITH", "WITH RECURSIVE", 1) + out


# Pages cut at the budget of their site: 1,500 bytes, in the charset the page is stored in.
_CUT_PAGES = f"""
SELECT page_id, url, final_url, reason, CASE WHEN page_id % 20 % 4 <> 2 THEN html WHEN kind = 3 THEN html[1:750] WHEN kind = 2 THEN html[1:1500]
  ELSE list_filter(list_transform(range(400, 1501), lambda k: html[1:k]), lambda s: octet_length(encode(s)) <= 1500)[-1] END AS html
FROM (SELECT *, CASE WHEN page_id % 4 = 2 AND regexp_matches(html, '[^\\x00-\\x7f\\x{{a0}}-\\x{{ff}}]') THEN 0 ELSE page_id % 4 END AS kind
      FROM ({inline(LINKED_PAGES)}) AS l) AS k"""


def _cut_results(out: str) -> str:
    ctes = {"linked_pages": _CUT_PAGES, "requests": inline(REQUESTS), **_crawl_contact_ctes()}
    return _with(**ctes) + out


_SITE_LISTS = "SELECT s.site_id, regexp_extract(s.effective_start, '^(https?://[^/]+)', 1) AS url, CAST(0 AS INTEGER) AS part, coalesce(l.emails, '') AS emails, coalesce(l.phones, '') AS phones FROM sites AS s LEFT JOIN lists AS l ON l.site_id = s.site_id"

_ERRORS = r"""
list_filter([
  CASE WHEN page_id % 4 = 2 THEN 'focused_crawling: invalid boolean value: maybe' END,
  CASE WHEN page_id % 3 = 1 THEN 'max_depth: not a number: deep' WHEN page_id % 60 > 50 THEN 'max_depth must be between 0 and 50' END,
  CASE WHEN page_id NOT BETWEEN 1 AND 5000 THEN 'max_pages must be between 1 and 5000' END,
  CASE WHEN page_id % 5 = 3 THEN 'unsupported option: unknown_field' END], lambda e: e IS NOT NULL)"""

_MASKED = "CASE WHEN length({0}) > 6 THEN {0}[1:3] || '***' || {0}[-2:] ELSE '***' END"


def _masked(value: str) -> str:
    return _MASKED.format(_strip(value))


_STREAM_CONTACTS = _with(
    "contact_pages",
    texts=f"SELECT page_id, url, {_text('html')} AS text FROM contact_pages",
    email_rows=_EMAIL_ROWS,
    **{k: v.replace("'c' || ", "") for k, v in _all_phone_rows().items()},
    rows="SELECT page_id, url, 'email' AS kind, contact FROM email_rows UNION ALL SELECT p.page_id, t.url, 'phone', p.phone FROM phone_rows AS p JOIN texts AS t ON p.page_id = t.page_id",
) + f"SELECT DISTINCT {_key('url')} AS site_key, kind, contact FROM rows"

_ROWS_AND_TIMES = _STREAM_CONTACTS.rsplit("SELECT DISTINCT", 1)[0] + f", arrivals AS ({inline(ARRIVALS)}) "

_REASON = """CASE page_id % 11 WHEN 1 THEN 'http_status' WHEN 2 THEN 'http_status' WHEN 3 THEN 'content_type' WHEN 6 THEN 'request_error'
 WHEN 7 THEN 'url_normalize' WHEN 8 THEN 'future_exception' ELSE 'ok' END"""

ORACLES = {
    "url_normalize": _with("contact_pages") + f"SELECT page_id, {_normal('url')} AS plain, {_normal('url', True)} AS with_query, CAST(NULL AS VARCHAR) AS \"foreign\", {_normal('''regexp_replace(url, '^([a-z]+://[^/]+)/', '\\1:80/')''')} AS with_port FROM contact_pages",
    "url_site_key": _with("contact_pages") + f"SELECT {_key('url')} AS site_key, count(*) AS n_pages FROM contact_pages GROUP BY 1",
    "url_origin": _with("contact_pages") + "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin FROM contact_pages",
    "url_region": _with("contact_pages") + f"SELECT {_region('url')} AS region, count(*) AS n_pages FROM contact_pages GROUP BY 1",
    "href_filter": _with("contact_pages") + f"SELECT tag, {_is_page('href')} AS is_page, count(*) AS n_links FROM ({_link_rows('contact_pages')}) AS l GROUP BY 1, 2",
    "url_resolve": _with("contact_pages", l=_link_rows("contact_pages"), r=f"SELECT page_id, pos, final_url, {_resolve('final_url', 'href')} AS dst_url FROM l WHERE {_is_page('href')}")
    + f"SELECT page_id, pos, dst_url, {_key('dst_url')} = {_key('final_url')} AS same_site FROM r",
    "url_score": _with("linked_pages") + f"SELECT page_id, {_score('url')} AS score FROM linked_pages",
    "url_score_all": _score_all(),
    "response_reason": _with("responses") + f"SELECT {_REASON} AS reason, count(*) AS n_pages FROM responses GROUP BY 1",
    "body_truncate": _with("responses") + f"""
SELECT page_id, md5(CASE WHEN octet_length(encode(html)) <= 2000 THEN html
  WHEN NOT regexp_matches(whole, '.$') OR octet_length(encode(whole)) = 2000 THEN whole ELSE whole || chr(65533) END) AS html_md5
FROM (SELECT page_id, html, list_filter(list_transform(range(500, 2001), lambda k: html[1:k]), lambda s: octet_length(encode(s)) <= 2000)[-1] AS whole
      FROM responses WHERE {_REASON} = 'ok') AS t""",
    "page_text": _with("contact_pages") + f"SELECT page_id, {_text('html')} AS text FROM contact_pages",
    "doc_text": f"SELECT doc_id AS page_id, md5({_strip('text')}) AS text_md5 FROM documents",
    "page_links": _with("contact_pages") + f"SELECT page_id, pos, tag, href FROM ({_link_rows('contact_pages')}) AS l",
    "page_comments": _with("comment_pages") + f"""
SELECT page_id, md5({_text('html')}) AS text_md5, 'after' || page_id || '@mail.example.org' AS emails,
       (SELECT string_agg(href, chr(10) ORDER BY pos) FROM ({_link_rows('comment_pages')}) AS l WHERE l.page_id = comment_pages.page_id AND href <> '') AS hrefs
FROM comment_pages""",
    "anchor_mailto": _with("contact_pages") + f"SELECT page_id, href FROM ({_link_rows('contact_pages')}) AS l WHERE tag = 'a' AND lower(href) LIKE 'mailto:%'",
    "anchor_tel": _with("contact_pages") + f"SELECT page_id, href FROM ({_link_rows('contact_pages')}) AS l WHERE tag = 'a' AND lower(href) LIKE 'tel:%'",
    "html_unescape": _with("contact_pages") + """
SELECT page_id, replace(replace(replace(replace(replace(body, '&#105;', 'i'), '&#111;', 'o'), '&#64;', '@'), '&#97;', 'a'), '&#46;', '.').replace('&#117;', 'u') AS body
FROM (SELECT page_id, regexp_extract(html, '<script>(document[.]get[^<]*)</script>', 1) AS body FROM contact_pages) AS s WHERE body <> ''""",
    "email_text": _with("doc_pages", texts=_TEXTS_DOC) + f"SELECT page_id, unnest({_email_candidates('text')}) AS candidate FROM texts",
    "email_valid": _with("doc_pages", texts=_TEXTS_DOC) + f"SELECT DISTINCT page_id, lower(c) AS email FROM (SELECT page_id, unnest({_email_candidates('text')}) AS c FROM texts) AS t WHERE {_valid_email('lower(c)')}",
    "email_mailto": _with("contact_pages") + _MAILTO,
    "email_cloaked": _with("contact_pages") + f"SELECT page_id, candidate AS email FROM ({_CLOAKED}) AS c",
    "email_all": _with("contact_pages", "doc_pages", texts=_TEXTS_ALL, email_rows=_EMAILS_ALL) + "SELECT contact, count(*) AS n_pages FROM email_rows GROUP BY 1",
    "email_allowlist": _with("contact_pages", "doc_pages", texts=_TEXTS_ALL, email_rows=_EMAILS_ALL) + f"SELECT contact, count(*) AS n_pages FROM email_rows WHERE {_ALLOWED} GROUP BY 1",
    "allowlist_join": _with("contact_pages", "doc_pages", "lists_given", **_site_contact_ctes()).replace(_TEXTS_ALL, f"SELECT 'd' || page_id AS page_id, url, {_text('html')} AS text FROM doc_pages") + """
, listed AS (SELECT DISTINCT site_key, regexp_replace(lower(trim(suffix)), '^@?[.]?', '') AS suffix FROM lists_given),
tried AS (SELECT *, string_split(split_part(contact, '@', 2), '.') AS labels FROM site_contacts WHERE site_key LIKE 'src%' AND kind = 'email'),
ways AS (SELECT t.site_key, t.contact, array_to_string(labels[i:], '.') AS suffix FROM tried AS t, unnest(range(1, len(labels) + 1)) AS u(i))
SELECT site_key, kind, contact, n_pages FROM site_contacts AS c WHERE site_key LIKE 'src%'
  AND (kind = 'phone' OR site_key NOT IN (SELECT site_key FROM listed)
       OR EXISTS (SELECT 1 FROM ways AS w JOIN listed AS l ON l.site_key = w.site_key AND l.suffix = w.suffix WHERE w.site_key = c.site_key AND w.contact = c.contact))""",
    "phone_intl": _phones_in_text(_TEXTS_DOC, _views_of("texts"), "SELECT page_id, phone FROM numbers", _RUNS),
    "phone_idd": _with("contact_pages", "doc_pages", texts=_TEXTS_ALL, **_phone_ctes(_IDD, _views_of("texts"))) + "SELECT CAST(page_id[2:] AS BIGINT) AS page_id, phone FROM numbers",
    "phone_tel": _with("contact_pages", **_phone_ctes(_TEL, _views_of("contact_pages", "RU", "US"), in_text=False)) + "SELECT page_id, phone FROM numbers",
    "phone_regional": _phones_in_text(_TEXTS_CONTACT, _views_of("texts", "RU", "US"), "SELECT page_id, phone FROM numbers"),
    "phone_region_filter": _phones_in_text(_TEXTS_ALL, _INFERRED, _PER_PHONE),
    "phone_all": _with("contact_pages", "doc_pages", texts=_TEXTS_ALL, **_all_phone_rows()) + "SELECT phone AS contact, count(*) AS n_pages FROM phone_rows GROUP BY 1",
    "phone_odd": _ODD_PHONES,
    "phone_plan_join": _with("contact_pages", "doc_pages", texts=_TEXTS_ALL, **_all_phone_rows()) + "SELECT phone AS contact, count(*) AS n_pages FROM phone_rows GROUP BY 1",
    "site_contacts": _with("contact_pages", "doc_pages", **_site_contact_ctes()).replace(_TEXTS_ALL, f"SELECT 'd' || page_id AS page_id, url, {_text('html')} AS text FROM doc_pages") + "SELECT * FROM site_contacts WHERE site_key LIKE 'src%'",
    "contacts_found": _with("contact_pages", "doc_pages", **_site_contact_ctes()) + "SELECT site_key, count(*) FILTER (kind = 'email') AS n_emails, count(*) FILTER (kind = 'phone') AS n_phones FROM site_contacts GROUP BY 1",
    "contacts_estimated": _with("contact_pages", "doc_pages", **_site_contact_ctes()) + "SELECT site_key, count(*) FILTER (kind = 'email') AS n_emails, count(*) FILTER (kind = 'phone') AS n_phones, true AS within, true AS merged_as_whole FROM site_contacts GROUP BY 1",
    "site_lists": _with("contact_pages", "doc_pages", **_site_contact_ctes())
    + "SELECT site_key, CAST(0 AS INTEGER) AS part, coalesce(string_agg(contact, ',' ORDER BY contact) FILTER (kind = 'email'), '') AS emails, coalesce(string_agg(contact, ',' ORDER BY contact) FILTER (kind = 'phone'), '') AS phones FROM site_contacts GROUP BY 1",
    "crawl_reach": _crawl("SELECT site_id, depth, fetch_rank, url, page_id, reason FROM done"),
    "crawl_odd": _crawl_odd(),
    "crawl_whole": _crawl_whole("SELECT site_id, url, page_id, reason FROM arrived"),
    "site_results_whole": _crawl_whole(_SITE_LISTS),
    "crawl_frontier": _crawl("SELECT site_id, depth, count(*) AS n_urls, CAST(sum(links_examined) AS BIGINT) AS links_examined FROM done GROUP BY 1, 2"),
    "crawl_cap": _crawl("SELECT site_id, CASE WHEN site_id IN (SELECT site_id FROM capped) THEN 'max_pages' ELSE 'completed' END AS stop_reason FROM sites"),
    "crawl_counters": _crawl("""
SELECT site_id, count(*) AS scheduled_pages, count(*) FILTER (reason = 'ok') AS fetched_pages, count(*) FILTER (reason <> 'ok') AS failed_pages,
       count(*) FILTER (reason = 'ok') AS processed_pages, CAST(0 AS BIGINT) AS skipped_soup_parse, count(*) AS discovered_urls,
       CAST(sum(links_examined) AS BIGINT) AS links_examined, count(*) - 1 AS links_enqueued, CAST(0 AS BIGINT) AS frontier_remaining,
       CAST(max(depth) AS INTEGER) AS max_depth_reached FROM done GROUP BY 1"""),
    "failure_reasons": _crawl("SELECT site_id, reason, count(*) AS n_pages FROM done WHERE reason <> 'ok' GROUP BY 1, 2"),
    "site_results": _crawl_contacts(
        "SELECT s.site_id, regexp_extract(s.effective_start, '^(https?://[^/]+)', 1) AS url, CAST(0 AS INTEGER) AS part, coalesce(l.emails, '') AS emails, coalesce(l.phones, '') AS phones FROM sites AS s LEFT JOIN lists AS l ON l.site_id = s.site_id"
    ),
    "responses_results": _cut_results(_SITE_LISTS),
    "result_json": _crawl_contacts("""
SELECT s.site_id, '{"site_id":' || s.site_id || ',"url":"' || regexp_extract(s.effective_start, '^(https?://[^/]+)', 1) || '","part":0,"parts":1,"emails":['
         || CASE WHEN coalesce(l.emails, '') = '' THEN '' ELSE '"' || replace(l.emails, ',', '","') || '"' END || '],"phones":['
         || CASE WHEN coalesce(l.phones, '') = '' THEN '' ELSE '"' || replace(l.phones, ',', '","') || '"' END || ']}' AS value
FROM sites AS s LEFT JOIN lists AS l ON l.site_id = s.site_id"""),
    "site_diagnostics": _crawl_contacts("""
SELECT s.site_id, CASE WHEN s.site_id IN (SELECT site_id FROM capped) THEN 'max_pages' ELSE 'completed' END AS stop_reason,
       c.fetched_pages, CAST(s.budget AS INTEGER) AS max_pages, coalesce(f.failure_reasons, '') AS failure_reasons,
       coalesce(l.n_emails, 0) AS emails, coalesce(l.n_phones, 0) AS phones
FROM sites AS s JOIN (SELECT site_id, count(*) FILTER (reason = 'ok') AS fetched_pages FROM done GROUP BY 1) AS c ON c.site_id = s.site_id
LEFT JOIN (SELECT site_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS failure_reasons FROM (SELECT site_id, reason, count(*) AS n FROM done WHERE reason <> 'ok' GROUP BY 1, 2) AS r GROUP BY 1) AS f ON f.site_id = s.site_id
LEFT JOIN lists AS l ON l.site_id = s.site_id"""),
    "options_validate": f"SELECT page_id, array_to_string({_ERRORS}, '; ') AS errors FROM pages",
    "options_typed": f"SELECT page_id, CAST(page_id AS INTEGER) AS max_pages, CAST(page_id % 60 AS INTEGER) AS max_depth, true AS focused_crawling, 'RU,BY' AS phone_regions, false AS include_query, CAST(200 AS INTEGER) AS max_links_per_page FROM pages WHERE len({_ERRORS}) = 0",
    "options_merge": """
SELECT page_id, 'focused_crawling,' || CASE WHEN page_id % 5 = 3 THEN '' ELSE 'log_level,' END || 'max_depth,max_pages,phone_regions,retry_total' AS names,
       CAST(page_id AS VARCHAR) AS max_pages, '4' AS retry_total FROM pages""",
    "options_file": """
SELECT page_id, CAST(least(count(*) OVER (), 5000) AS INTEGER) AS max_pages, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 50 ELSE 0 END AS INTEGER) AS max_depth,
       page_id % 2 = 0 AS focused_crawling, 'RU,BY' AS regions FROM pages""",
    "mask_map": f"SELECT doc_id, {_masked('text')} AS api_key, {_masked('lang')} AS token, source FROM documents",
    "scan_reasons": """
SELECT reason, count(*) AS n_pages, count(*) AS n_final
FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'http_404' WHEN page_id % 7 = 0 THEN 'network_error' ELSE 'ok' END AS reason FROM pages) AS p GROUP BY reason""",
    "body_decode": "SELECT doc_id, md5(text) AS digest FROM documents",
    "mask_types": f"""
SELECT doc_id, {_masked('CAST(doc_id + 1000000 AS VARCHAR)')} AS token, CAST(n_chars AS VARCHAR) AS n,
       {_masked("('[\"' || source || '\",\"' || lang || '\"]')")} AS cookie, '["' || lang || '"]' AS tags, {_masked('source')} AS password, lang AS open
FROM documents""",
    "option_lists": """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'RU,DE' ELSE 'BY,DE' END AS regions,
       'site' || page_id || '.org,b.com' AS domains, CAST(200 AS INTEGER) AS max_pages FROM pages""",
    "log_tail": _with("crawl_log") + "SELECT id, level, logger, message FROM crawl_log WHERE id > 100 ORDER BY id LIMIT 1000",
    "log_latest": _with("crawl_log") + "SELECT id, level, logger, message FROM crawl_log ORDER BY id DESC LIMIT 3000",
    "stream_pages_dedupe": _with("contact_pages") + f"SELECT min(page_id) AS page_id, {_normal('url', True)} AS url, {_key('url')} AS site_key FROM contact_pages GROUP BY 2, 3",
    "stream_contacts": _STREAM_CONTACTS,
    "stream_site_contacts": _STREAM_CONTACTS,
    "stream_batches": _STREAM_CONTACTS,
    "stream_contact_counts": _ROWS_AND_TIMES + f"""
SELECT {_key('url')} AS site_key, kind, contact, count(*) AS n_pages, min(crawled_s) AS first_seen, max(crawled_s) AS last_seen
FROM rows JOIN arrivals AS a ON a.page_id = rows.page_id GROUP BY 1, 2, 3""",
    "stream_late": _with("arrivals") + f"""
, newest AS (SELECT slot, max(max(crawled_s)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM arrivals GROUP BY slot),
timed AS (SELECT a.page_id, crawled_s, coalesce(crawled_s < newest - 7200, false) AS late FROM arrivals AS a JOIN newest AS n ON n.slot = a.slot)
SELECT crawled_s - crawled_s % 3600 AS hour, {_REASON} AS reason, count(*) FILTER (NOT late) AS n_kept, count(*) FILTER (late) AS n_late FROM timed GROUP BY 1, 2""",
    "stream_failures": f"SELECT CAST(1704067200 + (page_id // 60) * 3600 AS BIGINT) AS window_start, {_REASON} AS reason, count(*) AS n_pages FROM pages WHERE {_REASON} <> 'ok' GROUP BY 1, 2",
}
