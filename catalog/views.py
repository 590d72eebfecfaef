"""Views the queries and their oracles share, in SQL both engines read the same way.

Each view maps whole tables row by row (``requests`` aggregates them), so
it grows with the given data. The data has no mailto, tel or <area>, and no link that leads
to a stored page; the views add such markup, with its form chosen by the row's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# One document a page; text escaped the way a page would write it.
DOC_PAGES = """
SELECT doc_id AS page_id,
       'https://' || source || '.example.com/doc/' || CAST(doc_id AS STRING) AS url,
       'https://' || source || '.example.com/doc/' || CAST(doc_id AS STRING) AS final_url,
       '<html><body><p>' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p></body></html>' AS html
FROM {documents}
"""

_TLD = """CASE page_id % 5 WHEN 0 THEN 'com' WHEN 1 THEN 'ru' WHEN 2 THEN 'de' WHEN 3 THEN 'uk' ELSE 'us' END"""

# Links of every kind a page may carry, one kind a page.
_CONTACT_BLOCK = """CASE page_id % 7
  WHEN 0 THEN '<a href="mailto:info' || n || '@example.com">mail</a>'
  WHEN 1 THEN '<a href="mailto:Sales%40shop' || n || '.example.org?subject=Hi">mail</a><a href="mailto:bad%26shop.example.org">x</a>'
  WHEN 2 THEN '<a class="m" href="MAILTO: a' || n || '@mail.example.com,b@mail.example.com">two</a><a href="mailto:x+y%zz@b..com">x</a>'
  WHEN 3 THEN '<a href="tel:+1 (415) 555-' || lpad(n, 4, '0') || '">call</a><a href="tel:+7%20(800)%20555-35-35;ext=1">call</a>'
  WHEN 4 THEN '<a href="tel:00 1 212 555 ' || lpad(n, 4, '0') || '">idd</a><a href="tel:8 (953) 640-' || substr(lpad(n, 4, '0'), 1, 2) || '-' || substr(lpad(n, 4, '0'), 3, 2) || '">local</a>'
  WHEN 5 THEN '<map><area href=" /map/contact-' || n || '.html#x "></map><p>IDD: 00 7 953 640-53-' || substr(lpad(n, 4, '0'), 3, 2) || '</p><p>tel: 8 (800) 555-' || substr(lpad(n, 4, '0'), 1, 2) || '-' || substr(lpad(n, 4, '0'), 3, 2) || '</p>'
  ELSE '<script>document.getElementById("cloak' || n || '").innerHTML = "";var addy' || n || ' = "&#111;ff&#105;ce" + "&#64;";addy' || n || ' = addy' || n || ' + "pl&#97;nt' || n || '" + "&#46;" + "example.&#111;rg";</script>'
END"""

CONTACT_PAGES = f"""
SELECT page_id, replace(url, '.example.@', '.example.' || tld) AS url,
       replace(url, '.example.@', '.example.' || tld) AS final_url, html || block AS html
FROM (SELECT page_id, html, {_TLD} AS tld, {_CONTACT_BLOCK} AS block,
             replace(replace(replace(url, '.example.com', '.example.@'), '.example.net', '.example.@'), '.example.org', '.example.@') AS url
      FROM (SELECT *, CAST(page_id % 10000 AS STRING) AS n FROM {{pages}}) AS numbered) AS marked
"""

# Stored answers of every outcome.
RESPONSES = f"""
SELECT page_id, url,
       CASE WHEN page_id % 11 = 7 THEN 'ftp://mirror.example.org/' ELSE url END AS final_url,
       CASE page_id % 11 WHEN 1 THEN 404 WHEN 2 THEN 503 ELSE 200 END AS status,
       CASE page_id % 11 WHEN 3 THEN 'application/pdf' WHEN 4 THEN '' WHEN 5 THEN 'text/plain; charset=utf-8'
                         WHEN 8 THEN 'text/html; charset=x-none' ELSE 'text/html; charset=UTF-8' END AS content_type,
       CASE WHEN page_id % 11 = 6 THEN 'timeout' END AS error, html
FROM ({CONTACT_PAGES}) AS contact_pages
"""


def _linked_path(page: str) -> str:
    """Path of a page of the linked sites, from an expression for its id."""
    name = f"CAST({page} AS STRING)"
    return (
        f"CASE ({page}) % 4 WHEN 0 THEN '/contact/p' || {name} WHEN 1 THEN '/docs/p' || {name}"
        f" WHEN 2 THEN '/p' || {name} ELSE '/about/p' || {name} || '.html' END"
    )


# Twenty sites that grow with the table; page r of a site links to its pages 2r+1, 2r+2, r/2.
LINKED_PAGES = f"""
SELECT page_id, 'http://' || host || {_linked_path('page_id')} AS url,
       'http://' || CASE WHEN page_id % 31 = 29 THEN 'www.' ELSE '' END || host || {_linked_path('page_id')} AS final_url,
       CASE WHEN page_id % 17 = 9 THEN 'http_status' ELSE 'ok' END AS reason,
       html || '<ul><li><a href="' || {_linked_path('left_id')} || '">l</a></li><li><a href="' || {_linked_path('right_id')}
         || '">r</a></li><li><a href="http://' || host || {_linked_path('up_id')} || '#top">u</a></li>'
         || CASE WHEN page_id % 3 = 0 THEN '<li><a href="' || {_linked_path('left_id')} || '">again</a></li>' ELSE '' END
         || '<li><a href="mailto:p' || CAST(page_id AS STRING) || '@' || host || '">m</a></li>'
         || '<li><a href="tel:+1 415 555 ' || lpad(CAST(page_id % 10000 AS STRING), 4, '0') || '">t</a></li></ul>' AS html
FROM (SELECT page_id, html, 'site' || CAST(page_id % 20 AS STRING) || '.example.com' AS host,
             2 * page_id + 20 - page_id % 20 AS left_id, 2 * page_id + 40 - page_id % 20 AS right_id,
             CAST(floor(floor(page_id / 20) / 2) AS BIGINT) * 20 + page_id % 20 AS up_id
      FROM {{pages}}) AS ids
"""

# One request a linked site, starting at its first page.
REQUESTS = f"""
SELECT site_id, 'http://site' || CAST(site_id AS STRING) || '.example.com' || {_linked_path('first_page')} AS start_url,
       CASE WHEN site_id % 3 = 0 THEN '5' ELSE '200' END AS max_pages,
       CASE WHEN site_id % 2 = 0 THEN 'yes' ELSE 'off' END AS focused,
       CASE WHEN site_id % 4 = 1 THEN 'RU; us' END AS regions,
       CASE WHEN site_id % 5 = 2 THEN 'example.org,@Example.Net' END AS domains
FROM (SELECT page_id % 20 AS site_id, min(page_id) AS first_page FROM {{pages}} GROUP BY page_id % 20) AS firsts
"""

# The linked sites once more, in odd circumstances: the links to stored pages stand first; pages without HTML;
# every fifth site has moved to another host, of which only its first page knows the old name.
_MOVED = "CASE WHEN site_id % 5 = 1 THEN 'moved' || CAST(site_id AS STRING) || '.example.org' ELSE host END"
ODD_PAGES = f"""
SELECT page_id, 'http://' || CASE WHEN page_id < 40 THEN host ELSE {_MOVED} END || {_linked_path('page_id')} AS url,
       'http://' || {_MOVED} || {_linked_path('page_id')} AS final_url,
       CASE WHEN page_id % 17 = 9 THEN 'http_status' ELSE 'ok' END AS reason,
       CASE WHEN page_id % 23 <> 7 THEN '<ul><li><a href="' || {_linked_path('left_id')} || '">l</a></li><li><a href="' || {_linked_path('right_id')}
         || '">r</a></li><li><a href="http://' || host || {_linked_path('up_id')} || '#top">u</a></li></ul>' || html END AS html
FROM (SELECT page_id, html, page_id % 20 AS site_id, 'site' || CAST(page_id % 20 AS STRING) || '.example.com' AS host,
             2 * page_id + 20 - page_id % 20 AS left_id, 2 * page_id + 40 - page_id % 20 AS right_id,
             CAST(floor(floor(page_id / 20) / 2) AS BIGINT) * 20 + page_id % 20 AS up_id
      FROM {{pages}}) AS ids
"""

# Requests for them: some can't be URLs, some follow two links a page only.
ODD_REQUESTS = f"""
SELECT site_id, CASE site_id % 6 WHEN 5 THEN 'no url' WHEN 4 THEN 'ftp://site' || CAST(site_id AS STRING) || '.example.com/'
         ELSE ' HTTP://site' || CAST(site_id AS STRING) || '.example.com:80' || {_linked_path('first_page')} || '#x' END AS start_url,
       '200' AS max_pages, 'off' AS focused, CASE WHEN site_id % 4 = 3 THEN '1' WHEN site_id % 4 = 2 THEN '2' ELSE '200' END AS max_links
FROM (SELECT page_id % 20 AS site_id, min(page_id) AS first_page FROM {{pages}} GROUP BY page_id % 20) AS firsts
"""

# URLs of all words and extensions that have a weight, and of some that have none, in path and query.
SCORED_WORDS = (
    "contact contacts support help about impressum legal privacy policy terms faq feedback company team docs doc spec rfc archive blog news press "
    "media release releases changelog events jobs careers Contact products x1"
)
SCORED_EXTENSIONS = (
    "pdf zip 7z rar tar gz bz2 xz exe msi dmg iso png jpg jpeg gif webp svg ico css js json xml txt md rss html PDF php"
)


def _choice(words: str, number: str) -> str:
    return f"CASE ({number}) % {len(words.split())} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words.split())) + " END"


SCORED_URLS = f"""
SELECT page_id, n, 'http://a.example.com/' || {_choice(SCORED_WORDS, 'n')} || CASE WHEN n % 2 = 0 THEN '/in' ELSE '' END || '/' || {_choice(SCORED_WORDS, 'n * 7 + 3')}
         || '.' || {_choice(SCORED_EXTENSIONS, 'n')} || CASE WHEN n % 3 = 0 THEN '' WHEN n % 3 = 1 THEN '?q=' || {_choice(SCORED_WORDS, 'n * 5 + 1')} ELSE '?' END AS url
FROM (SELECT page_id, page_id + floor(page_id / 31) AS n FROM {{pages}}) AS numbered
"""

# Numbers of two regions in one run, spelled-out numbers and extensions.
ODD_PHONES = """
SELECT page_id, url, d, CASE page_id % 6
  WHEN 0 THEN '<p>8 (953) 640-' || substr(d, 1, 2) || '-' || substr(d, 3, 2) || ' / (212) 555-' || d || '</p>'
  WHEN 1 THEN '<p>Call (212) 555-' || d || ', 8 (953) 640-' || substr(d, 1, 2) || '-' || substr(d, 3, 2) || '!</p>'
  WHEN 2 THEN '<a href="tel:1-800-FLO-' || d || '">a</a><a href="tel:1-8-FLOWER-' || d || '">too long</a>'
  WHEN 3 THEN '<a href="tel:+1-415-555-' || d || 'x123">a</a><p>+1 415 556 ' || d || ' ext. 77</p>'
  WHEN 4 THEN '<p>(415) 555-' || d || ' (953) 640-' || d || '</p>'
  ELSE '<a href="tel:+7%20953%20640%20' || d || '%20ext%2E%209">a</a><p>A9536401234 and 2125551234%</p>' END AS html
FROM (SELECT page_id, url, lpad(CAST(page_id % 10000 AS STRING), 4, '0') AS d FROM {pages}) AS numbered
"""

# Comments that end abruptly, or open and close in one, with markup after them.
COMMENT_PAGES = f"""
SELECT page_id, url, final_url,
       html || CASE page_id % 4 WHEN 0 THEN '<!-->' WHEN 1 THEN '<!--->' WHEN 2 THEN '<!-- <a href="/no">no@example.org</a> --!>' ELSE '<!---->' END
         || '<p>After' || CAST(page_id AS STRING) || '@mail.example.org</p><a href="/after-' || CAST(page_id AS STRING) || '">x</a>' AS html
FROM ({CONTACT_PAGES}) AS contact_pages
"""

# When each page was crawled and in which of twelve files it comes; every 13th comes some hours late.
ARRIVALS = """
SELECT page_id, page_id % 12 AS slot,
       1704067200 + (page_id % 12) * 3600 + (page_id % 60) * 60 - CASE WHEN page_id % 13 = 5 THEN 18000 ELSE 0 END AS crawled_s
FROM {pages}
"""

# Thousands of listed domains for every site but one in five; some are those of real addresses.
ALLOWED = f"""
SELECT s.site_key, CASE d.n % 3 WHEN 0 THEN ' @Mail' WHEN 1 THEN '.mail' ELSE 'shop' END || CAST(d.n AS STRING) || '.example.' || CASE d.n % 2 WHEN 0 THEN 'com' ELSE 'ORG' END AS suffix
FROM (SELECT source || '.example.com' AS site_key, min(doc_id) AS first_id FROM {{documents}} GROUP BY source) AS s
JOIN (SELECT DISTINCT doc_id % 5000 AS n FROM {{documents}}) AS d ON s.first_id % 5 <> 4
"""

CRAWL_LOG = """
SELECT event_id AS id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
       'crawler.' || event_type AS logger, props AS message
FROM {events}
"""

TABLES = ("pages", "documents", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables its text names."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def inline(sql: str) -> str:
    """The same view as a sub-query over tables registered under their own names."""
    return sql.format(**{name: name for name in TABLES})
