"""Walk the stored link graph, site by site, within page and depth budgets.

The crawl is a loop of waves, one per link depth, over three narrow tables written once:

* ``sites``  one row a valid request, with its seed page and base site key;
* ``index``  (include_query, url) -> page; copies of a URL are combined map-side;
* ``facts``  page -> outcome and links.

Contacts are read afterwards, in a second scan pruned to the visited pages.

A wave joins its frontier, which the page budget bounds, with ``facts`` by page and with
``index`` by URL. Both are written in buckets of these keys, so a wave shuffles its frontier and
never the tables. Neither key is the site, so a site with a third of all pages is spread like
any other. Ranking inside a site has two levels: the candidates of a site are dealt over ``PARTS``
parts by URL, each part passes on at most the site's page budget, and those heads are ranked.
Every wave is written to the shared folder, so plans stay short and finished work survives lost
executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import NUMBERING_PLAN, Region
from ..functions.phones import effective_regions
from ..functions.scoring import url_priority_score
from ..functions.urls import drop_query, is_page_href, normalize_url, normalized_site_key, origin, resolve_href
from ..operators.contacts import contact_rows, no_strings, page_candidates, page_projections, read_candidates
from ..operators.responses import OK, URL_NORMALIZE, pages_of_responses, with_body_budgets
from ..sources.workspace import Workspace, keep_matching

NOT_IN_TABLE = "not_in_table"
COMPLETED, MAX_PAGES = "completed", "max_pages"
PARTS = 64  # over which the candidates of one site are ranked first

_SITE_OPTIONS = (
    "max_pages", "max_depth", "max_links_per_page", "include_query", "focused_crawling",
)


class Crawl(NamedTuple):
    """Tables of a finished crawl."""

    rejected: DataFrame  # requests without a usable start URL
    sites: DataFrame  # one row a crawled site, with options, base key, regions
    visited: DataFrame  # site_id, depth, fetch_rank, url, page_id, reason, parsed, links_examined
    capped: DataFrame  # site_id of sites which the page budget cut short
    contacts: DataFrame  # site_id, kind, contact: distinct


def _reason(pages: DataFrame) -> Column:
    """Stored outcome of a page; a final URL that can't be normalised makes it a failure."""
    reason = F.col("reason") if "reason" in pages.columns else F.lit(OK)
    unusable = (reason == OK) & normalize_url("final_url").isNull()
    return F.when(unusable, F.lit(URL_NORMALIZE)).otherwise(reason).alias("reason")


def _narrow(pages: DataFrame) -> DataFrame:
    """The columns crawling needs without reading any HTML; pages without a usable URL are out."""
    return pages.select(
        "page_id", "final_url", _reason(pages), normalize_url("url", True).alias("url_q")
    ).where(F.col("url_q").isNotNull())


def _own_form(url_q: Column, include_query: Column) -> Column:
    """A URL normalised with its query, in the form a site compares by."""
    return F.when(include_query, url_q).otherwise(drop_query(url_q))


def _keyed(narrow: DataFrame, forms: list[bool]) -> DataFrame:
    """Pages under the URL forms in use: without query, with query, or both."""
    structs = [
        F.struct(F.lit(form).alias("include_query"), (F.col("url_q") if form else drop_query("url_q")).alias("url"))
        for form in forms
    ]
    keyed = narrow.withColumn("key", F.explode(F.array(*structs))).drop("url_q")
    return keyed.select("*", "key.include_query", "key.url").drop("key")


def _seed_pages(pages: DataFrame, requests: DataFrame, forms: list[bool]) -> DataFrame:
    """Requests with their seed page (the one of least id among copies), base key and regions.

    Few seeds prune the scan; copies of a page are combined map-side before the join.
    """
    found = (
        keep_matching(_keyed(_narrow(pages), forms), requests.select(F.col("start").alias("url")), "url")
        .groupBy("include_query", "url")
        .agg(F.min(F.struct("page_id", "final_url", "reason")).alias("seed"))
        .withColumnRenamed("url", "start")
    )
    joined = requests.join(found, ["include_query", "start"], "left")
    usable = F.col("seed.reason") == OK
    final = F.when(usable, normalize_url(F.col("seed.final_url"), F.col("include_query")))
    return (
        joined.withColumn("effective_start", F.coalesce(final, F.col("start")))
        .withColumn("base_key", normalized_site_key("effective_start"))
        .withColumn("regions", effective_regions("phone_regions", "effective_start"))
        .withColumn("seed_page_id", F.col("seed.page_id"))
        .drop("seed")
    )


def _relevant(pages: DataFrame, sites: DataFrame, work: Workspace, deep: bool) -> DataFrame:
    """Pages some site can reach: those of its base host, and the seed pages themselves."""
    if not deep:
        ids = work.write(
            sites.where(F.col("seed_page_id").isNotNull()).select(F.col("seed_page_id").alias("page_id")).distinct(),
            "seed_ids",
        )
        return keep_matching(pages, ids, "page_id")
    keys = work.write(
        sites.select(F.explode(F.array("base_key", normalized_site_key("start"))).alias("page_key")).distinct(), "site_keys"
    )
    keyed = pages.withColumn("page_key", normalized_site_key(normalize_url("url")))
    return keep_matching(keyed, keys, "page_key").drop("page_key")


def _index(pages: DataFrame, forms: list[bool]) -> DataFrame:
    """(include_query, url) -> page of least id; copies of a URL meet in the partial aggregate."""
    return (
        _keyed(_narrow(pages).drop("final_url", "reason"), forms)
        .groupBy("include_query", "url")
        .agg(F.min("page_id").alias("page_id"))
    )


def _facts(pages: DataFrame) -> DataFrame:
    """Outcome and links per page; neither its text nor its contacts are read here.

    Of the links only those to the page's own or final host can be followed; their number
    before that filter is kept. ``pos`` is the place among all links of the page.
    """
    projected = page_projections(
        pages.select("page_id", "url", normalize_url("final_url", True).alias("final_url"), _reason(pages), "html")
    )
    own = F.array_compact(F.array(normalized_site_key(normalize_url("url")), normalized_site_key("final_url")))
    positioned = F.transform(
        "links",
        lambda link, i: F.struct(
            i.alias("pos"), F.when(is_page_href(link["href"]), resolve_href(F.col("final_url"), link["href"], True)).alias("url")
        ),
    )
    staged = projected.select(
        "page_id", "reason", "parsed", F.size("links").alias("n_links"),
        own.alias("own"), positioned.alias("targets"),
    )
    keyed = F.transform(
        "targets", lambda t: F.struct(t["pos"].alias("pos"), t["url"].alias("url"), normalized_site_key(t["url"]).alias("key"))
    )
    return staged.select(
        "page_id", "reason", "parsed", "n_links",
        F.filter(keyed, lambda t: t["url"].isNotNull() & F.array_contains(F.col("own"), t["key"])).alias("targets"),
    )


def _place(fetch_rank: Column, score: Column, pos: Column) -> Column:
    """(parent's fetch order, score, place on the page) as one sortable number.

    A page budget is at most 5,000, scores stay within a thousand of zero, and no page has 16
    million links; a number, unlike a struct, can be combined in a hash aggregate.
    """
    return (
        F.shiftleft(fetch_rank.cast("bigint"), 40)
        + F.shiftleft((score + 32768).cast("bigint"), 24)
        + pos.cast("bigint")
    )


def _score_of(place: Column) -> Column:
    return F.shiftright(place, 24).bitwiseAND(F.lit(0xFFFF)) - 32768


def _expand(frontier: DataFrame, facts: DataFrame, visited: DataFrame) -> DataFrame:
    """New URLs of the pages of a wave, each with the place that decides its admission."""
    # The budget bounds the frontier; the optimizer sees its size and picks the join.
    parents = frontier.where(F.col("depth") < F.col("max_depth"))
    readable = facts.where(F.col("parsed") & (F.col("reason") == OK))
    links = (
        parents.join(readable.select("page_id", "targets"), "page_id")
        .select(
            "site_id", "depth", "fetch_rank", "base_key", "discovered", *_SITE_OPTIONS,
            F.explode("targets").alias("t"),
        )
        .where((F.col("t.pos") < F.col("max_links_per_page")) & (F.col("t.key") == F.col("base_key")))
        .withColumn("url", _own_form(F.col("t.url"), F.col("include_query")))
    )
    scored = links.withColumn(
        "score", F.when(F.col("focused_crawling"), url_priority_score("url")).otherwise(F.lit(0))
    )
    # One row a new URL, at its first place. The other columns are the same for a whole site.
    once = scored.groupBy("site_id", "url").agg(
        F.min(_place(F.col("fetch_rank"), F.col("score"), F.col("t.pos"))).alias("place"),
        *[F.first(name).alias(name) for name in ("depth", "discovered", *_SITE_OPTIONS)],
    )
    return once.join(visited.select("site_id", "url"), ["site_id", "url"], "left_anti")


def _heads(candidates: DataFrame, bound: int, parts: int = PARTS) -> DataFrame:
    """The first ``bound`` candidates of every part of a site; the first ``bound`` of the site are among them.

    The literal bound lets the window drop rows before the shuffle, which deals them by part.
    """
    part = F.pmod(F.xxhash64("url"), F.lit(parts))
    by_part = Window.partitionBy("site_id", "part").orderBy("place", "url")
    ranked = candidates.withColumn("part", part).withColumn("head", F.row_number().over(by_part))
    return ranked.where(F.col("head") <= bound).drop("part", "head")


def _admit(candidates: DataFrame, page_budget: int) -> DataFrame:
    """Admit candidates in order until a site's page budget is used up; rank them for fetching.

    One row past the budget is kept as the mark of a site that was cut short. However many
    candidates a site has, the task that ranks it gets its heads only: at most ``PARTS`` budgets.
    """
    by_place = Window.partitionBy("site_id").orderBy("place", "url")
    ranked = _heads(candidates, page_budget + 1).withColumn("admission", F.row_number().over(by_place)).where(
        F.col("admission") <= page_budget + 1
    )
    room = F.col("max_pages") - F.col("discovered")
    kept = ranked.where(F.col("admission") <= F.greatest(room, F.lit(0)) + 1).withColumn(
        "admitted", F.col("admission") <= room
    )
    by_score = Window.partitionBy("site_id").orderBy(F.desc("admitted"), _score_of(F.col("place")), "admission")
    whole_site = Window.partitionBy("site_id")
    return kept.select(
        "site_id",
        (F.col("depth") + 1).alias("depth"),
        "url",
        "admitted",
        F.row_number().over(by_score).cast("bigint").alias("fetch_rank"),
        # Only links to the base host are followed, so every admitted URL has its key.
        normalized_site_key("url").alias("base_key"),
        (F.col("discovered") + F.count_if("admitted").over(whole_site)).alias("discovered"),
        *_SITE_OPTIONS,
    )


def _fetch(admitted: DataFrame, index: DataFrame) -> DataFrame:
    """Find the page of each admitted URL; a URL outside the table has none."""
    return admitted.join(index, ["include_query", "url"], "left")


def crawl(
    pages: DataFrame,
    requests: DataFrame,
    plan: Sequence[Region] = NUMBERING_PLAN,
) -> Crawl:
    """Crawl every requested site of a page table.

    ``pages``: page_id (unique), url, final_url, html and, optionally, reason.
    ``requests``: site_id (unique), start_url and typed option columns (``site_options``).
    """
    spark = pages.sparkSession
    work = Workspace(spark, "crawl")
    started = requests.withColumn("start", normalize_url("start_url", F.col("include_query")))
    rejected = started.where(F.col("start").isNull()).select("site_id", "start_url")
    starts = work.write(started.where(F.col("start").isNotNull()), "requests")

    # One small row: the bounds of the loop and the URL forms in use.
    bounds = starts.agg(
        F.max("max_depth").alias("depth"), F.max("max_pages").alias("pages"),
        F.collect_set("include_query").alias("forms"),
    ).first()
    max_depth, page_budget = bounds["depth"] or 0, bounds["pages"] or 1
    forms = sorted(bounds["forms"]) or [False]
    sites = work.write(_seed_pages(pages, starts, forms), "sites")
    deep = max_depth > 0

    relevant = _relevant(pages, sites, work, deep)
    facts = work.write_buckets(_facts(relevant), "facts", ["page_id"])

    seeds = sites.select(
        "site_id", F.lit(0).alias("depth"), F.col("start").alias("url"), F.lit(True).alias("admitted"),
        F.lit(1).cast("bigint").alias("fetch_rank"), "base_key", F.lit(1).cast("bigint").alias("discovered"),
        *_SITE_OPTIONS, F.col("seed_page_id").alias("page_id"),
    )
    wave = work.write(seeds, "wave-0")
    names = ["wave-0"]
    if deep:
        index = work.write_buckets(_index(relevant, forms), "index", ["include_query", "url"])
        for depth in range(1, max_depth + 1):
            visited = work.read(names, wave).where("admitted")
            candidates = _expand(wave.where("admitted"), facts, visited)
            admitted = work.write(_admit(candidates, page_budget), f"admitted-{depth}")
            wave = work.write(_fetch(admitted, index).select(*wave.columns), f"wave-{depth}")
            names.append(f"wave-{depth}")
            if wave.where("admitted").isEmpty():
                break

    everything = work.read(names, wave)
    visited = everything.where("admitted").drop("admitted", "discovered", "base_key")
    capped = everything.where(~F.col("admitted")).select("site_id").distinct()

    # URLs outside the table have no page; as NULL keys of a join they would all meet in one task.
    of_pages = visited.where(F.col("page_id").isNotNull())
    ids = work.write(of_pages.select("page_id").distinct(), "visited_ids")
    seen = page_candidates(keep_matching(pages, ids, "page_id").select("page_id", "final_url", "html"))
    candidates = work.write(seen.select("page_id", "emails", "runs", "dialled", "tel"), "candidates")
    stored = of_pages.join(facts.select("page_id", "reason", "parsed", "n_links"), "page_id", "left").join(candidates, "page_id", "left")
    missing = visited.where(F.col("page_id").isNull())
    fetched = stored.unionByName(missing, allowMissingColumns=True).join(
        sites.select("site_id", "regions", "email_domain_allowlist"), "site_id"
    )
    reason = F.coalesce("reason", F.lit(NOT_IN_TABLE))
    processed = (reason == OK) & F.coalesce("parsed", F.lit(False))
    follows = processed & (F.col("depth") < F.col("max_depth"))
    read = read_candidates(
        fetched.select(
            "site_id", "depth", "fetch_rank", "url", "page_id", reason.alias("reason"),
            processed.alias("processed"),
            F.when(follows, F.least("n_links", "max_links_per_page")).otherwise(F.lit(0)).alias("links_examined"),
            F.when(processed, F.col("emails")).alias("emails"),
            F.when(processed, F.col("runs")).otherwise(no_strings()).alias("runs"),
            F.when(processed, F.col("dialled")).otherwise(no_strings()).alias("dialled"),
            F.when(processed, F.col("tel")).otherwise(no_strings()).alias("tel"),
            "regions", "email_domain_allowlist",
        ),
        regions="regions",
        plan=plan,
    )
    done = work.write(read.drop("regions", "email_domain_allowlist"), "visited")
    work.forget()  # what is returned reads plain written tables
    contacts = contact_rows(done.select("site_id", "emails", "phones")).distinct()
    return Crawl(rejected, sites, done.drop("emails", "phones"), capped, contacts)


def crawl_responses(responses: DataFrame, requests: DataFrame, plan: Sequence[Region] = NUMBERING_PLAN, wide: bool = True) -> Crawl:
    """Crawl stored responses: bodies are cut at the budget of their site, then decoded where a page is read."""
    pages = pages_of_responses(with_body_budgets(responses, requests), F.col("max_body_bytes"), wide)
    return crawl(pages.drop("max_body_bytes"), requests, plan)


def site_origin(sites: DataFrame) -> DataFrame:
    """site_id and the origin shown in results: that of the seed's final URL."""
    return sites.select("site_id", origin("effective_start").alias("url"))
