"""Results of a crawl: contacts and diagnostics, one row a site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contacts import contact_lists, contacts_found, no_strings
from ..operators.responses import OK
from .crawl import COMPLETED, MAX_PAGES, Crawl, site_origin

COUNTERS = (
    "scheduled_pages", "fetched_pages", "failed_pages", "processed_pages", "skipped_soup_parse",
    "discovered_urls", "links_examined", "links_enqueued", "frontier_remaining", "max_depth_reached",
)


def crawl_counters(crawl: Crawl) -> DataFrame:
    """Counters of each site, from one aggregation of the visited pages."""
    fetched = F.col("reason") == OK
    visited = F.count(F.lit(1))
    return crawl.visited.groupBy("site_id").agg(
        visited.alias("scheduled_pages"),
        F.count_if(fetched).alias("fetched_pages"),
        F.count_if(~fetched).alias("failed_pages"),
        F.count_if("processed").alias("processed_pages"),
        F.count_if(fetched & ~F.col("processed")).alias("skipped_soup_parse"),
        visited.alias("discovered_urls"),
        F.sum("links_examined").alias("links_examined"),
        (visited - 1).alias("links_enqueued"),
        # A wave fetches all it admitted, so nothing is ever left over.
        F.lit(0).cast("bigint").alias("frontier_remaining"),
        F.max("depth").alias("max_depth_reached"),
    )


def failure_reasons(crawl: Crawl) -> DataFrame:
    """Failed pages of each site by reason: site_id, reason, n_pages."""
    failed = crawl.visited.where(F.col("reason") != OK)
    return failed.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n_pages"))


def stop_reasons(crawl: Crawl) -> DataFrame:
    """Why each site's crawl ended: all done, or cut short by its page budget."""
    cut = crawl.capped.select("site_id", F.lit(MAX_PAGES).alias("cut"))
    return crawl.sites.select("site_id").join(cut, "site_id", "left").select(
        "site_id", F.coalesce("cut", F.lit(COMPLETED)).alias("stop_reason")
    )


def site_diagnostics(crawl: Crawl) -> DataFrame:
    """site_id and a ``diagnostics`` struct: stop reason, limits, counters, failures, contacts found."""
    entries = F.array_sort(F.collect_list(F.struct("reason", "n_pages")))
    failures = failure_reasons(crawl).groupBy("site_id").agg(F.map_from_entries(entries).alias("failure_reasons"))
    found = contacts_found(crawl.contacts, "site_id")
    limits = crawl.sites.select("site_id", "max_pages", "max_depth")
    joined = (
        limits.join(crawl_counters(crawl), "site_id")
        .join(stop_reasons(crawl), "site_id")
        .join(failures, "site_id", "left")
        .join(found, "site_id", "left")
    )
    nothing = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "site_id",
        F.struct(
            "stop_reason",
            F.struct("max_pages", "max_depth").alias("limits"),
            F.struct(*COUNTERS).alias("counters"),
            F.coalesce("failure_reasons", nothing).alias("failure_reasons"),
            F.struct(
                F.coalesce("n_emails", zero).alias("emails"), F.coalesce("n_phones", zero).alias("phones")
            ).alias("contacts_found"),
        ).alias("diagnostics"),
    )


def result_rows(crawl: Crawl, diagnostics: bool = False) -> DataFrame:
    """site_id, url, sorted e-mails and phones and, on request, diagnostics, for every site.

    A site without contacts has empty lists. Every row is ``part`` (from 0) of ``parts``: the
    lists of a site with very many contacts are cut in sort order into several rows.
    """
    lists = contact_lists(crawl.contacts, "site_id")
    rows = site_origin(crawl.sites).join(lists, "site_id", "left").select(
        "site_id",
        "url",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.coalesce("emails", no_strings()).alias("emails"),
        F.coalesce("phones", no_strings()).alias("phones"),
    )
    return rows.join(site_diagnostics(crawl), "site_id", "left") if diagnostics else rows
