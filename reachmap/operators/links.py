"""Link rows of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import page_links
from ..functions.scoring import url_priority_score
from ..functions.urls import is_page_href, normalized_site_key, resolve_href, site_key


def link_rows(pages: DataFrame) -> DataFrame:
    """One row a link: page_id, final_url, pos, tag, href. ``pos`` counts from 0 in document order."""
    linked = pages.select("page_id", "final_url", page_links("html").alias("links"))
    return linked.select("page_id", "final_url", F.posexplode("links").alias("pos", "link")).select(
        "page_id", "final_url", "pos", "link.tag", "link.href"
    )


def resolved_links(links: DataFrame, include_query: bool = True) -> DataFrame:
    """Keep links that lead to a page: adds dst_url (normalised), dst_key and same_site."""
    targets = links.where(is_page_href("href")).withColumn(
        "dst_url", resolve_href("final_url", "href", include_query)
    )
    return (
        targets.where(F.col("dst_url").isNotNull())
        .withColumn("dst_key", normalized_site_key("dst_url"))
        .withColumn("same_site", F.col("dst_key") == site_key("final_url"))
    )


def scored_links(links: DataFrame) -> DataFrame:
    """Add the focused-crawl score of each target."""
    return links.withColumn("score", url_priority_score("dst_url"))
