"""Contacts of pages and of sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emails import cloaked_candidates, domain_allowed, email_candidates, mailto_candidates, valid_emails
from ..functions.html import page_links, visible_text
from ..functions.numbering import NUMBERING_PLAN, Region
from ..functions.phones import effective_regions, idd_candidates, phone_runs, phones_of_candidates, tel_candidates
from ..functions.text import strip
from ..functions.urls import normalize_url, normalized_site_key
from ..sources.workspace import Workspace

EMAIL, PHONE = "email", "phone"
NO_STRINGS = "array<string>"


def no_strings() -> Column:
    return F.array().cast(NO_STRINGS)


def page_projections(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by what extraction needs: text, links and cloaked addresses.

    One pass over the wide column. Everything after it works on narrow columns.
    """
    kept = [F.col(c) for c in pages.columns if c != "html"]
    return pages.select(
        *kept,
        F.col("html").isNotNull().alias("parsed"),
        visible_text("html").alias("text"),
        page_links("html").alias("links"),
        cloaked_candidates("html").alias("cloaked"),
    )


def page_candidates(pages: DataFrame) -> DataFrame:
    """Site-independent contact candidates of every page, from one pass over the HTML.

    Adds ``emails`` (valid, not yet filtered by domain), ``runs``, ``dialled`` and ``tel``
    (phone candidates, not yet read from any region) and keeps ``links`` and ``parsed``.
    """
    staged = page_projections(pages)
    kept = [F.col(c) for c in staged.columns if c not in ("text", "cloaked")]
    return staged.select(
        *kept,
        valid_emails(F.concat(email_candidates("text"), mailto_candidates("links"), F.col("cloaked"))).alias("emails"),
        phone_runs("text").alias("runs"),
        idd_candidates("text").alias("dialled"),
        tel_candidates("links").alias("tel"),
    )


def read_candidates(
    candidates: DataFrame,
    regions: Column | str = "phone_regions",
    allowlist: Column | str = "email_domain_allowlist",
    plan: Sequence[Region] = NUMBERING_PLAN,
) -> DataFrame:
    """Turn candidates into ``emails`` and ``phones`` under a site's regions and allow-list."""
    kept = [F.col(c) for c in candidates.columns if c not in ("emails", "runs", "dialled", "tel", "links")]
    allowed = F.filter("emails", lambda e: domain_allowed(e, allowlist))
    return candidates.select(
        *kept,
        F.coalesce(allowed, no_strings()).alias("emails"),
        F.coalesce(phones_of_candidates("runs", "dialled", "tel", regions, plan), no_strings()).alias("phones"),
    )


def page_contacts(
    pages: DataFrame,
    phone_regions: list[str] | None = None,
    email_domain_allowlist: list[str] | None = None,
    plan: Sequence[Region] = NUMBERING_PLAN,
) -> DataFrame:
    """Contacts of each page on its own; regions follow each page's final URL if none are given.

    A stateless projection without any shuffle: it runs on batch and streaming pages alike.
    """

    def option(values: list[str] | None) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast(NO_STRINGS) if values else F.lit(None).cast(NO_STRINGS)

    candidates = page_candidates(pages)
    staged = candidates.select(
        "*",
        effective_regions(option(phone_regions), "final_url").alias("phone_regions"),
        option(email_domain_allowlist).alias("email_domain_allowlist"),
    )
    return read_candidates(staged, plan=plan).drop("phone_regions", "email_domain_allowlist", "parsed")


def contact_rows(contacts: DataFrame, kinds: Sequence[str] = (EMAIL, PHONE)) -> DataFrame:
    """One row a contact: the ``emails`` and ``phones`` arrays exploded in one step.

    Where only one of the ``kinds`` is asked for, the optimizer drops all that the other would have needed.
    """

    def tagged(column: str, kind: str) -> Column:
        return F.transform(column, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("contact")))

    kept = [F.col(c) for c in contacts.columns if c not in ("emails", "phones")]
    found = F.concat(*[tagged(column, kind) for column, kind in (("emails", EMAIL), ("phones", PHONE)) if kind in kinds])
    return contacts.select(*kept, F.explode(found).alias("c")).select(*kept, "c.kind", "c.contact")


def site_contacts(rows: DataFrame, key: str = "site_key") -> DataFrame:
    """Distinct contacts of each site with the number of pages showing them.

    Rows are combined before the shuffle and spread by (site, kind, contact), so a site with
    a large share of all pages doesn't land in one task.
    """
    return rows.groupBy(key, "kind", "contact").agg(F.count(F.lit(1)).alias("n_pages"))


def allowed_contacts(rows: DataFrame, allowed: DataFrame, key: str = "site_key") -> DataFrame:
    """Contact rows whose address is in, or below, a domain listed for its site; for lists of any length.

    ``allowed``: ``key`` and ``suffix``, one row a listed domain, written as in ``normalize_allowlist``. Sites
    without a list keep all addresses; phones always stay. Each distinct domain of a site gives its own
    suffixes (``a.b.org``: ``a.b.org``, ``b.org``, ``org``), which meet the lists in an equi-join: the work follows the
    number of domains and list entries, not their product, and neither is held in one place.
    """
    domain = F.substring_index("contact", "@", -1)
    listed = allowed.select(key, F.ltrim(F.ltrim(F.lower(strip("suffix")), F.lit("@")), F.lit(".")).alias("suffix"))
    listed = listed.where(F.col("suffix") != "")
    found = rows.where(F.col("kind") == EMAIL).select(key, domain.alias("domain")).distinct()
    labels = F.split("domain", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    below = found.withColumn("suffix", F.explode(suffixes)).join(listed, [key, "suffix"], "left_semi").select(key, "domain").distinct()
    unlisted = found.join(listed.select(key).distinct(), key, "left_anti")
    work = Workspace(rows.sparkSession, "allowed")
    passing = work.write(below.unionByName(unlisted), "domains")
    emails = rows.where(F.col("kind") == EMAIL).withColumn("domain", domain)
    return emails.join(passing, [key, "domain"], "left_semi").select(*rows.columns).unionByName(rows.where(F.col("kind") != EMAIL))


def contact_sketches(rows: DataFrame, key: str = "site_key", log_size: int = 12) -> DataFrame:
    """One HyperLogLog sketch of the contacts of each site and kind; rows needn't be distinct.

    A sketch has at most ``2 ** log_size`` registers whatever it has seen, and those of several parts or
    batches merge into that of the whole (``merge_sketches``), so history needn't be read again.
    """
    return rows.groupBy(key, "kind").agg(F.hll_sketch_agg("contact", log_size).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: str = "site_key") -> DataFrame:
    return sketches.groupBy(key, "kind").agg(F.hll_union_agg("sketch").alias("sketch"))


def contacts_estimated(sketches: DataFrame, key: str = "site_key") -> DataFrame:
    """About how many distinct e-mails and phones each site has; the standard error is 1.04 / sqrt(2 ** log_size).

    A sketch joined with itself is estimated by its registers alone, so it doesn't matter how it was merged.
    """
    estimate = F.hll_sketch_estimate(F.hll_union("sketch", "sketch"))
    return sketches.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("kind") == EMAIL, estimate)), F.lit(0)).alias("n_emails"),
        F.coalesce(F.max(F.when(F.col("kind") == PHONE, estimate)), F.lit(0)).alias("n_phones"),
    )


def contacts_found(distinct_contacts: DataFrame, key: str = "site_key") -> DataFrame:
    """Number of distinct e-mails and phones of each site."""
    return distinct_contacts.groupBy(key).agg(
        F.count_if(F.col("kind") == EMAIL).alias("n_emails"),
        F.count_if(F.col("kind") == PHONE).alias("n_phones"),
    )


def contact_lists(distinct_contacts: DataFrame, key: str = "site_key", part_size: int = 100_000) -> DataFrame:
    """Sorted lists of each site's distinct contacts, cut in sort order into numbered parts.

    Every row says which ``part`` (from 0) of how many ``parts`` it is. A part has at most
    ``part_size`` addresses and as many phones; part after part they are the site's sorted
    lists. Ranks come from a range-sorted written table, so a site of any size is spread over
    tasks and no task holds an unbounded list.
    """
    work = Workspace(distinct_contacts.sparkSession, "lists")
    order = [F.col(key), F.col("kind"), F.col("contact")]
    lined = distinct_contacts.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    lined = work.write(lined.withColumn("at", F.monotonically_increasing_id()), "lined")
    piece = F.shiftright("at", 33).alias("piece")  # the task that wrote the row; below it, the row's place there
    pieces = lined.groupBy(key, "kind", piece).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(key, "kind").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    last = ((F.col("before") + F.col("n") - 1) / F.lit(part_size)).cast("int")
    parts = pieces.groupBy(key).agg((F.max(last) + 1).alias("parts"))
    ranked = lined.withColumn("piece", piece).join(pieces.drop("n"), [key, "kind", "piece"])
    numbered = ranked.withColumn("part", ((F.col("at") - F.col("first") + F.col("before")) / F.lit(part_size)).cast("int"))

    def sorted_list(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("contact"))))

    lists = numbered.groupBy(key, "part").agg(sorted_list(EMAIL).alias("emails"), sorted_list(PHONE).alias("phones"))
    return lists.join(parts, key).select(key, "parts", "part", "emails", "phones")


def site_contact_lists(pages: DataFrame, part_size: int = 100_000, **options) -> DataFrame:
    """Contact lists of every site of a page table, extracting once into a written table."""
    work = Workspace(pages.sparkSession, "lists")
    stored = work.write(contacts_by_site(pages, **options).drop("n_pages"), "contacts")
    return contact_lists(stored, part_size=part_size)


def contacts_by_site(pages: DataFrame, **options) -> DataFrame:
    """Distinct contacts of every site of a page table: site_key, kind, contact, n_pages."""
    keyed = pages.withColumn("site_key", normalized_site_key(normalize_url("url")))
    contacts = page_contacts(keyed, **options).where(F.col("site_key").isNotNull())
    return site_contacts(contact_rows(contacts))
