"""The queries: one per group of operators, over the views of the test tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachmap.functions import emails, html, masking, phones, scoring, urls
from reachmap.functions.numbering import NUMBERING_PLAN
from reachmap.operators import contacts, links, log, options, phone_plan, responses
from reachmap.plans import results
from reachmap.plans.crawl import Crawl, crawl, crawl_responses
from reachmap.session import new_run_folder
from reachmap.sources import tables
from reachmap.sources.workspace import Workspace
from reachmap.streaming import tables as streams

from . import views


def _sorted_text(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def _view(name: str):
    return lambda spark, sf_dir: views.view(spark, sf_dir, getattr(views, name))


doc_pages, contact_pages, linked_pages = _view("DOC_PAGES"), _view("CONTACT_PAGES"), _view("LINKED_PAGES")
stored_responses, requests, crawl_log = _view("RESPONSES"), _view("REQUESTS"), _view("CRAWL_LOG")


# --- URLs -------------------------------------------------------------------------------------


def url_normalize(spark, sf_dir):
    pages = contact_pages(spark, sf_dir)
    return pages.select(
        "page_id",
        urls.normalize_url(F.regexp_replace("url", "^http", " HTTP")).alias("plain"),
        urls.normalize_url("url", True).alias("with_query"),
        urls.normalize_url(F.regexp_replace("url", "^http", "ftp")).alias("foreign"),
        urls.normalize_url(F.regexp_replace("url", "^([a-z]+://[^/]+)/", "$1:80/")).alias("with_port"),
    )


def url_site_key(spark, sf_dir):
    keyed = contact_pages(spark, sf_dir).select(urls.site_key("url").alias("site_key"), "url")
    return keyed.groupBy("site_key").agg(F.count(F.lit(1)).alias("n_pages"))


def url_origin(spark, sf_dir):
    return contact_pages(spark, sf_dir).select("page_id", urls.origin("url").alias("origin"))


def url_region(spark, sf_dir):
    regions = contact_pages(spark, sf_dir).select(urls.phone_region_of_url("url").alias("region"))
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("n_pages"))


def href_filter(spark, sf_dir):
    rows = links.link_rows(contact_pages(spark, sf_dir))
    return rows.groupBy("tag", urls.is_page_href("href").alias("is_page")).agg(F.count(F.lit(1)).alias("n_links"))


def url_resolve(spark, sf_dir):
    rows = links.resolved_links(links.link_rows(contact_pages(spark, sf_dir)))
    return rows.select("page_id", "pos", "dst_url", "same_site")


def url_score(spark, sf_dir):
    pages = linked_pages(spark, sf_dir)
    return pages.select("page_id", scoring.url_priority_score("url").alias("score"))


def url_score_all(spark, sf_dir):
    """Scores of URLs with every weighted word and extension, with and without queries."""
    scored = views.view(spark, sf_dir, views.SCORED_URLS)
    return scored.select("page_id", "url", scoring.url_priority_score("url").alias("score"))


# --- HTML -------------------------------------------------------------------------------------


def page_text(spark, sf_dir):
    return contact_pages(spark, sf_dir).select("page_id", html.visible_text("html").alias("text"))


def doc_text(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("page_id", F.md5(html.visible_text("html").cast("binary")).alias("text_md5"))


def page_links(spark, sf_dir):
    return links.link_rows(contact_pages(spark, sf_dir)).select("page_id", "pos", "tag", "href")


def page_comments(spark, sf_dir):
    """Text and links behind comments that end abruptly."""
    pages = views.view(spark, sf_dir, views.COMMENT_PAGES)
    hrefs = F.transform(html.page_links("html"), lambda link: link["href"])
    found = pages.select("page_id", html.visible_text("html").alias("text"), F.array_join(hrefs, "\n").alias("hrefs"))
    own = F.filter(emails.valid_emails(emails.email_candidates("text")), lambda e: e.startswith("after"))
    return found.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "hrefs", F.array_join(own, ",").alias("emails"))


def _anchors(spark, sf_dir, scheme):
    found = contact_pages(spark, sf_dir).select("page_id", html.page_links("html").alias("links"))
    return found.select("page_id", F.explode(html.anchor_hrefs("links", scheme)).alias("href"))


def anchor_mailto(spark, sf_dir):
    return _anchors(spark, sf_dir, "mailto")


def anchor_tel(spark, sf_dir):
    return _anchors(spark, sf_dir, "tel")


def html_unescape(spark, sf_dir):
    scripts = contact_pages(spark, sf_dir).select("page_id", F.explode(html.script_bodies("html")).alias("body"))
    return scripts.select("page_id", html.html_unescape("body").alias("body"))


# --- E-mails ----------------------------------------------------------------------------------


def _texts(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("page_id", html.visible_text("html").alias("text"))


def email_text(spark, sf_dir):
    return _texts(spark, sf_dir).select("page_id", F.explode(emails.email_candidates("text")).alias("candidate"))


def email_valid(spark, sf_dir):
    found = email_text(spark, sf_dir).select("page_id", emails.normalize_email("candidate").alias("email"))
    return found.where(F.col("email").isNotNull()).distinct()


def email_mailto(spark, sf_dir):
    found = contact_pages(spark, sf_dir).select("page_id", html.page_links("html").alias("links"))
    return found.select("page_id", F.explode(emails.mailto_candidates("links")).alias("candidate"))


def email_cloaked(spark, sf_dir):
    pages = contact_pages(spark, sf_dir)
    return pages.select("page_id", F.explode(emails.valid_emails(emails.cloaked_candidates("html"))).alias("email"))


ALLOWLIST = ["@mail.example.com", ".example.ORG", "mail3.example.com"]


def _email_rows(spark, sf_dir, **given):
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    return contacts.contact_rows(contacts.page_contacts(pages, **given), [contacts.EMAIL])


def email_all(spark, sf_dir):
    rows = _email_rows(spark, sf_dir)
    return rows.groupBy("contact").agg(F.count(F.lit(1)).alias("n_pages"))


def email_allowlist(spark, sf_dir):
    allowed = emails.normalize_allowlist(F.array(*[F.lit(d) for d in ALLOWLIST]))
    rows = _email_rows(spark, sf_dir).where(emails.domain_allowed("contact", allowed))
    return rows.groupBy("contact").agg(F.count(F.lit(1)).alias("n_pages"))


def allowlist_join(spark, sf_dir):
    """Contacts of the document sites under lists of thousands of domains a site."""
    rows = contacts.contacts_by_site(doc_pages(spark, sf_dir))
    return contacts.allowed_contacts(rows, views.view(spark, sf_dir, views.ALLOWED))


# --- Phones -----------------------------------------------------------------------------------


def _no_regions():
    return F.array().cast("array<string>")


def _phones(frame, column):
    return frame.select("page_id", F.explode(column).alias("phone"))


def _both_texts(spark, sf_dir):
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    return pages.select("page_id", "final_url", html.visible_text("html").alias("text"))


def phone_intl(spark, sf_dir):
    texts = _texts(spark, sf_dir).select("page_id", phones.phone_runs("text").alias("runs"))
    found = phones.phones_of_candidates("runs", _no_regions(), _no_regions(), _no_regions())
    return _phones(texts, found)


def phone_idd(spark, sf_dir):
    texts = _both_texts(spark, sf_dir).select("page_id", phones.idd_candidates("text").alias("dialled"))
    return _phones(texts, phones.phones_of_candidates(_no_regions(), "dialled", _no_regions(), _no_regions()))


def _tel_links(spark, sf_dir):
    found = contact_pages(spark, sf_dir).select("page_id", "final_url", html.page_links("html").alias("links"))
    return found.select("page_id", "final_url", phones.tel_candidates("links").alias("tel"))


def phone_tel(spark, sf_dir):
    return _phones(_tel_links(spark, sf_dir), phones.phones_of_tel("tel", F.array(F.lit("RU"), F.lit("US"))))


def phone_regional(spark, sf_dir):
    texts = contact_pages(spark, sf_dir).select("page_id", html.visible_text("html").alias("text"))
    return _phones(texts, phones.phones_of_text("text", F.array(F.lit("RU"), F.lit("US"))))


def phone_region_filter(spark, sf_dir):
    texts = _both_texts(spark, sf_dir)
    regions = texts.select("page_id", "text", phones.effective_regions(F.lit(None).cast("array<string>"), "final_url").alias("regions"))
    found = _phones(regions, phones.phones_of_text("text", "regions"))
    return found.groupBy("phone").agg(F.count(F.lit(1)).alias("n_pages"))


def phone_all(spark, sf_dir):
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    rows = contacts.contact_rows(contacts.page_contacts(pages), [contacts.PHONE])
    return rows.groupBy("contact").agg(F.count(F.lit(1)).alias("n_pages"))


def phone_odd(spark, sf_dir):
    """Several regions in one run, letters, extensions, and what spoils a number."""
    pages = views.view(spark, sf_dir, views.ODD_PHONES).withColumn("final_url", F.col("url"))
    rows = contacts.contact_rows(contacts.page_contacts(pages.drop("d"), phone_regions=["RU", "US"]), [contacts.PHONE])
    return rows.select("page_id", F.col("contact").alias("phone"))


def phone_plan_join(spark, sf_dir):
    """The same numbers as ``phone_all``, the plan being a table of prefixes."""
    pages = contact_pages(spark, sf_dir).withColumn("page_id", -F.col("page_id") - 1).unionByName(doc_pages(spark, sf_dir))
    dialling, prefixes = phone_plan.plan_tables(spark, NUMBERING_PLAN)
    found = phone_plan.page_phones(pages, dialling, Workspace(spark, "plan").write(prefixes, "prefixes"))
    return found.select(F.explode("phones").alias("contact")).groupBy("contact").agg(F.count(F.lit(1)).alias("n_pages"))


# --- Responses --------------------------------------------------------------------------------


def _responses(spark, sf_dir):
    return stored_responses(spark, sf_dir).withColumn("body", F.encode("html", "UTF-8")).drop("html")


def response_reason(spark, sf_dir):
    classified = responses.classify_responses(_responses(spark, sf_dir))
    return classified.groupBy("reason").agg(F.count(F.lit(1)).alias("n_pages"))


def body_truncate(spark, sf_dir):
    cut = responses.pages_of_responses(_responses(spark, sf_dir), 2000)
    usable = cut.where(F.col("reason") == responses.OK)
    return usable.select("page_id", F.md5(F.encode("html", "UTF-8")).alias("html_md5"))


# --- Sites and crawls -------------------------------------------------------------------------


def site_contacts(spark, sf_dir):
    return contacts.contacts_by_site(doc_pages(spark, sf_dir))


def contacts_found(spark, sf_dir):
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    return contacts.contacts_found(contacts.contacts_by_site(pages))


def contacts_estimated(spark, sf_dir):
    """Sketches of eight parts of the pages, merged, beside the exact numbers and the sketch of the whole."""
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    keyed = pages.withColumn("site_key", urls.normalized_site_key(urls.normalize_url("url")))
    rows = Workspace(spark, "sketches").write(contacts.contact_rows(contacts.page_contacts(keyed)), "rows")
    parts = [contacts.contact_sketches(rows.where(F.col("page_id") % 8 == part)) for part in range(8)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = contacts.contacts_estimated(contacts.merge_sketches(merged))
    whole = contacts.contacts_estimated(contacts.contact_sketches(rows))
    exact = contacts.contacts_found(rows.select("site_key", "kind", "contact").distinct())
    beside = exact.join(merged.select("site_key", F.col("n_emails").alias("e"), F.col("n_phones").alias("p")), "site_key")
    beside = beside.join(whole.select("site_key", F.col("n_emails").alias("we"), F.col("n_phones").alias("wp")), "site_key")

    def near(estimate: str, number: str) -> Column:
        return F.abs(F.col(estimate) - F.col(number)) <= F.ceil(F.col(number) * 0.05)  # three standard errors of 4,096 registers

    return beside.select(
        "site_key", "n_emails", "n_phones", (near("e", "n_emails") & near("p", "n_phones")).alias("within"),
        ((F.col("e") == F.col("we")) & (F.col("p") == F.col("wp"))).alias("merged_as_whole"),
    )


def site_lists(spark, sf_dir):
    pages = contact_pages(spark, sf_dir).unionByName(doc_pages(spark, sf_dir))
    lists = contacts.site_contact_lists(pages)
    return lists.select("site_key", "part", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def site_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests view with its options as a map of strings, as callers send them."""
    asked = requests(spark, sf_dir)
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("key"), F.col(column).alias("value"))
            for name, column in (
                ("max_pages", "max_pages"), ("focused_crawling", "focused"),
                ("phone_regions", "regions"), ("email_domain_allowlist", "domains"),
            )
        ],
        F.struct(F.lit("max_depth").alias("key"), F.lit("2").alias("value")),
    )
    given = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return asked.select("site_id", "start_url", given.alias("options"))


def _crawl(spark, sf_dir, whole: bool = False) -> Crawl:
    asked = site_requests(spark, sf_dir)
    if whole:  # the largest depth and page budget that requests may ask for
        kept = F.map_filter("options", lambda name, _: ~name.isin("max_depth", "max_pages"))
        largest = F.create_map(F.lit("max_depth"), F.lit("50"), F.lit("max_pages"), F.lit("5000"))
        asked = asked.withColumn("options", F.map_concat(kept, largest))
    # Callers keep their requests in a table, so the view is stored before it is read.
    asked = Workspace(spark, "requests").write(asked, "asked")
    return crawl(linked_pages(spark, sf_dir), options.site_options(asked))


def crawl_reach(spark, sf_dir):
    return _crawl(spark, sf_dir).visited.select("site_id", "depth", "fetch_rank", "url", "page_id", "reason")


def crawl_whole(spark, sf_dir):
    """Every page of each site that links lead to, however deep."""
    return _crawl(spark, sf_dir, whole=True).visited.select("site_id", "url", "page_id", "reason")


def crawl_odd(spark, sf_dir):
    """Requests that can't be followed, sites that moved, link limits that bind, pages without HTML."""
    asked = views.view(spark, sf_dir, views.ODD_REQUESTS)
    names = {"max_pages": "max_pages", "focused": "focused_crawling", "max_links": "max_links_per_page"}
    given = F.create_map(*[x for column, name in names.items() for x in (F.lit(name), F.col(column))], F.lit("max_depth"), F.lit("2"))
    asked = Workspace(spark, "requests").write(asked.select("site_id", "start_url", given.alias("options")), "asked")
    done = crawl(views.view(spark, sf_dir, views.ODD_PAGES), options.site_options(asked))
    visited = done.visited.select("site_id", "depth", "url", "page_id", "reason", "processed", "links_examined")
    refused = done.rejected.select("site_id", F.col("start_url").alias("url"), F.lit("rejected").alias("reason"))
    return visited.unionByName(refused, allowMissingColumns=True)


def crawl_frontier(spark, sf_dir):
    visited = _crawl(spark, sf_dir).visited
    return visited.groupBy("site_id", "depth").agg(F.count(F.lit(1)).alias("n_urls"), F.sum("links_examined").alias("links_examined"))


def crawl_cap(spark, sf_dir):
    stopped = results.stop_reasons(_crawl(spark, sf_dir))
    return stopped.select("site_id", "stop_reason")


def crawl_counters(spark, sf_dir):
    return results.crawl_counters(_crawl(spark, sf_dir))


def failure_reasons(spark, sf_dir):
    return results.failure_reasons(_crawl(spark, sf_dir))


def site_results(spark, sf_dir):
    rows = results.result_rows(_crawl(spark, sf_dir))
    return rows.select("site_id", "url", "part", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def site_results_whole(spark, sf_dir):
    rows = results.result_rows(_crawl(spark, sf_dir, whole=True))
    return rows.select("site_id", "url", "part", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def responses_results(spark, sf_dir):
    """Stored responses in several charsets, some sites with a small budget for bodies, crawled to their contacts."""
    pages = linked_pages(spark, sf_dir)
    kind = F.when((F.col("page_id") % 4 == 2) & F.col("html").rlike(r"[^\x00-\x7f\xa0-\xff]"), F.lit(0)).otherwise(F.col("page_id") % 4)
    charset = F.when(kind == 2, F.lit("ISO-8859-1")).when(kind == 3, F.lit("UTF-16BE")).otherwise(F.lit("utf-8"))
    body = F.when(kind == 2, F.encode("html", "ISO-8859-1")).when(kind == 3, F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "UTF-8"))
    stored = pages.select(
        "page_id", "url", "final_url", F.when(F.col("reason") == "ok", 200).otherwise(404).alias("status"),
        F.concat(F.lit("text/html; charset="), charset).alias("content_type"), body.alias("body"), F.lit(None).cast("string").alias("error"),
    )
    asked = site_requests(spark, sf_dir)
    small = F.create_map(F.lit("max_body_bytes"), F.lit("1500"))
    asked = asked.withColumn("options", F.when(F.col("site_id") % 4 == 2, F.map_concat("options", small)).otherwise(F.col("options")))
    work = Workspace(spark, "stored")
    done = crawl_responses(work.write(stored, "responses"), options.site_options(work.write(asked, "asked")))
    rows = results.result_rows(done)
    return rows.select("site_id", "url", "part", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


def result_json(spark, sf_dir):
    """Results as stored: a run of all sites, one more of half of them, one that never commits."""
    rows = results.result_rows(_crawl(spark, sf_dir))
    folder = new_run_folder(spark, "results")
    tables.commit_results(rows, folder)
    tables.commit_results(rows.where(F.col("site_id") % 2 == 0), folder)
    tables.stage_results(rows.withColumn("url", F.lit("broken")), folder)
    return tables.read_results(spark, folder)


def site_diagnostics(spark, sf_dir):
    found = results.site_diagnostics(_crawl(spark, sf_dir))
    return found.select(
        "site_id", "diagnostics.stop_reason", "diagnostics.counters.fetched_pages", "diagnostics.limits.max_pages",
        F.array_join(
            F.transform(F.map_entries("diagnostics.failure_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
        ).alias("failure_reasons"),
        "diagnostics.contacts_found.emails", "diagnostics.contacts_found.phones",
    )


# --- Options, masks, log ----------------------------------------------------------------------


def _odd_requests(spark, sf_dir):
    """Every page as a request; its option values depend on its id, and some are wrong."""
    n = F.col("page_id").cast("string")
    entries = F.map_from_arrays(
        F.array(
            F.lit("max_pages"), F.lit("max_depth"), F.lit("focused_crawling"), F.lit("phone_regions"),
            F.when(F.col("page_id") % 5 == 3, F.lit("unknown_field")).otherwise(F.lit("log_level")),
        ),
        F.array(
            n, F.when(F.col("page_id") % 3 == 1, F.lit("deep")).otherwise((F.col("page_id") % 60).cast("string")),
            F.when(F.col("page_id") % 4 == 2, F.lit("maybe")).otherwise(F.lit(" On ")), F.lit(" ru,zz;BY,ru "), F.lit("info"),
        ),
    )
    return views.table(spark, sf_dir, "pages").select("page_id", entries.alias("options"))


def options_validate(spark, sf_dir):
    checked = options.validate_options(_odd_requests(spark, sf_dir))
    return checked.select("page_id", F.array_join("errors", "; ").alias("errors"))


def options_typed(spark, sf_dir):
    typed = options.site_options(_odd_requests(spark, sf_dir))
    return typed.select("page_id", "max_pages", "max_depth", "focused_crawling", F.array_join("phone_regions", ",").alias("phone_regions"), "include_query", "max_links_per_page")


def options_merge(spark, sf_dir):
    layered = _odd_requests(spark, sf_dir).select(
        "page_id",
        options.merge_options(
            F.create_map(F.lit("max_pages"), F.lit("1"), F.lit("retry_total"), F.lit("4"), F.lit("colour"), F.lit("red")),
            F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("max_pages"), F.lit("2"))),
            "options",
        ).alias("merged"),
    )
    return layered.select(
        "page_id", F.array_join(F.array_sort(F.map_keys("merged")), ",").alias("names"),
        F.try_element_at("merged", F.lit("max_pages")).alias("max_pages"), F.try_element_at("merged", F.lit("retry_total")).alias("retry_total"),
    )


def options_file(spark, sf_dir):
    """Options from a JSON file, weaker than those of the requests."""
    pages = views.table(spark, sf_dir, "pages")
    content = F.to_json(
        F.struct(
            F.least(F.count(F.lit(1)), F.lit(5000)).alias("max_pages"), F.lit(False).alias("focused_crawling"),
            F.array_distinct(F.flatten(F.array(F.array(F.lit(" ru ")), F.array(F.lit("by"), F.lit("ZZ"))))).alias("phone_regions"), F.lit(1).alias("colour"),
        )
    )
    folder = new_run_folder(spark, "options")
    pages.agg(content.alias("value")).coalesce(1).write.text(folder)
    own = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("max_depth"), (F.col("page_id") % 50).cast("string"), F.lit("focused_crawling"), F.lit("yes")))
    given = F.broadcast(tables.read_option_file(spark, folder).withColumnRenamed("options", "file"))  # one row
    asked = pages.crossJoin(given).select("page_id", options.merge_options("file", own).alias("options"))
    typed = options.site_options(asked)
    return typed.select("page_id", "max_pages", "max_depth", "focused_crawling", F.array_join("phone_regions", ",").alias("regions"))


def mask_map(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    data = documents.select(
        "doc_id",
        F.create_map(
            F.lit("X-Api_Key "), F.col("text"), F.lit("session_TOKEN"), F.col("lang"), F.lit("source"), F.col("source"),
        ).alias("data"),
    )
    masked = data.select("doc_id", masking.mask_map("data").alias("m"))
    return masked.select(
        "doc_id", F.col("m")["X-Api_Key "].alias("api_key"), F.col("m")["session_TOKEN"].alias("token"), F.col("m")["source"].alias("source")
    )


def scan_reasons(spark, sf_dir):
    reason = F.when(F.col("page_id") % 5 == 0, "http_404").when(F.col("page_id") % 7 == 0, "network_error").otherwise("ok")
    folder = new_run_folder(spark, "pages")
    views.table(spark, sf_dir, "pages").withColumn("reason", reason).write.parquet(folder)
    stored = tables.scan_pages(spark, folder)
    return stored.groupBy("reason").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("final_url") == F.col("url")).alias("n_final"))


def body_decode(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    wide = F.col("text").rlike(r"[^\x00-\x7f\xa0-\xff]")
    kind = F.col("doc_id") % 4
    kind = F.when(wide & kind.isin(1, 2), F.lit(0)).otherwise(kind)  # one byte a character isn't enough
    charset = F.element_at(F.array(*map(F.lit, ("utf_8", "iso_8859_1", "cp1252", "utf_16_be"))), (kind + 1).cast("int"))
    body = (
        F.when(kind == 0, F.encode("text", "UTF-8"))
        .when(kind == 3, F.encode("text", "UTF-16BE"))
        .otherwise(F.encode(F.when(~wide, F.col("text")), "ISO-8859-1"))
    )
    decoded = documents.select("doc_id", responses.decode_body(body, charset).alias("text"))
    return decoded.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def mask_types(spark, sf_dir):
    documents = views.table(spark, sf_dir, "documents")
    data = documents.select(
        "doc_id",
        F.create_map(F.lit("token"), F.col("doc_id") + 1_000_000, F.lit("n"), F.col("n_chars")).alias("counts"),
        F.create_map(F.lit("Cookie"), F.array("source", "lang"), F.lit("tags"), F.array("lang")).alias("lists"),
        F.create_map(F.lit("password"), F.struct(F.col("source").alias("v")), F.lit("open"), F.struct(F.col("lang").alias("v"))).alias("nested"),
    )
    masked = masking.mask_columns(data)
    return masked.select(
        "doc_id", F.col("counts")["token"].alias("token"), F.col("counts")["n"].alias("n"), F.col("lists")["Cookie"].alias("cookie"),
        F.col("lists")["tags"].alias("tags"), F.col("nested")["password"]["v"].alias("password"), F.col("nested")["open"]["v"].alias("open"),
    )


def option_lists(spark, sf_dir):
    pages = views.table(spark, sf_dir, "pages")
    region = F.when(F.col("page_id") % 2 == 0, F.lit("ru")).otherwise(F.lit("By"))
    given = F.create_map(
        F.lit("phone_regions"), F.concat(F.lit('["'), region, F.lit('", " de ","ZZ"]')),
        F.lit("email_domain_allowlist"), F.concat(F.lit('["@Site'), F.col("page_id").cast("string"), F.lit('.org", ".b.com"]')),
    )
    typed = pages.select("page_id", *options.typed_options(given))
    return typed.select(
        "page_id", F.array_join("phone_regions", ",").alias("regions"), F.array_join("email_domain_allowlist", ",").alias("domains"), "max_pages"
    )


def log_tail(spark, sf_dir):
    return log.tail_after(crawl_log(spark, sf_dir), after=100, limit=5000).select("id", "level", "logger", "message")


def log_latest(spark, sf_dir):
    latest = log.keep_latest(crawl_log(spark, sf_dir))
    return latest.select("id", "level", "logger", "message")


# --- Streams ----------------------------------------------------------------------------------


def _timed_pages(spark, sf_dir):
    """The contact pages as a stream of files under the shared folder, each page sent twice."""
    folder = new_run_folder(spark, "stream-in")
    pages = contact_pages(spark, sf_dir).withColumn(
        "crawled_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    )
    pages.unionByName(pages).write.parquet(folder)
    return streams.stream_pages(spark, folder)


def stream_pages_dedupe(spark, sf_dir):
    once = streams.dedupe_pages(_timed_pages(spark, sf_dir), "30 days")
    stored = streams.run_to_table(once, new_run_folder(spark, "stream-out"))
    return stored.select("page_id", "url", "site_key")


def stream_contacts(spark, sf_dir):
    found = streams.contacts_stream(_timed_pages(spark, sf_dir))
    stored = streams.run_to_table(found, new_run_folder(spark, "stream-out"))
    return stored.select("site_key", "kind", "contact").distinct()


def stream_site_contacts(spark, sf_dir):
    found = streams.contacts_stream(_timed_pages(spark, sf_dir))
    state = streams.run_site_contacts(found, new_run_folder(spark, "stream-state"))
    return state.select("site_key", "kind", "contact")


def _arriving(spark, sf_dir, frame: DataFrame) -> Iterator[str]:
    """Twelve times the folder of a stream's files, each time with the rows that arrived since, in any number of files."""
    timed = frame.join(views.view(spark, sf_dir, views.ARRIVALS), "page_id").withColumn("crawled_at", F.timestamp_seconds("crawled_s"))
    timed = Workspace(spark, "arriving").write(timed.drop("crawled_s"), "rows", by="slot")
    folder = new_run_folder(spark, "stream-in")
    for slot in range(12):
        timed.where(F.col("slot") == slot).drop("slot").write.mode("append").parquet(folder)
        yield folder


_ALL_FILES = 1 << 30  # a run of a stream takes all that has arrived as one micro-batch


def _in_batches(spark, sf_dir, run) -> DataFrame:
    """What ``run``, given the contacts as a stream, stores over twelve runs from one checkpoint."""
    for folder in _arriving(spark, sf_dir, contact_pages(spark, sf_dir)):
        stored = run(streams.contacts_stream(streams.stream_pages(spark, folder, files_per_batch=_ALL_FILES)))
    return stored


def stream_batches(spark, sf_dir):
    """Distinct contacts of each site over twelve micro-batches, known ones kept as state."""
    out = new_run_folder(spark, "stream-state")
    state = _in_batches(spark, sf_dir, lambda found: streams.run_site_contacts(found, out))
    return state.select("site_key", "kind", "contact")


def stream_contact_counts(spark, sf_dir):
    """Pages that show each contact, and when it was first and last seen, over twelve micro-batches."""
    out = new_run_folder(spark, "stream-out")
    stored = _in_batches(spark, sf_dir, lambda found: streams.run_counts(streams.contact_counts(found), ["site_key", "kind", "contact"], out))
    times = [F.unix_timestamp(c).alias(c) for c in ("first_seen", "last_seen")]
    return stored.select("site_key", "kind", "contact", "n_pages", *times)


def stream_late(spark, sf_dir):
    """Responses by hour and reason over twelve micro-batches: those in time, and those past the mark."""
    out = new_run_folder(spark, "stream-out")
    for folder in _arriving(spark, sf_dir, _responses(spark, sf_dir)):
        split = streams.run_split_late(streams.stream_responses(spark, folder, files_per_batch=_ALL_FILES), out)
    rows = split.kept.withColumn("late", F.lit(False)).unionByName(split.late.withColumn("late", F.lit(True)))
    hour = (F.unix_timestamp("crawled_at") - F.unix_timestamp("crawled_at") % 3600).alias("hour")
    counted = responses.classify_responses(rows).groupBy(hour, "reason")
    return counted.agg(F.count_if(~F.col("late")).alias("n_kept"), F.count_if("late").alias("n_late"))


def stream_failures(spark, sf_dir):
    folder = new_run_folder(spark, "stream-in")
    answers = _responses(spark, sf_dir).withColumn(
        "crawled_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    )
    answers.write.parquet(folder)
    counted = streams.failure_counts(streams.stream_responses(spark, folder))
    stored = streams.run_counts(counted, ["window_start", "reason"], new_run_folder(spark, "stream-out"))
    return stored.select(F.unix_timestamp("window_start").alias("window_start"), "reason", "n_pages")


QUERIES = {
    f.__name__: f
    for f in (
        url_normalize, url_site_key, url_origin, url_region, url_resolve, url_score, url_score_all, href_filter,
        response_reason, body_truncate, page_text, doc_text, page_links, page_comments, anchor_mailto, anchor_tel,
        html_unescape, email_text, email_mailto, email_cloaked, email_valid, email_allowlist, email_all, allowlist_join,
        phone_intl, phone_idd, phone_tel, phone_regional, phone_region_filter, phone_all, phone_odd, phone_plan_join,
        site_contacts, contacts_found, contacts_estimated, site_lists, crawl_frontier, crawl_cap, crawl_odd, crawl_reach, crawl_whole, crawl_counters,
        failure_reasons, site_results, site_results_whole, responses_results, result_json, site_diagnostics, options_validate, options_typed, options_merge, options_file,
        mask_map, mask_types, option_lists, scan_reasons, body_decode, log_tail, log_latest, stream_pages_dedupe, stream_contacts, stream_site_contacts,
        stream_batches, stream_contact_counts, stream_late, stream_failures,
    )
}
