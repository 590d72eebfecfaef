"""Contact extraction on Spark: e-mail addresses and phone numbers of crawled pages."""

from .operators.contacts import contact_lists, contact_rows, contacts_by_site, contacts_found, page_contacts, site_contact_lists
from .operators.links import link_rows, resolved_links, scored_links
from .operators.options import merge_options, site_options, validate_options
from .operators.responses import classify_responses, pages_of_responses
from .plans.crawl import Crawl, crawl
from .plans.results import crawl_counters, failure_reasons, result_rows, site_diagnostics, stop_reasons
from .sources.tables import read_option_file, read_requests, result_json, scan_pages, scan_responses, write_results

__all__ = [
    "Crawl", "classify_responses", "contact_lists", "contact_rows", "contacts_by_site", "contacts_found", "crawl",
    "crawl_counters", "failure_reasons", "link_rows", "merge_options", "page_contacts", "pages_of_responses",
    "read_option_file", "read_requests", "resolved_links", "result_json", "result_rows", "scan_pages", "scan_responses",
    "scored_links", "site_contact_lists", "site_diagnostics", "site_options", "stop_reasons", "validate_options",
    "write_results",
]
