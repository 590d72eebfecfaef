"""Site options as tables: parse, validate, merge.

Options arrive as ``MAP<STRING,STRING>``, one row a request. Only options with a meaning for
stored pages are carried on; the others (timeouts, retries, user agent, ...) are validated and
then have nothing to do.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.emails import parse_allowlist
from ..functions.phones import parse_regions
from ..functions.text import as_column, strip


class Setting(NamedTuple):
    """One option: kind, default (as text) and allowed range."""

    kind: str
    default: str | None
    low: float | None = None
    high: float | None = None


# The options, their defaults and their allowed ranges.
SETTINGS = {
    "max_pages": Setting("int", "200", 1, 5000),
    "max_depth": Setting("int", "0", 0, 50),
    "max_seconds": Setting("double", "30.0", 1.0, 3600.0),
    "max_concurrency": Setting("int", "4", 1, 64),
    "request_timeout": Setting("double", "10.0", 0.5, 120.0),
    "user_agent": Setting("text", None, 1, 512),
    "include_query": Setting("boolean", "false"),
    "phone_regions": Setting("regions", None),
    "email_domain_allowlist": Setting("domains", None),
    "focused_crawling": Setting("boolean", "true"),
    "max_body_bytes": Setting("int", "2000000", 1024, 50_000_000),
    "max_links_per_page": Setting("int", "200", 1, 5000),
    "retry_total": Setting("int", "2", 0, 10),
    "retry_backoff_factor": Setting("double", "0.5", 0.0, 10.0),
    "log_level": Setting("level", "INFO"),
}
# Words for yes and no, and the log levels.
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# The options a run over stored pages uses.
DATA_OPTIONS = (
    "max_pages", "max_depth", "max_body_bytes", "max_links_per_page", "include_query",
    "focused_crawling", "phone_regions", "email_domain_allowlist",
)


def coerce_bool(value: Column | str) -> Column:
    """Boolean of a yes/no word; NULL if it is none."""
    word = F.lower(strip(value))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def coerce_int(value: Column | str) -> Column:
    text = strip(value)
    return F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))


def coerce_double(value: Column | str) -> Column:
    text = strip(value)
    return F.when(text.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"), text.try_cast("double"))


def option_value(name: str, value: Column) -> Column:
    """The typed value of an option; NULL if it can't be read or isn't allowed."""
    setting = SETTINGS[name]
    if setting.kind == "boolean":
        return coerce_bool(value)
    if setting.kind == "regions":
        return parse_regions(value)
    if setting.kind == "domains":
        return parse_allowlist(value)
    if setting.kind == "level":
        level = F.upper(strip(value))
        return F.when(level.isin(*LOG_LEVELS), level)
    if setting.kind == "text":
        text = strip(value)
        return F.when(F.length(text).between(int(setting.low), int(setting.high)), text)
    if setting.kind == "int":
        number = coerce_int(value)
        return F.when(number.between(int(setting.low), int(setting.high)), number.cast("int"))
    number = coerce_double(value)
    return F.when(number.between(setting.low, setting.high) & ~F.isnan(number), number)


def _problem(name: str, value: Column) -> Column:
    """Why a given option is refused; NULL if it is fine."""
    setting = SETTINGS[name]
    if setting.kind in ("regions", "domains"):
        return F.lit(None).cast("string")
    if setting.kind == "boolean":
        text = F.concat(F.lit(f"{name}: invalid boolean value: "), value)
    elif setting.kind == "level":
        text = F.concat(F.lit(f"{name}: unknown level: "), value)
    elif setting.kind == "text":
        text = F.lit(f"{name} must have {setting.low} to {setting.high} characters")
    else:
        readable = coerce_int(value) if setting.kind == "int" else coerce_double(value)
        text = F.when(
            readable.isNull(), F.concat(F.lit(f"{name}: not a number: "), value)
        ).otherwise(F.lit(f"{name} must be between {setting.low} and {setting.high}"))
    missing = value.isNull()
    return F.when(missing, F.lit(f"{name}: value is missing")).when(option_value(name, value).isNull(), text)


def validate_options(requests: DataFrame, options: str = "options") -> DataFrame:
    """Add ``errors``: the sorted reasons to refuse a request, empty if it is accepted."""
    given = F.coalesce(F.col(options), F.create_map().cast("map<string,string>"))
    unknown = F.transform(
        F.array_except(F.map_keys(given), F.array(*[F.lit(n) for n in SETTINGS])),
        lambda name: F.concat(F.lit("unsupported option: "), name),
    )
    problems = F.array(
        *[
            F.when(F.map_contains_key(given, F.lit(name)), _problem(name, F.try_element_at(given, F.lit(name))))
            for name in SETTINGS
        ]
    )
    return requests.withColumn("errors", F.array_sort(F.concat(unknown, F.filter(problems, lambda p: p.isNotNull()))))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def merge_options(*sources: Column | str) -> Column:
    """Layered option maps, weakest first; a later value replaces an earlier one key by key.

    Unknown keys are dropped, as for configuration files. NULL maps count as empty.
    """
    empty = F.create_map().cast("map<string,string>")
    known = F.array(*[F.lit(n) for n in SETTINGS])
    maps = [
        F.map_filter(F.coalesce(as_column(s), empty), lambda k, _: F.array_contains(known, k)) for s in sources
    ]

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)

    return reduce(over, maps)


def typed_options(options: Column | str) -> list[Column]:
    """One typed column per data option, with its default where the option isn't set."""
    given = F.coalesce(as_column(options), F.create_map().cast("map<string,string>"))
    columns = []
    for name in DATA_OPTIONS:
        value = option_value(name, F.try_element_at(given, F.lit(name)))
        default = SETTINGS[name].default
        if default is not None:
            value = F.coalesce(value, option_value(name, F.lit(default)))
        columns.append(value.alias(name))
    return columns


def site_options(requests: DataFrame) -> DataFrame:
    """Accepted requests with typed option columns: one row a site."""
    valid = accepted(validate_options(requests))
    kept = [F.col(c) for c in requests.columns if c != "options"]
    return valid.select(*kept, *typed_options("options"))
