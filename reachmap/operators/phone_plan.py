"""Phone numbers under a numbering plan that is a table: any number of prefixes, no patterns.

A plan has two tables. ``dialling`` has one row a region (there are a few hundred at most): region, calling_code,
trunk, trunk_required, idd. ``prefixes`` has a row for every start of valid numbers: region, prefix (calling code and
leading digits) and n_digits, the length of the whole number; it may be of any size. Of several prefixes that fit
a number the longest gives its region, and of equal ones the region that is first in ``dialling``.

Pages are reduced to their candidates first. The distinct numbers that these may mean are joined with the prefixes
by equality, once for each prefix length that occurs, so the work follows candidates and prefixes, not their
product. A page then looks its numbers up among its own valid ones, by the rules all phone functions share.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import Region
from ..functions.phones import KnownNumbers, effective_regions, phones_of_candidates, readings_of_candidates
from ..sources.workspace import Workspace
from .contacts import NO_STRINGS, page_candidates

MAX_REGIONS = 1000  # of the dialling table, which becomes part of the plan's expressions
DIALLING = "region string, calling_code string, trunk string, trunk_required boolean, idd string, rank int"
PREFIXES = "region string, prefix string, n_digits int"
_ALL = frozenset("0123456789")
_Places = tuple[frozenset[str], ...]


def _spelled(pattern: str) -> list[_Places]:
    """The digits each place may have, one list for every way a pattern of digits, classes and groups can be read."""

    def either(at: int) -> tuple[list[_Places], int]:
        out, ways = [], [()]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, ways, at = out + ways, [()], at + 1
                continue
            item, at = one(at)
            ways = [a + b for a in ways for b in item]
        return out + ways, at

    def one(at: int) -> tuple[list[_Places], int]:
        if pattern.startswith("(?:", at):
            item, at = either(at + 3)
            at += 1
        elif pattern[at] == "[":
            end = pattern.index("]", at)
            item, at = [(frozenset(_members(pattern[at + 1 : end])),)], end + 1
        elif pattern.startswith("\\d", at):
            item, at = [(_ALL,)], at + 2
        elif pattern[at].isdigit():
            item, at = [(frozenset(pattern[at]),)], at + 1
        else:
            raise ValueError(f"not understood in a numbering pattern: {pattern[at:]}")
        if pattern.startswith("?", at):
            return [(), *item], at + 1
        if pattern.startswith("{", at):
            end = pattern.index("}", at)
            low, _, high = pattern[at + 1 : end].partition(",")
            times = range(int(low), int(high or low) + 1)
            return [sum(way, ()) for n in times for way in product(item, repeat=n)], end + 1
        return item, at

    return either(0)[0]


def _members(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        if text.startswith("-", at + 1):
            yield from map(str, range(int(text[at]), int(text[at + 2]) + 1))
            at += 3
        else:
            yield text[at]
            at += 1


def plan_tables(spark: SparkSession, plan: Sequence[Region]) -> tuple[DataFrame, DataFrame]:
    """(dialling, prefixes) of a plan of patterns."""
    rows = set()
    for region in plan:
        for places in _spelled(region.pattern):
            kept = len(places)
            while kept and places[kept - 1] == _ALL:
                kept -= 1
            n = len(region.calling_code) + len(places)
            rows.update((region.region, region.calling_code + "".join(digits), n) for digits in product(*map(sorted, places[:kept])))
    dialling = [(r.region, r.calling_code, r.trunk, r.trunk_required, r.idd, k) for k, r in enumerate(plan)]
    return spark.createDataFrame(dialling, DIALLING), spark.createDataFrame(sorted(rows), PREFIXES)


def valid_numbers(numbers: DataFrame, prefixes: DataFrame, dialling: DataFrame) -> DataFrame:
    """digits and region of those of the distinct ``digits`` that the plan knows."""
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())  # 15 at most: no number is longer
    starts = F.array(*[F.when(F.length("digits") >= n, F.substring("digits", 1, n)) for n in lengths])
    tried = numbers.select("digits", F.explode(F.array_compact(starts)).alias("prefix"), F.length("digits").alias("n_digits"))
    found = tried.join(prefixes, ["prefix", "n_digits"]).join(dialling.select("region", "rank"), "region")
    order = F.struct(F.length("prefix"), -F.col("rank"))
    return found.groupBy("digits").agg(F.max_by("region", order).alias("region"))


def page_phones(pages: DataFrame, dialling: DataFrame, prefixes: DataFrame, phone_regions: list[str] | None = None) -> DataFrame:
    """The pages, without their HTML, with ``phones``: distinct E.164 numbers under the plan's tables.

    Regions follow each page's final URL if none are given. Pages need a distinct page_id.
    """
    regions = tuple(
        Region(r.region, r.calling_code, "", r.trunk or "", bool(r.trunk_required), r.idd or "00") for r in dialling.orderBy("rank").limit(MAX_REGIONS + 1).collect()
    )
    if len(regions) > MAX_REGIONS:
        raise ValueError(f"a plan of at most {MAX_REGIONS} regions is needed")
    work = Workspace(pages.sparkSession, "phones")
    given = F.array(*[F.lit(r) for r in phone_regions]).cast(NO_STRINGS) if phone_regions else F.lit(None).cast(NO_STRINGS)
    columns = [c for c in pages.columns if c != "html"]
    staged = page_candidates(pages).select(*columns, "runs", "dialled", "tel", effective_regions(given, "final_url").alias("regions"))
    staged = work.write(staged, "candidates")
    arrays = ("runs", "dialled", "tel", "regions")
    asked = staged.select("page_id", F.explode(readings_of_candidates(*arrays, KnownNumbers(regions, F.lit(None)))).alias("digits"))
    asked = work.write(asked.where(F.length("digits").between(5, 15)), "asked")
    valid = work.write(valid_numbers(asked.select("digits").distinct(), prefixes, dialling), "valid")
    # At most as many numbers a page as it has candidates.
    known = asked.join(valid, "digits").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("digits", "region"))).alias("known"))
    joined = staged.join(known, "page_id", "left")
    found = phones_of_candidates(*arrays, KnownNumbers(regions, F.col("known")))
    return joined.select(*columns, F.when(F.col("known").isNotNull(), found).otherwise(F.array().cast(NO_STRINGS)).alias("phones"))
