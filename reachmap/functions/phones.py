"""Phone number expressions: candidates, parsing, validation against a numbering plan, E.164.

Everything maps one page to an array of numbers inside the scan stage: no explode, no shuffle,
no join. The plan is code-sized, so its patterns are literals which Spark compiles once a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import anchor_hrefs
from .numbering import NUMBERING_PLAN, Region
from .text import as_column, bind, literal_map, split_list, strip, url_unquote
from .urls import UNKNOWN_REGION, phone_region_of_url

# Decimal digits: ASCII, full-width, Arabic-Indic and extended Arabic-Indic.
_D = r"0-9\uff10-\uff19\u0660-\u0669\u06f0-\u06f9"
_WIDE_DIGITS = "".join(chr(start + d) for start in (0xFF10, 0x0660, 0x06F0) for d in range(10))

# Fixed value: numbers written with an international dialling prefix.
IDD_PATTERN = r"(?:^|[^\d+])((?:00|011)[\s().-]*[1-9](?:[\s().-]*\d){6,})"
# The same numbers found from their first digit on, without giving characters back.
_FIND_IDD = rf"0(?<![{_D}+]0)(?:0|11)[\s\p{{Z}}().-]*+[1-9](?:[\s\p{{Z}}().-]*+[{_D}]){{6,}}+"

_PLUS = r"+\uff0b"
_LEAD = rf"[(\[\uff08\uff3b{_PLUS}]"
_PUNCT = (
    r"[-x\u2010-\u2015\u2212\u30fc\uff0d-\uff0f \u00a0\u00ad\u200b\u2060\u3000"
    r"()\uff08\uff09\uff3b\uff3d.\[\]/~\u2053\u223c]"
)
_RUN = rf"(?:{_LEAD}{_PUNCT}{{0,4}}+){{0,2}}[{_D}]{{1,20}}+(?:{_PUNCT}{{0,4}}+[{_D}]{{1,20}}+){{0,20}}+"
# A Latin letter, percent or currency sign that touches a number makes it something else.
_SPOILER = r"\p{IsLatin}%\p{Sc}"
# Digits right behind such a character are skipped; the character behind a run is read along.
# The look-aheads come first: at most places of a text the plain one fails after one look-up.
_RUN_IN_CONTEXT = (
    rf"(?s)(?![a-zA-Z ,.])(?=[{_D}(\[\uff08\uff3b{_PLUS}])"
    rf"(?:(?:(?<![{_SPOILER}])|(?={_LEAD}))({_RUN}[^(\[\uff08\uff3b{_PLUS}{_D}]?)|[{_D}]{{1,20}}+)"
)
_ENOUGH_DIGITS = rf"(?:[{_D}][^{_D}]*){{5}}"

_OPEN, _CLOSE = r"[(\[\uff08\uff3b]", r"[)\]\uff09\uff3d]"
_INSIDE = r"[^()\[\]\uff08\uff09\uff3b\uff3d]"
_BRACKETS_MATCH = (
    rf"^(?:{_OPEN})?(?:{_INSIDE}+{_CLOSE})?{_INSIDE}+(?:{_OPEN}{_INSIDE}+{_CLOSE}){{0,3}}{_INSIDE}*$"
)
_PUBLICATION_PAGES = r"\d{1,5}-+\d{1,5}\s{0,4}\(\d{1,4}"
_DATE = r"(?:[0-3]?\d/[01]?\d|[01]?\d/[0-3]?\d)/(?:[12]\d)?\d{2}"
_TIMESTAMP = r"[12]\d{3}[-/]?[01]\d[-/]?[0-3]\d +[0-2]\d:$"
_EXTENSION = r"(?i)(?:[ \u00a0]*(?:x|#|ext\.?)[ \u00a0.]*\d{1,7})$"
# Letters of a number that has at least three stand for the digits of their keys.
_SPELLED = r"(?s)^(?:[^A-Za-z]*[A-Za-z]){3}"
_KEYS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
_LEADING_JUNK = rf"^(?:[^{_D}{_SPOILER}{_PLUS}(\[\uff08\uff3b]+|[{_SPOILER}](?={_LEAD}))"
_TRAILING_JUNK = rf"[^{_D}{_SPOILER}]+$"
# Where a run that is no number as a whole is cut, in the order tried.
_CUTS = (r"/+", r"(?=\()", r"\s-|-\s", r"[\u2012-\u2015\uff0d]\s*", r"\.+\s*", r"\s+")


def _none() -> Column:
    return F.array().cast("array<string>")


class KnownNumbers(NamedTuple):
    """A plan whose valid numbers were looked up beforehand: those a row may need, with their regions.

    ``regions`` says how numbers are dialled, ``numbers`` is a map column from full numbers to their region.
    """

    regions: tuple[Region, ...]
    numbers: Column


Plan = Sequence[Region] | KnownNumbers


def _rows(plan: Plan) -> tuple[Region, ...]:
    return plan.regions if isinstance(plan, KnownNumbers) else tuple(plan)


def normalize_regions(regions: Column | str) -> Column:
    """Region codes: trimmed, upper-cased, blanks and ``ZZ`` dropped, distinct, in order."""
    cleaned = F.transform(as_column(regions), lambda r: F.upper(strip(r)))
    keep = F.filter(cleaned, lambda r: r.isNotNull() & (r != "") & (r != UNKNOWN_REGION))
    return F.array_distinct(keep)


def parse_regions(option: Column | str) -> Column:
    """Regions written as one string; NULL if nothing is left."""
    regions = normalize_regions(split_list(option))
    return F.when(F.size(regions) > 0, regions)


def effective_regions(configured: Column | str, page_url: Column | str) -> Column:
    """The configured regions, or the one the site's top-level domain suggests, or none.

    A configured list without usable entries gives none: it still switches inference off.
    """
    configured = as_column(configured)
    inferred = phone_region_of_url(page_url)
    return F.when(F.coalesce(F.size(configured) > 0, F.lit(False)), normalize_regions(configured)).otherwise(
        F.when(inferred != UNKNOWN_REGION, F.array(inferred)).otherwise(_none())
    )


def is_valid_number(digits: Column, plan: Plan = NUMBERING_PLAN) -> Column:
    """True if the digits are a full international number that exists in the plan."""
    if isinstance(plan, KnownNumbers):
        return F.map_contains_key(plan.numbers, digits)
    return digits.rlike("^(?:" + "|".join(f"{r.calling_code}(?:{r.pattern})" for r in plan) + ")$")


def number_region(digits: Column, plan: Plan = NUMBERING_PLAN) -> Column:
    """Region of a full international number given as digits; NULL if it is not a valid number."""
    if isinstance(plan, KnownNumbers):
        return F.try_element_at(plan.numbers, digits)
    by_code: dict[str, list[Region]] = {}
    for row in plan:
        by_code.setdefault(row.calling_code, []).append(row)

    def of_code(code: str, rows: list[Region]) -> Column:
        regions = [F.when(digits.rlike(f"^{code}(?:{r.pattern})$"), F.lit(r.region)) for r in rows]
        return F.when(digits.startswith(code), F.coalesce(*regions) if len(regions) > 1 else regions[0])

    # Literal patterns are compiled once a task; no calling code begins another.
    return F.coalesce(*[of_code(code, rows) for code, rows in by_code.items()], F.lit(None).cast("string"))


def _drop_inner_trunk(digits: Column, plan: Plan) -> Column:
    """``44 0 20...`` -> ``44 20...``: the trunk prefix wrongly kept after the calling code."""
    rules = "|".join(sorted({f"{r.calling_code}(?={r.trunk})" for r in _rows(plan) if r.trunk}))
    return F.regexp_replace(digits, f"^({rules}).", "$1") if rules else digits


def ascii_digits(raw: Column) -> Column:
    """Only the digits, in ASCII."""
    ascii_form = F.translate(raw, _WIDE_DIGITS, "0123456789" * (len(_WIDE_DIGITS) // 10))
    return F.regexp_replace(ascii_form, "[^0-9]+", "")


def written_with_plus(raw: Column) -> Column:
    return raw.rlike(rf"^[^{_D}{_PLUS}]*[{_PLUS}]")


def _plan_columns(plan: tuple[Region, ...]) -> tuple[dict[str, str], ...]:
    """Per region: calling code, international prefix, trunk prefix, whether text must show it.

    Trunk prefixes are one character; several alternatives are written as a set of them.
    """
    return (
        {r.region: r.calling_code for r in plan},
        {r.region: r.idd for r in plan},
        {r.region: r.trunk.strip("[]") for r in plan},
        {r.region: "yes" if r.trunk_required else "no" for r in plan},
    )


def phone_readings(raw: Column | str, region: Column | None = None, plan: Plan = NUMBERING_PLAN, in_text: bool = False) -> Column:
    """What the digits of a number may mean, as full international digits, in the order tried; NULL or empty if nothing.

    With ``+`` it is the number itself; else, dialled from ``region``, what stands behind the international
    prefix, behind the trunk prefix, a bare national number, or the calling code without ``+``. ``in_text``
    asks bare local numbers for the trunk prefix where the plan requires it. A NULL or empty region reads
    only numbers with ``+``.
    """
    raw = as_column(raw)

    def abroad(digits: Column) -> Column:
        return F.array(digits, _drop_inner_trunk(digits, plan))

    def readings(digits: Column) -> Column:
        if region is None:
            return F.when(written_with_plus(raw), abroad(digits))
        code, idd, trunk, required = (
            F.try_element_at(literal_map(column), region) for column in _plan_columns(_rows(plan))
        )
        rest = F.substring(digits, F.lit(2), F.length(digits))
        behind_trunk = F.when((trunk != "") & F.contains(trunk, F.substring(digits, 1, 1)), F.concat(code, rest))
        bare = F.concat(code, digits)
        if in_text:
            bare = F.when(required == "no", bare)
        local = F.array(behind_trunk, bare, F.when(digits.startswith(code), digits))
        dialled = F.when(
            digits.startswith(idd),
            abroad(F.substring(digits, F.length(idd) + F.lit(1), F.length(digits))),
        ).otherwise(_none())
        return F.when(written_with_plus(raw), abroad(digits)).when(
            code.isNotNull(), F.concat(dialled, local)
        )

    return bind(ascii_digits(raw), readings)


def parse_phone(raw: Column | str, region: Column | None = None, plan: Plan = NUMBERING_PLAN, in_text: bool = False) -> Column:
    """Calling code and national number, as digits, of a valid number: the first valid reading; NULL if none is."""
    found = phone_readings(raw, region, plan, in_text)
    valid = F.filter(found, lambda d: F.coalesce(is_valid_number(d, plan), F.lit(False)))
    return F.try_element_at(valid, F.lit(1))


def region_allowed(digits: Column, regions: Column, plan: Plan = NUMBERING_PLAN) -> Column:
    """True if no regions are given or the number's own region is one of them."""
    return (F.size(regions) <= 0) | F.coalesce(
        F.array_contains(regions, number_region(digits, plan)), F.lit(False)
    )


def _keep(numbers: Column, regions: Column, plan: Plan) -> Column:
    return F.filter(numbers, lambda d: d.isNotNull() & region_allowed(d, regions, plan))


def spans_overlap(first_start: Column, first_end: Column, second_start: Column, second_end: Column) -> Column:
    """True if two half-open spans share a place."""
    return (first_start < second_end) & (second_start < first_end)


def format_e164(digits: Column) -> Column:
    return F.concat(F.lit("+"), digits)


def normalize_idd_prefix(raw: Column | str) -> Column:
    """Trim and write a leading ``00`` or ``011`` as ``+``."""
    return F.regexp_replace(strip(raw), "^(?:00|011)", "+")


def phone_runs(text: Column | str) -> Column:
    """Maximal runs of digits and phone punctuation; the same for every region."""
    runs = F.regexp_extract_all(as_column(text), F.lit(_RUN_IN_CONTEXT), F.lit(1))
    return F.filter(runs, lambda r: r.rlike(_ENOUGH_DIGITS))


_SPANS = "array<struct<text:string,start:int,end:int>>"


def _placed(run: Column, pieces: Column) -> Column:
    """Pieces of a run, in order, with their spans; those that can be numbers.

    No digit stands between two pieces, so the next occurrence of a piece is the piece itself.
    """
    begin = F.struct(F.lit(1).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def add(state: Column, text: Column) -> Column:
        def at(start: Column) -> Column:
            end = start + F.length(text)
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(text.alias("text"), start.alias("start"), end.alias("end")))).alias("spans"))

        return bind(F.position(text, run, state["at"]), at)

    spans = F.aggregate(pieces, begin, add, lambda state: state["spans"])
    plain = F.transform(spans, lambda s: F.struct(F.regexp_replace(s["text"], _EXTENSION, "").alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return F.filter(
        plain,
        lambda s: s["text"].rlike(_ENOUGH_DIGITS)
        & ~s["text"].rlike(rf"^[{_SPOILER}]|[{_SPOILER}]$")
        & s["text"].rlike(_BRACKETS_MATCH)
        & ~s["text"].rlike(_PUBLICATION_PAGES),
    )


def _usable(run: Column) -> Column:
    return ~run.rlike(_DATE) & ~run.rlike(_TIMESTAMP)


def _pieces(run: Column, parts: Column) -> Column:
    """The parts of a run without what can't belong to a number, those that can be numbers, with their spans."""
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, f"{_LEADING_JUNK}|{_TRAILING_JUNK}", ""))
    return _placed(run, F.filter(trimmed, lambda p: p != ""))


def _cut(run: Column, way: Column) -> Column:
    """The parts of a run under one way to cut it, none if it can't be cut so."""
    parts = _none()
    for number, cut in enumerate(_CUTS):
        parts = F.when(way == number, F.when(run.rlike(cut), F.split(run, cut)).otherwise(_none())).otherwise(parts)
    return parts


def phones_of_text(
    text: Column | str, regions: Column | str, plan: Sequence[Region] = NUMBERING_PLAN
) -> Column:
    """E.164 numbers in running text: regional, with ``+``, and with a dialling prefix."""
    text = as_column(text)
    return phones_of_candidates(phone_runs(text), idd_candidates(text), _none(), regions, plan)


def phones_of_candidates(
    runs: Column | str,
    dialled: Column | str,
    tel: Column | str,
    regions: Column | str,
    plan: Plan = NUMBERING_PLAN,
) -> Column:
    """Distinct E.164 numbers of a page's candidates: digit runs, dialled numbers, tel links.

    The candidates don't depend on the region, so they can be stored and read again later.
    A run is read from each region in turn; numbers whose spans overlap those of earlier regions
    are skipped. On its own it is also read as an international number. If a run is no number as
    a whole, its pieces are tried.
    """
    regions = as_column(regions)
    # The empty region stands for "international only" and comes last.
    points_of_view = F.concat(regions, F.array(F.lit("")))

    def read(pieces: Column, region: Column) -> Column:
        numbers = F.transform(
            pieces,
            lambda p: F.struct(parse_phone(p["text"], region, plan, in_text=True).alias("digits"), p["start"].alias("start"), p["end"].alias("end")),
        )
        return F.filter(numbers, lambda n: n["digits"].isNotNull())

    def first_hit(run: Column, whole: Column, region: Column) -> Column:
        """Numbers of the run as a whole, else of the first way to cut it that gives any; later ways aren't tried."""

        def further(found: Column, way: Column) -> Column:
            return F.when(F.size(found) > 0, found).otherwise(read(_pieces(run, _cut(run, way)), region))

        ways = F.sequence(F.lit(0), F.lit(len(_CUTS) - 1))
        hit = bind(read(whole, region), lambda found: F.when(F.size(found) > 0, found).otherwise(F.aggregate(ways, nothing, further)))
        # Without a region only numbers with + are read, and cutting brings none.
        readable = (region != "") | run.rlike(f"[{_PLUS}]")
        return F.when(readable, F.filter(hit, lambda n: region_allowed(n["digits"], regions, plan))).otherwise(nothing)

    nothing = F.array().cast("array<struct<digits:string,start:int,end:int>>")

    def free(taken: Column, found: Column) -> Column:
        def clear(n: Column) -> Column:
            return ~F.exists(taken, lambda t: spans_overlap(t["start"], t["end"], n["start"], n["end"]))

        return F.concat(taken, F.filter(found, clear))

    def of_run(run: Column) -> Column:
        def pick(views: Column) -> Column:
            regional = F.aggregate(F.slice(views, F.lit(1), F.size(regions)), nothing, free)
            return F.transform(F.concat(regional, F.element_at(views, -1)), lambda n: n["digits"])

        def views(whole: Column) -> Column:
            return bind(F.transform(points_of_view, lambda r: first_hit(run, whole, r)), pick)

        return F.when(_usable(run), bind(_pieces(run, F.array(run)), views)).otherwise(_none())

    def of_tel(number: Column) -> Column:
        read = F.transform(points_of_view, lambda r: parse_phone(number, r, plan))
        return F.try_element_at(F.filter(read, lambda d: d.isNotNull()), F.lit(1))

    in_runs = F.flatten(F.transform(as_column(runs), of_run))
    in_dialled = F.transform(as_column(dialled), lambda c: parse_phone(c, None, plan))
    in_tel = F.transform(as_column(tel), of_tel)
    numbers = F.array_distinct(F.concat(in_runs, _keep(F.concat(in_dialled, in_tel), regions, plan)))
    return F.transform(numbers, format_e164)


def readings_of_candidates(runs: Column | str, dialled: Column | str, tel: Column | str, regions: Column | str, plan: Plan) -> Column:
    """Every full number that ``phones_of_candidates`` may ask about, valid or not, distinct."""
    points_of_view = F.concat(as_column(regions), F.array(F.lit("")))

    def seen(pieces: Column, in_text: bool) -> Column:
        return F.flatten(F.transform(points_of_view, lambda r: F.flatten(F.transform(pieces, lambda p: F.coalesce(phone_readings(p, r, plan, in_text), _none())))))

    def of_run(run: Column) -> Column:
        ways = F.sequence(F.lit(0), F.lit(len(_CUTS) - 1))
        parts = F.concat(F.array(run), F.flatten(F.transform(ways, lambda way: _cut(run, way))))
        # Each part's span was only needed to tell overlaps; here its text is enough.
        trimmed = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, f"{_LEADING_JUNK}|{_TRAILING_JUNK}", ""), _EXTENSION, ""))
        return F.when(_usable(run), seen(F.filter(trimmed, lambda p: p.rlike(_ENOUGH_DIGITS)), True)).otherwise(_none())

    in_dialled = F.flatten(F.transform(as_column(dialled), lambda c: F.coalesce(phone_readings(c, None, plan), _none())))
    found = F.concat(F.flatten(F.transform(as_column(runs), of_run)), in_dialled, seen(as_column(tel), False))
    return F.array_distinct(F.filter(found, lambda d: d.isNotNull()))


def idd_candidates(text: Column | str) -> Column:
    """Numbers written with ``00`` or ``011``, rewritten to start with ``+``."""
    found = F.regexp_extract_all(as_column(text), F.lit(_FIND_IDD), F.lit(0))
    return F.transform(found, normalize_idd_prefix)


def tel_number(href: Column | str) -> Column:
    """The number of a tel href: no query, no parameters, percent-decoded, trimmed.

    An extension is left out; letters of a spelled-out number become digits.
    """
    target = F.regexp_replace(as_column(href), r"(?s)^[^:]*:", "")
    number = strip(url_unquote(F.substring_index(F.substring_index(target, "?", 1), ";", 1)))
    number = F.regexp_replace(number, _EXTENSION, "")
    letters, digits = _KEYS
    return F.when(number.rlike(_SPELLED), F.translate(number, letters + letters.lower(), digits * 2)).otherwise(number)


def tel_candidates(links: Column | str) -> Column:
    numbers = F.transform(anchor_hrefs(links, "tel"), lambda h: normalize_idd_prefix(tel_number(h)))
    return F.filter(numbers, lambda n: n != "")


def phones_of_tel(
    candidates: Column | str, regions: Column | str, plan: Sequence[Region] = NUMBERING_PLAN
) -> Column:
    """E.164 numbers of tel links; a local one is read in the first region that makes it valid."""
    return phones_of_candidates(_none(), _none(), candidates, regions, plan)


def phones_of_page(
    text: Column | str, links: Column | str, regions: Column | str, plan: Sequence[Region] = NUMBERING_PLAN
) -> Column:
    """Distinct E.164 numbers of a page from its text and its tel links."""
    text = as_column(text)
    return phones_of_candidates(
        phone_runs(text), idd_candidates(text), tel_candidates(links), regions, plan
    )
