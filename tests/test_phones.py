import random
import re

from pyspark.sql import functions as F

from reachmap.functions import html, phones
from reachmap.functions.numbering import NUMBERING_PLAN, Region
from reachmap.functions.urls import TLD_REGIONS
from reachmap.operators import phone_plan


def regions(*codes):
    return F.array(*[F.lit(c) for c in codes]).cast("array<string>")


def in_text(value, text, *codes):
    return value(phones.phones_of_text("x", regions(*codes)), [text])[0]


def test_regional(value):
    assert in_text(value, "call 8 (800) 555-35-35 now", "RU", "US") == ["+78005553535"]
    assert in_text(value, "call 8 (800) 555-35-35 now") == []
    assert in_text(value, "(415) 555-2671", "US", "RU") == ["+14155552671"]
    assert in_text(value, "415-555-2671 and 4155552672", "US") == ["+14155552671", "+14155552672"]
    assert in_text(value, "020 7946 0018", "GB") == ["+442079460018"]
    assert in_text(value, "20 7946 0018", "GB") == []  # the trunk prefix is missing
    assert in_text(value, "030 901820", "DE") == ["+4930901820"]


def test_first_region_that_accepts_decides(value):
    assert in_text(value, "9162345678", "RU", "US") == ["+79162345678"]
    assert in_text(value, "9162345678", "US", "RU") == ["+19162345678"]


def test_international(value):
    assert in_text(value, "+7 953 640-53-68, +1 (415) 555-2671") == ["+79536405368", "+14155552671"]
    assert in_text(value, "+44 (0)20 7946 0018") == ["+442079460018"]
    assert in_text(value, "+1 (017) 555-2671") == []
    assert in_text(value, "+1 (415) 555-2671 x99") == ["+14155552671"]
    assert in_text(value, "＋7 (953) 640-53-68") == ["+79536405368"]


def test_region_filter(value):
    text = "RU: +7 (800) 555-35-35\nUS: +1 (415) 555-2671"
    assert in_text(value, text, "US") == ["+14155552671"]
    assert in_text(value, text) == ["+78005553535", "+14155552671"]


def test_idd(value):
    assert in_text(value, "Local: 8 (800) 555-35-35\nIDD: 00 7 953 640-53-68\nx") == ["+79536405368"]
    assert in_text(value, "011 44 20 7946 0018") == ["+442079460018"]
    assert in_text(value, "9007 953 640-53-68 1+00 7 953 640-53-68") == []
    assert value(phones.normalize_idd_prefix("x"), [" 007 ", "0117", "+7", "07"]) == ["+7", "+7", "+7", "07"]


def test_what_is_no_number(value):
    for text in ("A9161234567", "9161234567%", "9161234567b", "12/10/2024 9161234567", "2012-01-02 08:00", "12-345 (67) 8901234"):
        assert in_text(value, text, "RU") == [], text


def test_runs_of_several_numbers(value):
    assert in_text(value, "8 (800) 555-35-35 / 8 (953) 640-53-68", "RU") == ["+78005553535", "+79536405368"]
    # Cut at "(" first, the middle piece keeps the next number's 8 and is none.
    assert in_text(value, "8 (800) 555-35-35 - 8 (953) 640-53-68", "RU") == ["+79536405368"]
    # An attached foreign piece spoils the whole and no single piece is a number.
    assert in_text(value, "+1 (415) 555-2671 190.12") == []


def test_tel(value):
    page = "<a href='tel:02081234567'>l</a><a href='tel:00 1 415 555 2671'>i</a><a href='TEL:+7%20(800)%20555-35-35;ext=5?x'>p</a><area href='tel:+14155552672'>"
    found = phones.phones_of_tel(phones.tel_candidates(html.page_links("x")), regions())
    assert value(found, [page]) == [["+14155552671", "+78005553535"]]
    found = phones.phones_of_tel(phones.tel_candidates(html.page_links("x")), regions("US", "GB"))
    assert value(found, [page]) == [["+442081234567", "+14155552671"]]


def test_tel_extensions_and_letters(value):
    page = "<a href='tel:+1-415-555-2671x123'>a</a><a href='tel:+1 415 555 2672 ext. 5'>b</a><a href='tel:1-800-FLOWERS'>c</a><a href='tel:+1-415-555-2673#9'>d</a>"
    found = phones.phones_of_tel(phones.tel_candidates(html.page_links("x")), regions("US"))
    assert value(found, [page]) == [["+14155552671", "+14155552672", "+18003569377", "+14155552673"]]


def test_several_regions_in_one_run(value):
    texts = ["8 (953) 640-53-68 / (212) 555-2671", "8 (953) 640-53-68, (212) 555-2671", "(212) 555-2671 / 8 (953) 640-53-68"]
    both = ["+79536405368", "+12125552671"]
    assert [sorted(v) for v in value(phones.phones_of_text("x", regions("RU", "US")), texts)] == [sorted(both)] * 3
    assert [sorted(v) for v in value(phones.phones_of_text("x", regions("US")), texts)] == [[both[1]]] * 3


def test_fast_idd_pattern_finds_what_the_plain_one_does(value):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["00", "011", "0", "1", "7", "555", " ", "-", "(", ")", "+", "x", ".", "640"]) for _ in range(rng.randint(4, 18))) for _ in range(1500)]
    wanted = [[re.sub("^(?:00|011)", "+", m.strip()) for m in re.findall(phones.IDD_PATTERN, t)] for t in texts]
    assert value(phones.idd_candidates("x"), texts) == wanted and sum(map(len, wanted)) > 100


def test_regions(value):
    assert value(phones.parse_regions("x"), ["ru; BY,zz,,ru", "ZZ", None]) == [["RU", "BY"], None, None]
    configured = F.when(F.col("x") == "cfg", F.array(F.lit("zz"), F.lit("us"))).when(F.col("x") == "zz", F.array(F.lit("ZZ")))
    rows = ["cfg", "zz", "https://a.ru/", "https://a.com/"]
    assert value(phones.effective_regions(configured, F.col("x")), rows) == [["US"], [], ["RU"], []]


def test_every_region_of_the_plan(value):
    """One number a region, valid internationally and owned by its region."""
    samples = {
        "US": "14155552671", "CA": "16135550123", "KZ": "77272345678", "RU": "79161234567", "BY": "375291234567", "UA": "380501234567",
        "KG": "996700123456", "UZ": "998901234567", "AM": "37410123456", "AZ": "994501234567", "GE": "995591123456", "MD": "37369123456",
        "EE": "3726123456", "LV": "37121234567", "LT": "37061234567", "PL": "48512345678", "DE": "493012345678", "FR": "33123456789",
        "IT": "390612345678", "ES": "34612345678", "PT": "351912345678", "NL": "31612345678", "BE": "32470123456", "CH": "41781234567",
        "AT": "436641234567", "SE": "46701234567", "NO": "4741234567", "FI": "358401234567", "DK": "4531234567", "IE": "353861234567",
        "GB": "447912345678", "AU": "61412345678", "NZ": "64211234567", "JP": "81312345678", "CN": "8613812345678", "IN": "919876543210",
    }
    assert set(samples) == set(TLD_REGIONS.values())
    samples |= {
        "BR": "5511912345678", "MX": "525512345678", "TR": "905321234567", "IL": "972501234567", "ZA": "27821234567",
        "KR": "821012345678", "SG": "6581234567", "GR": "306912345678", "CZ": "420601123456", "DO": "18092345678",
    }
    rows = list(samples.values())
    assert value(phones.number_region(F.col("x")), rows) == list(samples)
    assert value(phones.parse_phone(F.concat(F.lit("+"), "x")), rows) == rows


def test_plan_is_well_formed():
    regions_ = [r.region for r in NUMBERING_PLAN]
    assert len(set(regions_)) == len(regions_) < 200
    codes = {r.calling_code for r in NUMBERING_PLAN}
    assert not [c for c in codes for d in codes if c != d and d.startswith(c)]  # no code begins another
    assert all(len(r.trunk.strip("[]")) <= 2 for r in NUMBERING_PLAN)


def test_spans(value):
    first = phones.spans_overlap(F.lit(0), F.lit(5), F.col("a"), F.col("b"))
    assert value(first, [(5, 9), (4, 9), (-3, 0), (-3, 1), (1, 2)], "a int, b int") == [False, True, False, True, True]


def test_own_plan(value):
    plan = (Region("XX", "999", r"[1-9]\d{3}", "0"),)
    assert value(phones.phones_of_text("x", regions("XX"), plan), ["0 1234 or +999 5678"]) == [["+9991234", "+9995678"]]


def test_patterns_as_prefixes(spark):
    """The prefix table accepts what the patterns accept, for every region, and nothing else."""
    _, prefixes = phone_plan.plan_tables(spark, NUMBERING_PLAN)
    rows = {}
    for r in prefixes.collect():
        rows.setdefault((r.region, r.n_digits), set()).add(r.prefix)
    rng = random.Random(8)
    for region in NUMBERING_PLAN:
        sizes = [n for name, n in rows if name == region.region]
        for _ in range(150):
            n = rng.choice(sizes) + rng.choice([0, 0, 0, -1, 1])
            start = rng.choice(sorted(rows[region.region, rng.choice(sizes)]))
            digits = start[: rng.randint(len(region.calling_code), len(start))]
            digits += "".join(rng.choice("0123456789") for _ in range(n - len(digits)))
            found = any(digits.startswith(p) for p in rows.get((region.region, len(digits)), ()))
            assert found == bool(re.fullmatch(f"{region.calling_code}(?:{region.pattern})", digits)), (region.region, digits)


def test_plan_of_many_prefixes(spark):
    """A hundred thousand prefixes, of which the longest that fits decides."""
    dialling = spark.createDataFrame([("XX", "999", "0", False, "00", 0), ("YY", "999", "", False, "00", 1)], phone_plan.DIALLING)
    many = spark.range(100_000).select(F.lit("XX").alias("region"), F.concat(F.lit("999"), F.format_string("%05d", "id")).alias("prefix"), F.lit(11).alias("n_digits"))
    prefixes = many.unionByName(spark.createDataFrame([("YY", "999123456", 11), ("YY", "9997", 9)], phone_plan.PREFIXES))
    pages = spark.createDataFrame(
        [(1, "http://a.com/", "call +999 12345 999 or +999 12345 678, not +999 7 12345 67 8"), (2, "http://a.com/", "+999 70 12 34"), (3, "http://a.com/", None), (4, "http://a.com/", "none")],
        "page_id long, final_url string, html string",
    )
    found = {r.page_id: sorted(r.phones) for r in phone_plan.page_phones(pages, dialling, prefixes).collect()}
    assert found == {1: ["+99912345678", "+99912345999"], 2: ["+999701234"], 3: [], 4: []}
    only = {r.page_id: r.phones for r in phone_plan.page_phones(pages, dialling, prefixes, ["YY"]).collect()}
    assert only == {1: ["+99912345678"], 2: ["+999701234"], 3: [], 4: []}
