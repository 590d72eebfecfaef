import random
import re
import time

from pyspark.sql import functions as F

from reachmap.functions import emails, html

CLOAK = """<body><p>Write to <span id="m7">us</span></p><script>
var addy7f = "t&#101;am";
addy7f = addy7f + '&#x40;' + "p&#108;ants";
addy7f = addy7f + '.' + 'exampl&#101;';
var addy_text7f = 'h&#101;lp' + "&#64;plants.ex&#97;mple";
show("m7", addy7f, addy_text7f); // cloak
</script></body>"""


def test_candidates(value):
    cases = {
        "Root@Example.com, x": ["Root@Example.com"],
        "(a@b.com) <c@d.org>.": ["a@b.com", "c@d.org"],
        "éinfo@x.com": [],
        "é.info@x.com": ["info@x.com"],
        "-a@b.com": ["a@b.com"],
        "a@b..com": ["a@b..com"],
        "a@b.c": [],
        "a@b.comé": [],
        "x@y.com_z": [],
        "a@b@c.com": ["b@c.com"],
        "no mail": [],
    }
    assert value(emails.email_candidates("x"), list(cases)) == list(cases.values())


def test_candidates_are_the_matches_of_the_pattern(value):
    rng = random.Random(3)
    parts = ["a", "b1", "_", ".", "-", "+", "%", "@", "@x.com", "@y.co", " ", "é", "€", ",", "9", "..", "Z.org", "@q"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    expected = [[m.strip(emails.EDGE_PUNCTUATION) for m in re.findall(emails.EMAIL_PATTERN, t)] for t in texts]
    assert value(emails.email_candidates("x"), texts) == expected


def test_long_runs_take_linear_time(value):
    started = time.monotonic()
    assert value(emails.email_candidates("x"), ["%D0%BF" * 200_000 + " a@b.com"]) == [["a@b.com"]]
    assert time.monotonic() - started < 30


def test_mailto(value):
    rows = ["mailto:Sales%40b.com?subject=a@b", "MAILTO: a@b.com , c@d.com", "mailto:a+b%zz@c.com", "mailto:?to=x", "mailto:,a@b.com"]
    assert value(emails.mailto_address("x"), rows) == ["Sales@b.com", "a@b.com", "a+b%zz@c.com", "", ""]


def test_validation(value):
    good = ["a@b.co", "A.B+c@Sub.Example.COM", "o'neil@x.org", "a@xn--e1afmkfd.com", "x" * 64 + "@b.com", "a@" + "b" * 63 + ".com"]
    bad = [
        "a@b..com", ".a@b.com", "a.@b.com", "a..b@c.com", "a@-b.com", "a@b-.com", "a@b", "a@b.c0m1", "a@b.local", "a@b.test", "a@b.onion",
        "agmalis&gmail.com", "a b@c.com", "x" * 65 + "@b.com", "a@" + "b" * 64 + ".com", "a@ab--c.com", "@b.com", "", "a@@b.com", "a@b.com.",
    ]
    assert value(emails.normalize_email("x"), good) == [g.lower() for g in good]
    assert value(emails.normalize_email("x"), bad) == [None] * len(bad)


def test_cloaked(value):
    assert value(emails.cloaked_candidates("x"), [CLOAK]) == [["team@plants", "team@plants.example", "help@plants.example"]]
    assert value(emails.valid_emails(emails.cloaked_candidates("x")), [CLOAK]) == [["team@plants.example", "help@plants.example"]]


def test_long_literals_need_no_recursion(value):
    script = "<script>var addy1 = '" + "\\\\x" * 200_000 + "a@b.com'; cloak</script>"
    assert len(value(emails.cloaked_candidates("x"), [script])[0]) == 1


def test_cloak_details(value):
    def script(body):
        return f"<script>{body}</script>"

    cases = {
        script("var addy1 = 'a;b' + \"@c.com\"; addy2 = addy1 + addyX"): ["a;b@c.com", "a;b@c.com"],
        script("var addy1 = 'a@b.com'; addy1 += '@x.com'"): ["a@b.com"],
        script("VAR ADDY9='q@r.org'"): [],  # the words are looked for in lower case
        script("cloak;VAR ADDY9='q@r.org'"): ["q@r.org"],
        script("addy1 = 'a'; addy1 = ''; addy2 = addy1 + '@b.com'"): ["a@b.com"],
        script("cloak; other = 'a@b.com'"): [],
        # The apostrophe opens a string, which hides the semicolon.
        script("addy1 = 'x@y.com' // it's open; addy2 = 'z@w.com'"): ["x@y.coms open; addy2 = "],
        "<script>var a = 'a@b.com'</script>": [],
    }
    assert value(emails.cloaked_candidates("x"), list(cases)) == list(cases.values())


def test_statements(value):
    rows = ["a = 'x;y'; b = \"p;'q\";c", "a = 'it\\'s; ok'; b", "a = 'open; b"]
    assert value(emails.split_js_statements("x"), rows) == [["a = 'x;y'", "b = \"p;'q\"", "c"], ["a = 'it\\'s; ok'", "b"], ["a = 'open; b"]]


def test_long_script_does_not_exhaust_the_stack(value):
    body = "var addy1 = " + " + ".join(["'x'"] * 50_000) + " + '@b.com';"
    assert len(value(emails.cloaked_candidates("x"), [f"<script>{body}</script>"])[0]) == 1


def test_allowlist(value):
    allow = emails.parse_allowlist(F.lit(" @Gmail.com;.mail.ru,,gmail.com"))
    assert value(allow, ["x"]) == [["gmail.com", "mail.ru"]]
    assert value(emails.parse_allowlist("x"), [" , ;", None]) == [None, None]
    rows = ["a@gmail.com", "a@mail.ru", "admin@sub.mail.ru", "nope@yahoo.com", "a@notmail.ru"]
    assert value(emails.domain_allowed("x", allow), rows) == [True, True, True, False, False]
    assert value(emails.domain_allowed("x", F.lit(None).cast("array<string>")), rows[:1]) == [True]


def test_page(value):
    page = "good@example.com a@b..com <a href='mailto:good2%40example.com'>g</a><a href='mailto:agmalis%26gmail.com'>b</a><area href='mailto:no@x.com'> info<b>@</b>x.com"
    found = emails.emails_of_page(html.visible_text("x"), html.page_links("x"), F.col("x"))
    assert value(found, [page]) == [["good@example.com", "good2@example.com"]]
