"""Secret scans: patterns with fixed shapes, and a randomness test battery for everything else.

Patterns find assignments, access keys and long hexadecimal runs. The battery looks at every run of
at least ``MIN_LENGTH`` encoding characters. Its encoding is inferred from the characters it uses
(hex, base 32, base 62, base 64). A run is random if it passes for random and can't be ordinary:

* chi-squared of the character counts against a uniform alphabet (one-sided), Wald-Wolfowitz runs of
  the lower and upper half of the alphabet, and serial correlation of neighbouring characters'
  places (two-sided) must all leave it;
* its p-value is that of ordinary text: the chance that an ordinary run of this encoding and exact
  length speaks as much for a uniform alphabet. Ordinary runs are a chain of characters, counted by
  ``neighbours`` over all runs of the corpus that are too short to be candidates, so no candidate
  has a part in it. The likelihood ratio L of uniform to chain has mean 1 under the chain, so that
  chance is at most 1 / L (Markov). L uses which characters follow which, so it tells
  keys of 20 characters from text, where the three statistics alone can't.

The p-value must survive control of the false discovery rate at ``RATE`` (Benjamini-Hochberg), taken
within each encoding and length class, over the candidates of the whole corpus; the p-value of a run
that the battery turns away is 1. The thresholds come from a histogram of the p-values, one row
per encoding, length class and tenth of a decade, so no candidate leaves its row or its task.

All of it is DataFrame functions. Spans are in code points, ends exclusive. Base spans always stay;
a random run is added where it isn't inside a base span.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; extra
columns are ignored; without candidates there are no thresholds and nothing is added. The words of
``ORDINARY`` are counted with those of the corpus, so a table without ordinary text has a chain too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, group lengths and order of the base kinds.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]+"
MIN_LENGTH = 20
RATE = 0.01
LIMIT = 3.29  # of the battery's z: one in a thousand
SEEN = 0.9  # share of the chain that is counted; the rest is uniform, so no character speaks for more than a factor of 10
MILD = 20  # single characters' weight, as so many pairs, among the pairs after a character
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
ORDINARY = """The people who have not been here before will find that there is more than one way to read this page and
then write about what they think. Nothing without something; however, other words could make another question from
these. Der Mensch und die Natur sind nicht immer eine Einheit, aber wir haben auch andere Wege gesehen. Les hommes qui
sont dans la maison avec nous ne peuvent pas toujours parler comme elle. El hombre que vive en esta casa tiene una
vida para los otros y con ellos. Very long ordinary spaces, international information, understanding, 1990 to 2024."""
STEPS = 10  # histogram classes in a decade of p
FLOOR = 30  # p-values below 1e-30 share a class


def _matches(text: Column, pattern: str, least: int) -> Column:
    """array<struct<start, end, value>> of the pattern's matches in order, each at least ``least`` long.

    The pieces between the matches give their places. Texts without a match long enough to count are
    told by a search that stops at the first.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    gaps = F.slice(between, 1, F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["value"].alias("value"))
        spans = F.when(F.char_length(pair["value"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    pairs = F.zip_with(gaps, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.aggregate(pairs, start, add, lambda state: state["spans"])


def _where(text: Column, likely: str, spans: Column) -> Column:
    return F.when(text.rlike(likely), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _base_spans(text: Column) -> dict[str, Column]:
    # A shorter search tells most texts apart; runs of hexadecimal digits and access keys are maximal, so a bounded pattern finds the same.
    assign = _where(text, ASSIGN, _matches(text, ASSIGN, 0))
    return {
        "assign": F.filter(assign, lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_MIN),
        "access": _where(text, ACCESS, _matches(text, ACCESS, ACCESS_MIN)),
        "hex": _where(text, f"{HEX[:-1]}{{{HEX_MIN}}}", _matches(text, f"{HEX[:-1]}{{{HEX_MIN},}}", HEX_MIN)),
    }


def _encoding(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^[0-9a-f]+$") | value.rlike(r"^[0-9A-F]+$"), F.lit("hex"))
        .when(value.rlike(r"^[A-Z2-7]+$"), F.lit("base32"))
        .when(value.rlike(r"^[A-Za-z0-9]+$"), F.lit("base62"))
        .otherwise(F.lit("base64"))
    )


def neighbours(docs: DataFrame) -> Counter[str]:
    """Counts of neighbouring characters within the corpus's runs of fewer than ``MIN_LENGTH``.

    One row per pair of encoding characters reaches the driver: 4,356 at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run").between(2, MIN_LENGTH - 1)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    pairs = runs.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("run") - 1), lambda i: F.substring("run", i, F.lit(2)))).alias("pair"))
    found = Counter({r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()})
    for run in re.findall(CANDIDATE, ORDINARY):
        found.update(a + b for a, b in zip(run, run[1:], strict=False))
    return found


def chains(found: Counter[str]) -> dict[str, list[float]]:
    """By encoding, log10 of the chain's probabilities over the uniform ones: of each first character, then of each pair, row by row."""
    out = {}
    for kind, alphabet in ALPHABETS.items():
        fold = str.lower if kind in ("hex", "base32") else str
        alphabet = fold(alphabet)
        k, at = len(alphabet), {c: i for i, c in enumerate(alphabet)}
        pairs = [[0.0] * k for _ in range(k)]
        for pair, n in found.items():
            a, b = fold(pair)
            if a in at and b in at:
                pairs[at[a]][at[b]] += n
        single = [sum(row) + sum(other[i] for other in pairs) for i, row in enumerate(pairs)]
        single = [(n + 1) / (sum(single) + k) for n in single]
        after = [[(n + MILD * single[b]) / (sum(row) + MILD) for b, n in enumerate(row)] for row in pairs]
        out[kind] = [math.log10(SEEN * p * k + 1 - SEEN) for row in [single, *after] for p in row]
    return out


def _battery(span: Column, tables: dict[str, Column]) -> Column:
    """struct(encoding, length_class, p_class) of one candidate."""
    value = span["value"]
    encoding = _encoding(value)

    tests = F.coalesce(*[F.when(encoding == kind, _log_p(value, kind, tables[kind])) for kind in ALPHABETS])
    length_class = F.floor(F.log2(F.char_length(value).cast("double"))).cast("int")
    return F.struct(encoding.alias("encoding"), length_class.alias("length_class"), _class(tests).alias("p_class"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once."""
    return F.transform(F.array(value), use)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v)


def _next_to(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` of each value and the next."""
    return F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1), combine)


def _places(value: Column, alphabet: str) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))


def _log_p(value: Column, kind: str, table: Column) -> Column:
    """log10 of a run's p-value under ordinary text; 0 if the battery doesn't take it for random."""
    alphabet = ALPHABETS[kind]
    k = len(alphabet)
    folded = F.lower(value) if kind == "hex" else value
    # Words in capitals are as ordinary as others: without lower-case letters a run is read in lower case, at the price of a factor of 2.
    capitals = (value == F.upper(value)) if kind in ("base62", "base64") else F.lit(False)
    read = F.when(capitals, F.lower(value)).otherwise(folded)

    def of_chain(places: Column) -> Column:
        first = F.get(table, places[0] - 1)
        return first + _sum(_next_to(places, lambda a, b: F.get(table, a * k + b - 1))) - F.when(capitals, F.lit(math.log10(2))).otherwise(0.0)

    even = _let(F.transform(_places(folded, alphabet), lambda p: p.cast("double")), lambda places: _even(places, k))
    return F.when(even, F.least(_let(_places(read, alphabet), of_chain), F.lit(0.0))).otherwise(0.0)


def _even(places: Column, k: int) -> Column:
    """Whether chi-squared, runs and serial correlation leave a run as one of a uniform alphabet of k."""

    def of_moments(m: Column) -> Column:
        n = m["n"]
        z_chi = (F.cbrt(m["chi"] / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty
        high = F.transform(places, lambda p: (p > k / 2).cast("double"))
        off = F.transform(places, lambda p: p - m["mean"])
        sums = F.struct(
            _sum(high).alias("high"),
            (_sum(_next_to(high, lambda a, b: F.abs(a - b))) + 1).alias("runs"),
            _sum(F.transform(off, lambda d: d * d)).alias("square"),
            _sum(_next_to(off, lambda a, b: a * b)).alias("product"),
        )
        return _let(sums, lambda s: (z_chi < LIMIT) & (F.abs(z_runs(s, n)) < LIMIT) & (F.abs(z_serial(s, n)) < LIMIT))

    def z_runs(s: Column, n: Column) -> Column:
        expected = 2 * s["high"] * (n - s["high"]) / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        return F.when((s["high"] > 0) & (s["high"] < n), (s["runs"] - expected) / spread).otherwise(F.sqrt(n))

    def z_serial(s: Column, n: Column) -> Column:
        return F.when(s["square"] > 0, (s["product"] / s["square"] + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

    n = F.size(places).cast("double")
    counts = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda c: F.size(F.filter(places, lambda p: p == c)).cast("double"))
    return _let(F.struct(n.alias("n"), (_sum(places) / n).alias("mean"), (_sum(F.transform(counts, lambda c: c * c)) * k / n - n).alias("chi")), of_moments)


def _class(log_p: Column) -> Column:
    """The histogram class of a p-value: tenths of a decade, rounded towards 1, so never in favour of a candidate."""
    return F.least(F.floor(-log_p * STEPS), F.lit(FLOOR * STEPS)).cast("int")


def _candidates(text: Column, model: dict[str, list[float]]) -> Column:
    tables = {kind: F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>") for kind, values in model.items()}
    pattern = f"{CANDIDATE[:-1]}{{{MIN_LENGTH},}}"
    spans = _where(text, pattern, _matches(text, pattern, MIN_LENGTH))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _battery(s, tables).alias("test")))


def thresholds(docs: DataFrame, model: dict[str, list[float]], rate: float = RATE) -> dict[tuple[str, int], int]:
    """By encoding and length class, the least p class that the false discovery control accepts.

    One row per encoding, length class and p class reaches the driver: a few thousand at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = docs.select(F.explode(_candidates(text, model)).alias("c")).select("c.test.*")
    rows = tests.groupBy("encoding", "length_class", "p_class").agg(F.count(F.lit(1)).alias("n")).collect()
    found: dict[tuple[str, int], int] = {}
    for stratum in {(r.encoding, r.length_class) for r in rows}:
        own = sorted(((r.p_class, r.n) for r in rows if (r.encoding, r.length_class) == stratum), reverse=True)
        total, seen = sum(n for _, n in own), 0
        for p_class, n in own:  # from the smallest p-values on
            seen += n
            if 10.0 ** (-p_class / STEPS) <= rate * seen / total:
                found[stratum] = p_class
    return found


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document: doc_id and arrays of struct(start, end, kind): base and all spans in order."""
    model = chains(neighbours(docs))
    least = thresholds(docs, model, rate)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = _base_spans(F.col("_text"))
    rank = {kind: number for number, kind in enumerate(KINDS)}

    def placed(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[kind]).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = docs.select("doc_id", text.alias("_text"))
    rows = rows.select("doc_id", "_text", *[placed(spans, kind).alias(kind) for kind, spans in kinds.items()])
    base = F.array_sort(F.concat("assign", "access", "hex"))

    def accepted(c: Column) -> Column:
        t = c["test"]
        by_class = [((t["encoding"] == e) & (t["length_class"] == n) & (t["p_class"] >= p)) for (e, n), p in sorted(least.items())]
        any_class = F.lit(False)
        for one in by_class:
            any_class = any_class | one
        return any_class

    rows = rows.withColumn("base", base)
    random = F.filter(_candidates(F.col("_text"), model), accepted) if least else F.array().cast("array<struct<start:int,end:int>>")
    random = F.filter(random, lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    return rows.select("doc_id", *KINDS[:3], "base", F.array_sort(F.concat("base", placed(random, "random"))).alias("spans"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, digest of the base spans, all spans."""

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return find_secrets(docs).select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
