"""Collocations against plain counting; the given tables are compared with SQL in test_queries."""

import random
import re
from collections import Counter

import pytest

from reachmap.llm.phrases import collocations, maximal_phrases


def plain(rows, least, top=2000, longest=5):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {key: n for key, n in counts.items() if len(key[1]) > 1 and n >= least}
    inside = {(lang, p[i:j]) for (lang, p), n in often.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and often.get((lang, p[i:j]), -1) == n}
    out = {}
    for (lang, p), a in often.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def made_rows():
    draw = random.Random(11)
    rows = [(None, None), ("en", ""), ("en", " \t\n.,"), ("xx", "one word")]
    refrain = "we the undersigned do hereby agree to all of the terms above and below"
    for _ in range(300):
        words = [draw.choice(["a", "b", "c", "the", "The", "é", "漢", "x\x85", "\u2028", "nul\x00"]) for _ in range(draw.randint(1, 30))]
        text = "".join(w + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        rows.append((draw.choice(["en", "en", "de", None, "und"]), text + (refrain if draw.random() < 0.5 else "")))
    return rows + [("en", "na " * 500), ("loop", "p q r s t u " * 200)]


@pytest.mark.parametrize("slots", [1 << 24, 64])
def test_made_rows(spark, slots):
    """With few slots no bound prunes, and the result stays."""
    rows = made_rows()
    table = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations(table, least=20, slots=slots).collect())) == plain(rows, 20)


def test_top(spark):
    rows = made_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, words string, n int")
    assert sorted(map(tuple, collocations(table, least=20, top=3, slots=1 << 16).collect())) == plain(rows, 20, top=3)
    assert collocations(table.limit(0), slots=1 << 16).collect() == []


def test_maximal_phrases(spark):
    """Paths are compacted to whole phrases of any length."""
    refrain = "we the undersigned do hereby agree to all of the terms above and below"
    rows = [("en", f"{i} {refrain}. other {i}") for i in range(30)] + [("en", f"{refrain} or else") for _ in range(25)]
    found = {tuple(r) for r in maximal_phrases(spark.createDataFrame(rows, "lang string, text string"), least=20).collect()}
    assert found == {("en", refrain, 55), ("en", "terms above and below or else", 25)}
