"""Near-duplicate lines against all earlier lines."""

import random

from reachmap.llm import lines
from reachmap.llm.queries import op4_lines

from .brute import dropped_lines
from .conftest import ODD


def make_rows(seed=2):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta é ü x y z".split()) + str(r.randrange(9))
    bases = [[word() for _ in range(n)] for n in (1, 3, 8, 9, 10, 11, 14, 30, 200) for _ in range(3)]

    def line():
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 1, 2])):
            k, kind = r.randrange(len(words) + 1), r.randrange(3)
            words[k : k + (kind > 0)] = [word()] if kind < 2 else []
            words = words or [word()]
        return r.choice([" ", " ", "  "]).join(words)

    return [(i, "\n".join(r.choice([line(), line(), line(), ""]) for _ in range(r.randint(0, 5)))) for i in range(80)]


def test_lines(docs):
    rows = [*make_rows(), (500, None), (501, ""), (502, "\n\n"), (503, "ends with a line end\n"), (-4, "first of all\nlines")]
    found = {r.doc_id: list(r.dropped) for r in lines.line_report(docs(rows)).collect()}
    assert found == dropped_lines(rows)


def test_short_lines(docs, spark):
    rows = [*make_rows(3), (600, "Le lechaux dans encen anetion de euxque.\nCopyright 2019 by them"), (601, "Le lechaux dans un anetion de euxque.\nCopyright 2020 by them\nby them")]
    found = {r.doc_id: list(r.dropped) for r in lines.line_report(docs(rows), min_words=4).collect()}
    assert found == dropped_lines(rows, min_words=4) and found[601] == [0, 1]
    # The registered query asks for the same bound.
    data = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{data}/documents.parquet")
    wanted = {(r.doc_id, tuple(r.dropped)) for r in lines.line_report(table, min_words=4).collect()}
    assert {(r.doc_id, tuple(r.dropped)) for r in op4_lines(spark, data).collect()} == wanted


def test_lines_of_two_words_in_patterns(docs):
    """Long lines that meet under a polynomial modulo 2**64, whatever its base, stay apart."""
    pattern = ["up"]
    for _ in range(11):
        pattern += ["down" if w == "up" else "up" for w in pattern]
    other = ["down" if w == "up" else "up" for w in pattern]
    rows = [(1, " ".join(pattern)), (2, " ".join(other)), (3, " ".join(pattern)), (4, " ".join(pattern[:1024])), (5, " ".join(other[:1024]))]
    found = {r.doc_id: list(r.dropped) for r in lines.line_report(docs(rows)).collect()}
    assert found == {1: [], 2: [], 3: [0], 4: [], 5: []}


def test_removal(odd, docs):
    kept = lines.remove_lines(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    texts = {r.doc_id: r.text for r in kept.where("doc_id < 8").collect()}
    assert texts[1] is None and texts[5] == "Same text here again and again" and texts[6] == ""
    assert lines.remove_lines(docs([])).count() == 0
