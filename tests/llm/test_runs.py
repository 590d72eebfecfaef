"""Periodic runs against a plain scan of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow as pa
import pytest

from reachmap.llm.runs import collapse_runs, find_runs, run_report, runs_of


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words):
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q), q)  # a multiple of the smallest period comes later
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_report(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed, kept = "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone)
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *strongest, *(hashlib.sha256(d.encode()).hexdigest() for d in (listed, kept)))


def made_texts():
    draw = random.Random(3)
    texts = ["", None, "a", " \t", "a a a a a", "a a a a a a", "a b " * 3 + "a b", "a b " * 4]
    for _ in range(600):
        letters, parts = "abcde"[: draw.randint(2, 5)], []
        for _ in range(draw.randint(1, 5)):
            unit = [draw.choice(letters) for _ in range(draw.randint(1, 7))]
            parts += [unit[i % len(unit)] for i in range(draw.randint(1, len(unit) * 7))] if draw.random() < 0.5 else unit
        texts.append(" ".join(parts))
    mirror = ["a"]
    for _ in range(12):  # two blocks whose polynomial hashes are equal for every base
        mirror += ["b" if c == "a" else "a" for c in mirror]
    other = ["b" if c == "a" else "a" for c in mirror]
    texts += [" ".join(mirror), " ".join((mirror[:2048] + other[:2048]) * 4), " ".join((mirror[:1024] + other[:1024]) * 2)]
    first, second = ["a"], ["a", "b"]
    for _ in range(14):
        first, second = second, second + first
    return [*texts, " ".join(second), "x " * 3000, "x y z " * 900 + "q " * 50]


@pytest.mark.parametrize("slice_bytes", [1 << 20, 64])
def test_all_runs(slice_bytes):
    texts = made_texts()
    for found in runs_of(pa.array(texts), None, slice_bytes):
        for k, row in enumerate(found.rows):
            assert found.of_row(k) == plain_runs(words_of(texts[row]))


def test_report(spark, docs):
    """Ids decide which texts are made periodic; repeated rows and odd texts included."""
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 60)))) for i in range(400)]
    rows += [(i, t) for i, t in enumerate(made_texts()[:40], 1000)] + [(7, "é é é é é é 漢 漢"), (7, "é é é é é é 漢 漢")]
    found = sorted(tuple(r) for r in run_report(docs(rows)).collect())
    assert found == sorted((i, *plain_report(i, t)) for i, t in rows)
    assert any(r[1] and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in found)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: tuple(r)[1:] for r in run_report(table).collect()}
    assert rows == {r.doc_id: plain_report(r.doc_id, r.text) for r in table.collect()}


def test_odd_rows(spark, odd):
    rows = find_runs(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: len(r.runs) for r in rows if r.doc_id in (1, 2, 3, 4, 8)} == {1: 0, 2: 0, 3: 0, 4: 0, 8: 0}
    assert [tuple(x) for r in rows if r.doc_id == 9 for x in r.runs] == [(0, 40_000, 2)]
    clash = odd.withColumnRenamed("hits", "collapsed").withColumnRenamed("hash", "text_in").withColumnRenamed("lang", "Start")
    cut = collapse_runs(clash)
    assert cut.columns == [*clash.columns, "collapsed_"]
    assert {r.doc_id: r.collapsed_ for r in cut.collect()}[9] == "long words"
    assert run_report(clash).where("doc_id IS NULL").count() == 2
    for operator in (find_runs, collapse_runs, run_report):
        assert operator(clash.limit(0)).collect() == []
