"""Benchmark windows in documents, against a plain search."""

import random
import re

import pytest

from reachmap.llm import decontaminate as D


def plain(docs, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - size, 0) + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for window, ids in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [D.BLOCK_WINDOWS, 7])
def test_random_texts(spark, docs, block):
    r = random.Random(1)
    word = lambda: r.choice(["Ab", "b1", "é", "ça", "d", "e-f"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 13, 15])))) for i in range(12)] + [(3, None), (None, "b1 d"), (12, "Ab b1"), (13, "ab; B1!")]
    rows = [(i, "; ".join(word() for _ in range(r.randint(0, 40))) + " " + r.choice(items)[1].__str__() * 2) for i in range(60)]
    rows += [(None, None), (5, ""), (5, rows[0][1]), (5, rows[0][1])]
    marked, hits = D.mark_hits(docs(rows), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert hits == "hits_"
    found = [(x.doc_id, x[hits].n_words, len(x[hits]["words"]), list(x[hits]["items"])) for x in marked.collect()]
    assert sorted(found, key=str) == plain(rows, items)


def test_removal(spark, docs):
    passage = " ".join(f"w{i}" for i in range(13))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    table = docs([(1, f"é before, {passage.upper()} after"), (2, "clean"), (3, None), (4, passage + " clean" * 400)])
    assert sorted(r.doc_id for r in D.remove_documents(table, bench).collect()) == [2, 3, 4]
    cut = D.remove_spans(table, bench)
    assert cut.columns == table.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "é before,  after" and texts[2] == "clean" and texts[3] is None and texts[4] == " clean" * 400


def test_empty_tables(spark, docs, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_report(odd, none).where("contaminated").count() == 0
    assert D.contamination_report(docs([]), none).count() == 0
