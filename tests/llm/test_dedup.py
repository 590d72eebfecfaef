"""Exact and near copies, against plain versions."""

import pathlib
import random
import re

from reachmap.llm import exact, neardup

from .brute import jaccard_components
from .conftest import ODD


def test_exact(odd):
    forms = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD]
    best = {}
    for form, (doc_id, text) in zip(forms, ODD, strict=True):
        key = (-len(text or ""), doc_id is None, doc_id or 0)
        best[form] = min(best.get(form, key), key)
    wanted = sorted(((d, None if best[f][1] else best[f][2], forms.count(f)) for f, (d, _) in zip(forms, ODD, strict=True)), key=str)
    found = exact.find_copies(odd).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == wanted
    assert sum(r.kept for r in found) == len(set(forms))


def test_exact_removal(odd, docs):
    kept = exact.remove_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD})
    assert sum(r.doc_id == 10 for r in rows) == 1  # rows that repeat id and text
    assert exact.remove_copies(docs([])).count() == 0


def near_rows(seed=3):
    """Groups of edited copies: some at the threshold, one large, with a hub that most of them resemble."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, number = [], 0
    for copies, length in ((60, 120), (5, 40), (4, 12), (3, 6), (2, 3), (8, 300)):
        base = [word() for _ in range(length)]
        for c in range(copies):
            text = list(base)
            for _ in range(r.randint(0, max(1, length // 30)) if c else 0):
                text[r.randrange(length)] = word()
            rows.append((number, " ".join(text)))
            number += 1
    rows += [(number + i, " ".join(word() for _ in range(r.randint(1, 60)))) for i in range(60)]
    return rows


def test_near(docs):
    rows = [*near_rows(), (1000, None), (1001, ""), (1002, " \n")]
    wanted = jaccard_components(rows, 4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(rows), 4).collect()}
    assert found == wanted
    assert len({c for _, c in wanted.values()}) < len(rows) - 40


def test_words_in_patterns_stay_apart(docs):
    """Two words of 2,048 characters that meet under a polynomial modulo 2**64."""
    pattern = "a"
    for _ in range(11):
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    rows = [(1, pattern), (2, pattern.translate(str.maketrans("ab", "ba"))), (3, pattern + " and more words to follow"), (4, pattern)]
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(rows), 4).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 1}


def test_near_removal(odd, docs):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 2, 3, 4, 5, 8, 9, 10, None} == set(ids) and ids.count(None) == 2
    assert neardup.keep_one(docs([])).count() == 0


def test_rounds_without_links_plan_no_components(docs):
    """Two copies link in the first round; the later ones find nothing and write no further tables of stars."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "other"])), (3, "quite another text of its own")]
    made = neardup.near_duplicates(docs(rows), 4)
    assert {r.doc_id: r.component_id for r in made.collect()} == {1: 1, 2: 1, 3: 3}
    folder = re.sub("^file:/*", "/", made.inputFiles()[0]).rsplit("/", 2)[0]
    written = {p.name for p in pathlib.Path(folder).iterdir()}
    assert "components-1-0" in written and "links-3" in written and not any(n.startswith(("components-2", "components-3")) for n in written)


def test_signature_is_an_estimate():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (3, 40, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(0.8 * n)], r.integers(0, 2**63, n - int(0.8 * n)).astype(np.uint64)]))
        same = np.mean([(neardup.signature(a, 512) == neardup.signature(b, 512)).mean()])
        real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - real) < (0.45 if n < 10 else 0.15)
