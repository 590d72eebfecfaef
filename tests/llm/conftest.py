import pytest


@pytest.fixture()
def docs(spark):
    """A table of documents with columns whose names clash with those the operators use."""

    def make(rows):
        filled = [(i, t, "en", "s", 1, 7, "x", "y") for i, t in rows]
        return spark.createDataFrame(filled, "doc_id long, text string, lang string, source string, n_chars long, hits int, hash string, ids string")

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Same text here again and again"),
    (6, "Same text here again and again"),
    (7, "same  text here\nagain and again"),
    (8, "x" * 200_000),
    (9, "long words " * 20_000),
    (10, "é ü 漢字 😀   \x00 end"),
    (10, "é ü 漢字 😀   \x00 end"),
    (None, "no id at all"),
    (None, None),
]


@pytest.fixture()
def odd(docs):
    return docs(ODD)
