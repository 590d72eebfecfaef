"""Token counts against the sentencepiece library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from reachmap.llm.token_counts import Merges, count_tokens, token_report, with_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda text: len(model.encode(text or ""))


def made_texts():
    draw = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "▁", "é", "漢", "字", "1", "0", "-", "=", "\x00", "😀", "ing", "tion", ".", ",", "</s>", "<unk>", "<0x41>", "​", "ß"]
    texts = ["", None, " ", "  a", "a  b ", "<s>x</s>", "é\x00b", "\n\t x", "▁a", "a▁▁b", "漢字仮名" * 400, "aaa bbb   ccc\n\n\nfoo____bar"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    return texts + [c * n for c in "xa-=_ .#1\t0o" for n in (1, 2, 3, 5, 7, 16, 17, 31, 64, 100, 999, 1023, 1024, 1025, 2100)]


@pytest.mark.parametrize("slice_bytes", [2 << 20, 37])
def test_made_texts(library, slice_bytes):
    texts = made_texts()
    assert count_tokens(pa.array(texts), Merges(PATH), slice_bytes).tolist() == [library(t) for t in texts]


def test_long_text(library):
    """A text of many slices is cut where no merge crosses; one without spaces is a single sequence."""
    text = "some words of a long text, " * 200_000
    assert count_tokens(pa.array([text, "x" * 300_000]), Merges(PATH)).tolist() == [library(text), library("x" * 300_000)]


def test_report(spark, library):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {tuple(r) for r in token_report(table, PATH, limit=500).collect()}
    assert rows == {(r.doc_id, len(r.text.encode()), library(r.text), library(r.text) > 500) for r in table.collect()}


def test_odd_rows(odd, library):
    clash = odd.withColumnRenamed("hits", "n_tokens").withColumnRenamed("hash", "text_in")
    counted = with_token_counts(clash, PATH)
    assert counted.columns == [*clash.columns, "n_bytes", "n_tokens_", "over_limit"]
    rows = counted.collect()
    assert len(rows) == odd.count()
    assert all((r.n_bytes, r.n_tokens_) == (len((r.text or "").encode()), library(r.text)) for r in rows)
    assert token_report(clash.limit(0), PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="BPE"):
        Merges(str(tmp_path / "other.model"))
