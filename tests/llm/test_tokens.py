"""Token ids of both writers against the tokenizer libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from reachmap.llm import bpe, token_files

from .conftest import ODD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
STRANGE = [(20, "Hello  world\n\n  it's 1234 ٣٤ ½ 𐕰𐕱 ab　c d\t\te<|endoftext|>"), (21, "a" * 65 + " " + "Zz9" * 50 + " "), (22, "  \n  "), (23, "thth the à \xa0 b " * 40), (24, "՘ ꟎ 1ቆf")]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe(docs, library):
    rows = [r for r in ODD if r[0] != 8] + STRANGE  # one word of 200,000 letters takes the library too long
    found = sorted(map(tuple, bpe.encoding_report(docs(rows), RANKS, public_tokenizers.PATTERN).collect()), key=str)
    wanted = []
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(wanted, key=str)


def test_bpe_round_trip(docs, odd):
    done = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    assert done.columns == [*odd.columns, "ids_"]
    decoded = done.select("text", bpe.Vocabulary(RANKS).decode(F.col("ids_")).alias("back"))
    assert all(bytes(r.back) == (r.text or "").encode() for r in decoded.collect())
    assert bpe.encode(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_small_blocks(docs, library):
    rows = [(i, f"block {i} of words " * (i % 5)) for i in range(40)]
    made = bpe.encode_blocks(docs(rows), bpe.Vocabulary(RANKS), public_tokenizers.PATTERN, ["doc_id"], f"named_struct('doc_id', d.doc_id, 'ids', {bpe._IDS})", block_bytes=100, arrays=True)
    assert {r.doc_id: list(r["ids"]) for r in made.collect()} == {i: library.encode_ordinary(t) for i, t in rows}


def test_token_files(spark, docs, tmp_path):
    rows = sorted([r for r in ODD if r[0] is not None] + STRANGE, key=lambda r: r[0])
    tokenizer = token_files.load_tokenizer(MODEL)
    wanted, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_files.token_report(docs(rows), MODEL, str(tmp_path / "t")).collect()
    assert sorted(map(tuple, found)) == wanted
    assert token_files.token_report(docs([]), MODEL, str(tmp_path / "none")).count() == 0
    assert token_files.token_report(docs([(None, None), (None, "a")]), MODEL, str(tmp_path / "null")).count() == 2


def test_block_access():
    import zstandard

    docs = [np.arange(n, dtype="<u2") for n in (0, 1, 500, 20_000)]
    dictionary = token_files.train_dictionary([d.tobytes() for d in docs])
    raw = token_files.make_block([token_files._compressor(dictionary).compress(d.tobytes()) for d in docs], 2, token_files.dictionary_hash(dictionary))
    block = token_files.Block(raw, dictionary)
    assert all((block[k] == d).all() for k, d in enumerate(docs))
    with pytest.raises(ValueError):
        token_files.Block(raw, b"another dictionary")
    assert zstandard.ZstdDecompressor is not None


def test_columns_of_the_same_names(docs, library):
    table = docs([(1, "some words"), (2, None)]).withColumnRenamed("hits", "_text").withColumnRenamed("hash", "_codes")
    made = bpe.encode(table, RANKS, public_tokenizers.PATTERN)
    assert made.columns == [*table.columns, "ids_"]
    assert {r.doc_id: list(r.ids_) for r in made.collect()} == {1: library.encode_ordinary("some words"), 2: []}


def test_plans_hold_no_vocabulary(docs, capsys):
    bpe.encoding_report(docs([(1, "some words")]), RANKS, public_tokenizers.PATTERN).explain(True)
    assert len(capsys.readouterr().out) < 100_000


def test_common_words_are_folded_once(docs, library):
    """Words of the sample come to the blocks with their ids; the others are folded there."""
    rows = [(i, f"walking through forests {'again ' * (i % 3)}rare{i * 7919}word") for i in range(50)]
    common = bpe.common_words(docs(rows), bpe.Vocabulary(RANKS), public_tokenizers.PATTERN)
    known = dict(zip(common.column("word").to_pylist(), common.column("ids").to_pylist(), strict=True))
    assert " forests" in known and "word" in known and all(ids == library.encode_ordinary(w) for w, ids in known.items())
    words = pa.array([" forests", "unseenwordx", "word", "y" * 100], pa.large_string())
    table = bpe._word_table(words, bpe.read_ranks(RANKS), common.append_column("numbers", common.column("word").cast("string")).append_column("pieces", common.column("word").cast("string")))
    assert [len(w["bytes"]) for w in table.to_pylist()] == [0, 11, 0, 100]
    assert [w["ids"] for w in table.to_pylist()] == [known[" forests"], None, known["word"], library.encode_ordinary("y" * 100)]
    found = bpe.encode(docs(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids_) for r in found} == {i: library.encode_ordinary(t) for i, t in rows}


def test_merges_in_any_order_of_ranks(docs, tmp_path):
    """Pieces that come before their parts, or that no merges make, as a trained vocabulary has none."""
    some = random.Random(7)
    made = sorted({"".join(some.choices("abc", k=some.randint(2, 5))) for _ in range(60)} | {"xyz"})
    some.shuffle(made)
    ranks = {bytes([b]): b for b in range(256)} | {piece.encode(): 256 + i for i, piece in enumerate(made)}
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(piece) + f" {rank}\n".encode() for piece, rank in ranks.items()))
    merges = bpe.read_ranks(str(path)).merges
    assert merges.late.any() and merges.cut[ranks[b"xyz"]] == 0
    small = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(some.choices("abcd", [4, 4, 4, 1], k=some.randint(1, 64))) for _ in range(400)]
    rows = list(enumerate([*words, "xyz", "xyzx xyz", "y" * 64, "ab" * 32]))
    found = bpe.encode(docs(rows), str(path), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids_) for r in found} == {i: small.encode_ordinary(t) for i, t in rows}


def test_fold_takes_one_step_a_possible_merge(docs, library):
    """A rare word costs a step for each piece it holds, sorted by rank, not arrays rebuilt for each byte."""
    ranks = bpe.read_ranks(RANKS)
    assert not ranks.merges.late.any()
    some = random.Random(5)
    words = ["".join(some.choices("etaoinshrdluéß", k=some.randint(1, 31))) for _ in range(2000)]
    table = bpe._word_table(pa.array(words, pa.large_string()), ranks, None).to_pylist()
    for word, row in zip(words[:200], table, strict=False):
        raw = word.encode()
        held = sorted((ranks[raw[i:j]], i) for i in range(len(raw)) for j in range(i + 2, len(raw) + 1) if raw[i:j] in ranks)
        assert [(m["token"] & 0xFFFF, m["token"] >> 16) for m in row["merges"]] == held and row["ids"] is None
    rows = list(enumerate(words))
    found = bpe.encode(docs(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids_) for r in found} == {i: library.encode_ordinary(t) for i, t in rows}


def test_pieces_that_are_words_need_no_pattern():
    split = bpe.word_pattern(public_tokenizers.PATTERN)
    some = random.Random(3)
    pieces = ["", " ", "  ", " a", "×", " ÷", "Ã", "aÃ", " a's", "a b", *("".join(some.choices("abZéÿ×÷ '9.\n漢Ã", k=some.randint(1, 5))) for _ in range(5000))]
    sure = bpe._are_words(pa.array(pieces, pa.large_string()))
    assert all(split.findall(p) == [p] for p, s in zip(pieces, sure, strict=True) if s) and {" a", "Ã", "aÃ"} <= {p for p, s in zip(pieces, sure, strict=True) if s}

    class Counted:
        asked: list[str] = []

        def findall(self, piece):
            self.asked.append(piece)
            return split.findall(piece)

    text = "Ordinary words über años, it's 12 o'clock"
    words, codes, ends = bpe._words_of(pa.chunked_array([pa.array([text, "", "words"])]), Counted())
    assert words.take(pa.array(codes)).to_pylist() == [*split.findall(text), "words"] and ends.tolist() == [0, len(codes) - 1, len(codes) - 1, len(codes)]
    assert not {"Ordinary", " words", " über", "words"} & set(Counted.asked) and len(Counted.asked) == 4
