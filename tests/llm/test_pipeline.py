"""The pipeline's stages on planted cases, each against the operator's plain version."""

import base64
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from reachmap.llm import exact

from .brute import contaminated, jaccard_components
from .conftest import ODD

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        after = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        kept = {r.doc_id for r in after.collect()}
        assert kept <= set(before)
        if name == "quality_classifier":
            assert sum(labels[d] == (d in kept) for d in before if d in labels) >= 0.95 * sum(d in labels for d in before)
        if name == "exact_dedup":
            assert kept == {r.doc_id for r in exact.find_copies(docs).where("kept").collect()}
        if name == "near_dedup":
            assert kept == {d for d, (n, c) in jaccard_components(list(before.items()), 5).items() if n == 0 or c == d}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert kept == set(before) - contaminated(before.items(), items) and kept < set(before)
        if name == "byte_bpe":
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            rows = after.collect()
            assert kept == set(before) and len(rows) == len(kept)
            for r in rows:
                ids = library.encode_ordinary(before[r.doc_id])
                assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest()
        docs = after


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd, docs, name):
    """Nulls, empty and long texts, repeats, columns with clashing names, and no rows at all."""
    stage = dict(corpus_pipeline.STAGES)[name]
    after = stage(spark, odd, DATA)
    rows = after.collect()
    if name != "byte_bpe":
        assert after.columns == odd.columns
    wanted = {
        "exact_dedup": {(1, 2, 3), (4,), (5, 6), (7,), (8,), (9,), (10,), (None,)}, "near_dedup": {(1,), (2,), (3,), (4,), (5, 6, 7), (8,), (9,), (10,), (None,)},
        "benchmark_decontamination": {(i,) for i, _ in ODD}, "byte_bpe": {(i,) for i, _ in ODD},
    }.get(name, set())
    kept = {r.doc_id for r in rows}
    assert all(len(kept & set(group)) >= 1 for group in wanted) and kept <= {i for i, _ in ODD}
    assert name not in ("exact_dedup", "near_dedup") or sum(i in kept for i in (5, 6)) == 1
    assert name not in ("benchmark_decontamination", "byte_bpe") or len(rows) == len(ODD)
    assert stage(spark, docs([]), DATA).collect() == []
