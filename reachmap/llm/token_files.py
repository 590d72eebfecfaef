"""Token ids in compressed binary blocks, with a shared dictionary and access to single documents.

Documents are ranged by id and encoded with the tokenizers library. Their ids, in two bytes each
(four where the vocabulary needs it), are compressed one document at a time with a zstandard
dictionary trained on serialized id arrays. A block is one binary value::

    4 bytes  TIDS          8 bytes  first half of the dictionary's 128-bit hash
    4 bytes  bytes an id   4 bytes  number of documents n
    (n + 1) * 4 bytes      where each document's frame begins, from the end of this index
    frames

so a short document is read by its place in the index without touching the others. Blocks hold
about ``BLOCK_BYTES`` of frames; a folder has the Parquet tables ``blocks`` (in id order, with the
documents' ids and token counts) and ``dictionary``.

The dictionary is trained on the driver from a bounded sample, the ``SAMPLE_ROWS`` documents with
the least hash of their id, of at most ``SAMPLE_CHARS`` characters; everything else is encoded whole.

Text is split at single spaces between words, where no token crosses, so each distinct piece of a
slice is encoded once. Special tokens' strings in a text are ordinary text.

Defined results: a null or empty text is the end id alone; rows that repeat an id follow each other,
ordered by a hash of the text; null ids come first; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .words import byte_view, slices, split_pieces

MAGIC = b"TIDS"
BLOCK_BYTES = 1 << 20
SLICE_BYTES = 16 << 20
SAMPLE_ROWS, SAMPLE_CHARS = 1_000, 32_768
DICTIONARY_BYTES = 64 << 10
LEVEL = 1
END_ID = 0


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks already use all cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


# Pieces that a line end on either side leaves alone: an optional space, then ASCII or Latin letters and signs.
_SAFE = r"^ ?[!-~\x{C0}-\x{FF}]+$"
PIECES_PER_CALL = 200


def _encode_pieces(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, number of ids of each). Safe pieces are encoded as the lines of longer strings."""
    tokenizer = load_tokenizer(path)
    safe = pc.match_substring_regex(pieces, _SAFE).to_numpy(zero_copy_only=False).astype(bool)
    line_end = tokenizer.encode("\n", add_special_tokens=False).ids
    if len(line_end) != 1:
        safe[:] = False
    lines, others = pieces.filter(pa.array(safe)).to_pylist(), pieces.filter(pa.array(~safe)).to_pylist()
    strings = ["\n".join([*lines[i : i + PIECES_PER_CALL], ""]) for i in range(0, len(lines), PIECES_PER_CALL)]
    found = [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
    ids = np.concatenate([np.empty(0, dtype=np.uint32), *found])
    ends = np.flatnonzero(ids == line_end[0]) if lines else np.empty(0, dtype=np.int64)
    ids = ids[ids != line_end[0]] if lines else ids
    line_sizes = np.diff(ends, prepend=-1) - 1
    rest = [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(others, add_special_tokens=False)]
    sizes = np.empty(len(pieces), dtype=np.int64)
    sizes[safe], sizes[~safe] = line_sizes, [len(r) for r in rest]
    flat = np.empty(int(sizes.sum()), dtype=np.uint32)
    of_line = np.repeat(safe, sizes)
    flat[of_line], flat[~of_line] = ids, np.concatenate([np.empty(0, dtype=np.uint32), *rest])
    return flat, sizes


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets into ids) of the texts, the end id after each."""
    n = len(offsets) - 1
    starts, numbered = split_pieces(data, offsets)
    flat, sizes = _encode_pieces(path, numbered.dictionary)
    firsts = np.cumsum(sizes) - sizes
    codes = numbered.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first_piece = np.searchsorted(starts, offsets)
    text_ends = ends[first_piece]  # ids before each text
    ids = np.full(int(ends[-1]) + n, END_ID, dtype=np.uint32)
    for a, b in slices(data, offsets):  # the arrays of places are several times as large as the ids
        p, q = first_piece[a], first_piece[b]
        at = np.arange(ends[p], ends[q]) - np.repeat(ends[p:q] - firsts[codes[p:q]], lengths[p:q])
        texts = np.repeat(np.arange(a, b), np.diff(text_ends[a : b + 1]))
        ids[np.arange(ends[p], ends[q]) + texts] = flat[at]
    return ids, text_ends + np.arange(n + 1)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.blake2b(dictionary, digest_size=16).digest()


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)


def make_block(frames: list[bytes], width: int, hashed: bytes) -> bytes:
    index = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u4")
    return MAGIC + hashed[:8] + struct.pack("<II", width, len(frames)) + index.tobytes() + b"".join(frames)


class Block:
    """One block, opened for reading."""

    def __init__(self, raw: bytes, dictionary: bytes) -> None:
        self.width, self.size = struct.unpack_from("<II", raw, 12)
        if raw[:4] != MAGIC or raw[4:12] != dictionary_hash(dictionary)[:8]:
            raise ValueError("not a block of token ids, or one of another dictionary")
        self.index = np.frombuffer(raw, "<u4", self.size + 1, 20)
        self.body = memoryview(raw)[20 + 4 * (self.size + 1) :]
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=shared)

    def __getitem__(self, place: int) -> np.ndarray:
        """The ids of one document; only its frame is read."""
        frame = self.body[self.index[place] : self.index[place + 1]]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}").astype("<u4")


def _writer(path: str, dictionary: bytes, width: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor, hashed = _compressor(dictionary), dictionary_hash(dictionary)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            columns = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([make_block(frames, width, hashed)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "before", "doc_ids", "counts", "block"])

        held = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(data, offsets, SLICE_BYTES):
                ids, at = encode_texts(path, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                narrow = ids.astype(f"<u{width}")
                for row in range(b - a):
                    frames.append(compressor.compress(narrow[at[row] : at[row + 1]].tobytes()))
                    doc_ids.append(keys[a + row])
                    counts.append(int(at[row + 1] - at[row]))
                    held += len(frames[-1])
                    if held >= BLOCK_BYTES:
                        yield block()
                        number, before, held = number + 1, before + sum(counts), 0
                        doc_ids.clear(), counts.clear(), frames.clear()
        if frames:
            yield block()

    return write


def _sample(docs: DataFrame, path: str, width: int) -> list[bytes]:
    """The serialized ids of the sample the dictionary is trained on."""
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.join(F.broadcast(ids), "doc_id").where(F.length("text") <= SAMPLE_CHARS)  # SAMPLE_ROWS keys at most
    texts = [r.text for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    data, offsets = byte_view(pa.array(texts, pa.large_string()))
    tokens, at = encode_texts(path, data, offsets)
    return [tokens[at[i] : at[i + 1]].astype(f"<u{width}").tobytes() for i in range(len(texts))]


def write_token_files(docs: DataFrame, folder: str, path: str) -> None:
    """Encode all documents into ``folder``; ``path`` is the tokenizer's file."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width = 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4
    dictionary = train_dictionary(_sample(docs, path, width))
    spark.createDataFrame([(bytearray(dictionary_hash(dictionary)), bytearray(dictionary))], "hash binary, dictionary binary").write.parquet(f"{folder}/dictionary")
    ordered = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    blocks = ordered.select("doc_id", "text").mapInArrow(_writer(path, dictionary, width), "part int, number int, before long, doc_ids array<long>, counts array<long>, block binary")
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                block = Block(batch.column("block")[row].as_py(), dictionary)
                doc_ids, counts = batch.column("doc_ids")[row].values, batch.column("counts")[row].values.to_numpy(zero_copy_only=False)
                ids = [block[k].tobytes() for k in range(block.size)]
                sizes = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                if len(counts) != block.size or (sizes != counts).any():
                    raise ValueError("a block doesn't hold the ids it is said to hold")
                part = pa.array([batch.column("part")[row].as_py()] * block.size, pa.int32())
                before = pa.array(np.cumsum(sizes) - sizes + batch.column("before")[row].as_py(), pa.int64())
                yield pa.RecordBatch.from_arrays([part, doc_ids, before, pa.array(sizes), pa.array(ids, pa.binary())], ["part", "doc_id", "before", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    rows = blocks.mapInArrow(read, "part int, doc_id long, before long, n_tokens long, ids binary")
    # A block knows the ids before it in its part; the parts, one row for each task that wrote, are added up here.
    parts = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    # Written, so that its size is known and the join doesn't shuffle the ids while the parts are few.
    parts = Workspace(spark, "token-parts").write(parts, "parts")
    return rows.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_report(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the documents' token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    write_token_files(docs, folder, path)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
