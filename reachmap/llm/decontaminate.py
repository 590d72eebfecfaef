"""Benchmark decontamination with a broadcast hash set of benchmark word windows.

A benchmark text is a set of windows: each run of 13 consecutive words, or the whole text if it
has fewer words. The windows are hashed and broadcast, training texts are scanned window by
window, every hash hit is verified against the window's words, and the hit words are then used to
remove documents or spans.

The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` windows (about 100 bytes each). The
number of windows is counted first; beyond one block the texts are scanned once per block and the
hits found so far travel with the rows, so nothing grows past the bound and nothing is left out.

Defined results: a null or word-less text has no words, hits nothing and is kept; a null or
word-less benchmark text has no window; benchmark rows without an item id are ignored; repeated
rows are judged one by one, each alike; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workspace import Workspace
from .words import byte_view, find_words, free_name, give_back, slices, word_table

WINDOW_WORDS = 13
BLOCK_WINDOWS = 200_000
# Fixed value: the separators of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])

_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("words", pa.list_(pa.int32())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The distinct windows of all items: (phrase, n_words, items), items sorted as strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(SEPARATORS)
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(data, offsets):
                words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
                items, phrases, sizes = [], [], []
                for row in range(b - a):
                    first, n = int(words.bounds[row]), int(words.bounds[row + 1] - words.bounds[row])
                    for at in range(first, first + max(n - size, 0) + 1) if n else ():
                        items.append(batch.column(0)[a + row].as_py())
                        phrases.append(words.phrase(at, min(n, size)))
                        sizes.append(min(n, size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(items, pa.string()), pa.array(phrases, pa.binary()), pa.array(sizes, pa.int32())], ["item", "phrase", "n_words"]
                )

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    cut_rows = rows.mapInArrow(cut, "item string, phrase binary, n_words int")
    return cut_rows.groupBy("phrase", "n_words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def mark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS, block_windows: int = BLOCK_WINDOWS) -> tuple[DataFrame, str]:
    """``docs`` and one more column, with its name: struct(n_words, words, spans, items).

    ``words`` are the positions of hit words, ``spans`` the hit runs in code points, ``items`` the
    sorted ids of the items with a window in the text.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "decontaminate")
    found = work.write(benchmark_windows(benchmark, size), "windows")
    blocks = max(1, -(-found.count() // block_windows))
    found = found.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int"))
    name = free_name(docs.columns, "hits")
    names = docs.columns
    marked = docs
    for block in range(blocks):
        rows = found.where(F.col("block") == block).collect()  # at most about block_windows rows
        phrases = spark.sparkContext.broadcast([(bytes(r.phrase), r.n_words, tuple(r["items"])) for r in rows])
        schema = T.StructType([*docs.schema.fields, T.StructField(name, _HITS)])
        marked = marked.mapInArrow(_scanner(phrases, names, name), schema)
        if block + 1 < blocks:
            marked = work.write(marked, f"block-{block}")
    return marked, name


def _scanner(phrases, names: list[str], name: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(SEPARATORS)
        known, filters = _hashed(phrases.value, table)
        for batch in batches:
            text = batch.column(names.index("text"))
            before = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * len(batch)
            data, offsets = byte_view(text)
            out = []
            for a, b in slices(data, offsets):
                words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)
                out += _hits(words, offsets[a : b + 1] - offsets[a], known, filters, before[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out, _HITS_ARROW)], [*names, name])
            give_back()

    return scan


def _hashed(phrases: list[tuple[bytes, int, tuple[str, ...]]], table) -> tuple[dict, dict]:
    """By window size: hash -> (phrase, items), and a bit table of the hashes' top 16 bits."""
    by_size: dict[int, list] = {}
    for phrase, n, items in phrases:
        by_size.setdefault(n, []).append((phrase, items))
    known: dict[int, dict[int, list]] = {}
    for n, group in by_size.items():  # all phrases of a size at once: each is one window
        offsets = np.cumsum([0, *(len(phrase) for phrase, _ in group)])
        hashes = find_words(np.frombuffer(b"".join(phrase for phrase, _ in group), dtype=np.uint8), offsets, table).windows(n)[1]
        for key, entry in zip(hashes.tolist(), group, strict=True):
            known.setdefault(n, {}).setdefault(key, []).append(entry)
    filters = {}
    for n, hashes in known.items():
        bits = np.zeros(1 << 22, dtype=bool)
        bits[np.fromiter(hashes, dtype=np.uint64, count=len(hashes)) >> np.uint64(42)] = True
        filters[n] = bits
    return known, filters


def _hits(words, offsets: np.ndarray, known: dict, filters: dict, before: list) -> list[dict]:
    hit = np.zeros(len(words.start), dtype=bool)
    items: dict[int, set[str]] = {}
    for n, hashes in known.items():
        first, value = words.windows(n)
        likely = np.flatnonzero(filters[n][value >> np.uint64(42)])
        for at, key in zip(first[likely].tolist(), value[likely].tolist(), strict=True):
            for phrase, ids in hashes.get(key, ()):
                if words.phrase(at, n) == phrase:  # verified: never a mere hash hit
                    hit[at : at + n] = True
                    row = int(np.searchsorted(words.bounds, at, side="right")) - 1
                    items.setdefault(row, set()).update(ids)
    out = []
    for row, old in enumerate(before):
        a, b = int(words.bounds[row]), int(words.bounds[row + 1])
        if old and old["words"]:
            hit[a + np.array(old["words"])] = True
            items.setdefault(row, set()).update(old["items"])
        at = np.flatnonzero(hit[a:b]) if row in items else np.empty(0, dtype=np.int64)
        spans = []
        if len(at):
            lo, hi = int(offsets[row]), int(offsets[row + 1])
            chars = np.cumsum((words.lower[lo:hi] & 0xC0) != 0x80)  # characters begun up to each byte
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            spans = [{"start": int(chars[words.start[a + r[0]] - lo]) - 1, "end": int(chars[words.end[a + r[-1]] - 1 - lo])} for r in runs]
        out.append({"n_words": b - a, "words": at.tolist(), "spans": spans, "items": sorted(items.get(row, ()))})
    return out


def is_contaminated(hits: Column) -> Column:
    """Hit words are at least a twentieth of all words."""
    n = F.size(hits["words"]).cast("long")
    return (n > 0) & (n * 20 >= hits["n_words"])


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    marked, hits = mark_hits(docs, benchmark)
    return marked.where(~is_contaminated(F.col(hits))).drop(hits)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents; the hit spans are cut out of their texts."""
    marked, hits = mark_hits(docs, benchmark)
    spans = F.col(f"{hits}.spans")
    text = F.col("text")
    ends = F.concat(F.array(F.lit(0)), spans["end"])
    starts = F.concat(spans["start"], F.array(F.char_length(text)))
    kept = F.array_join(F.zip_with(ends, starts, lambda e, s: F.substring(text, e + 1, s - e)), "")
    return marked.withColumn("text", F.when(F.size(spans) > 0, kept).otherwise(text)).drop(hits)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: counts of words, hit words and items, the items' digest and the verdict."""
    marked, name = mark_hits(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    hits = F.col(name)
    return marked.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        F.size(hits["words"]).cast("long").alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(hits).alias("contaminated"),
    )
