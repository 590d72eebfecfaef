"""Token counts of whole texts by a sentencepiece BPE model, with arrays instead of the library.

Texts are cut into pre-tokens where no merge can cross: before a space that follows another character,
and between two characters that no piece of the model holds side by side. Each distinct pre-token of
a slice of texts is counted once. All of them are held together as one ragged array of symbols
and merged rank by rank: in each turn every sequence joins its pair of lowest rank, the leftmost
among equals, all sequences at the same time. Sequences without a pair to join leave the array; what
they have left are their tokens. A character without a piece counts its UTF-8 bytes.

A sequence of more than ``LONG`` symbols that no cut divides (a run of one letter, or of spaces) would
take as many turns as it has symbols; there the same merges are done one by one, with a heap.

A text's tokens are the sum over its pre-tokens, so there is no shuffle, and memory is bounded by a
slice of texts, the longest single text and the vocabulary.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted alike; a
null id stays null; extra columns pass through ``with_token_counts``, which lengthens its own names
where they clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from .words import byte_view, free_name, give_back, slices

LIMIT = 4096
LONG = 1024
SLICE = 2 << 20
MARK = "▁"  # fixed value: how the model writes a space
_NONE = np.iinfo(np.int64).max
_NORMAL, _BYTE, _USER = 1, 6, 4


class Merges:
    """The model's merges as arrays: symbols are piece numbers, characters without a piece are negative."""

    def __init__(self, path: str) -> None:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix or not plain:
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        if any(p.type == _USER for p in model.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in number):
            raise ValueError("a piece holds a space after another character")
        order = {s: r for r, s in enumerate(sorted({-model.pieces[i].score for i in number.values()}))}
        self.rank_of_piece = {i: order[-model.pieces[i].score] for i in number.values()}
        self.size = len(model.pieces)

        self.of_char = np.full(0x110000, -1, dtype=np.int32)
        beside = set()
        rows = []
        for piece, i in number.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            beside.update(zip(piece, piece[1:]))
            for cut in range(1, len(piece)):
                a, b = number.get(piece[:cut]), number.get(piece[cut:])
                if a is not None and b is not None:
                    rows.append((a * self.size + b, self.rank_of_piece[i], i))
        self.of_char[0x20] = self.of_char[ord(MARK)]
        rows.sort()
        self.keys, self.ranks, self.joined = (np.array(c, dtype=np.int64) for c in zip(*rows))
        plain_pairs = {(a.replace(MARK, " "), b.replace(MARK, " ")) for a, b in beside}
        self.beside = np.array(sorted((ord(a) << 21) + ord(b) for a, b in plain_pairs), dtype=np.int64)
        # Whether a text may be cut between two ASCII bytes; other characters are looked at among distinct pre-tokens.
        self.cut_bytes = np.zeros((256, 256), dtype=bool)
        self.cut_bytes[:128, :128] = True
        for a, b in plain_pairs:
            if ord(a) < 128 and ord(b) < 128:
                self.cut_bytes[ord(a), ord(b)] = False

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, joined piece) of adjacent symbols; the rank is ``_NONE`` where they don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[at], _NONE), self.joined[at]

    def count(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each string of an array without nulls; the strings are pre-tokens."""
        lengths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = byte_view(pieces)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        piece = np.repeat(np.arange(len(lengths)), lengths)
        symbols = self.of_char[chars].astype(np.int64)
        # A character without a piece becomes its bytes and takes part in no merge.
        tokens = np.where(symbols >= 0, 1, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))
        counts = np.bincount(piece, weights=tokens, minlength=len(lengths)).astype(np.int64)
        begins = np.ones(len(chars) + 1, dtype=bool)
        pair = (chars[:-1] << 21) + chars[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        begins[1:-1] = (piece[1:] != piece[:-1]) | (self.beside[at] != pair) | (symbols[1:] < 0) | (symbols[:-1] < 0)
        first = np.flatnonzero(begins)
        sizes = np.diff(first)
        for s in np.flatnonzero(sizes > LONG):
            stretch = symbols[first[s] : first[s + 1]]
            counts[piece[first[s]]] -= len(stretch) - self.merge_long(stretch)
        taken = (sizes > 1) & (sizes <= LONG)
        inside = np.repeat(taken, sizes)
        owner = piece[first[:-1][taken]]
        left = self.merge_all(symbols[inside], sizes[taken])
        return counts - np.bincount(owner, weights=sizes[taken] - left, minlength=len(lengths)).astype(np.int64)

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols that each sequence has left; ``sizes`` are the sequences' lengths in ``symbols``."""
        left = sizes.copy()
        live = np.arange(len(sizes))  # the sequences still in the arrays
        first = np.cumsum(sizes) - sizes
        last = np.zeros(len(symbols), dtype=bool)
        last[first + sizes - 1] = True
        rank, joined = np.full(len(symbols), _NONE), np.zeros(len(symbols), dtype=np.int64)
        pairs = np.flatnonzero(~last)
        rank[pairs], joined[pairs] = self.look_up(symbols[pairs], symbols[pairs + 1])
        while len(live):
            at = np.arange(len(symbols))
            key = np.where(rank == _NONE, _NONE, (rank << 32) + at)
            best = np.minimum.reduceat(key, first)
            go = best != _NONE
            here = best[go] & 0xFFFFFFFF  # where each live sequence merges
            left[live[go]] -= 1
            symbols[here] = joined[here]
            last[here] = last[here + 1]
            keep = np.repeat(go, np.diff(np.append(first, len(symbols))))
            keep[here + 1] = False
            changed = np.zeros(len(symbols), dtype=bool)
            changed[here] = True
            before = here[here > 0] - 1
            changed[before[~last[before]]] = True
            live, sizes = live[go], left[live[go]]
            symbols, rank, joined, last, changed = (x[keep] for x in (symbols, rank, joined, last, changed))
            first = np.cumsum(sizes) - sizes
            rank[changed & last] = _NONE
            again = np.flatnonzero(changed & ~last)
            rank[again], joined[again] = self.look_up(symbols[again], symbols[again + 1])
        return left

    @property
    def table(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_table"):
            self._table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.joined.tolist(), strict=True), strict=True))
        return self._table

    def merge_long(self, symbols: np.ndarray) -> int:
        """Symbols left of one long sequence, merged one pair at a time."""
        value, table, size = symbols.tolist(), self.table, self.size
        n = left = len(value)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]

        def pair(i: int, j: int) -> tuple[int, int, int, int, int] | None:
            found = table.get(value[i] * size + value[j])
            return (found[0], i, value[i], value[j], found[1]) if found else None

        heap = [entry for i in range(n - 1) if (entry := pair(i, i + 1))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = after[i]
            if value[i] != a or j < 0 or value[j] != b:
                continue  # one of the two has been merged since
            value[i], value[j], after[i] = joined, -1, after[j]
            left -= 1
            if after[i] >= 0:
                before[after[i]] = i
            for l, r in ((i, after[i]), (before[i], i)):
                if l >= 0 and r >= 0 and (entry := pair(l, r)):
                    heapq.heappush(heap, entry)
        return left


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


def _parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, text of each part): texts longer than ``limit`` are cut before a space that follows another byte."""
    cuts, owners = [], []
    for row in np.flatnonzero(np.diff(offsets) > limit):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while end - at > limit:
            reach = limit
            while True:  # looked for near the limit first, further on where a text has no spaces
                near = data[at + 1 : min(at + 1 + reach, end)]
                found = np.flatnonzero((near == 0x20) & (data[at : at + len(near)] != 0x20))
                if len(found) or at + 1 + reach >= end:
                    break
                reach *= 2
            if not len(found):
                break
            at += 1 + int(found[-1] if reach == limit else found[0])
            cuts.append(at)
            owners.append(row)
    bounds = np.concatenate([offsets, np.array(cuts, dtype=np.int64)])
    owner = np.concatenate([np.arange(len(offsets)), np.array(owners, dtype=np.int64)])
    order = np.lexsort((bounds, owner))
    return bounds[order], owner[order][:-1]


def count_tokens(texts: pa.Array, model: Merges, slice_bytes: int = SLICE) -> np.ndarray:
    """Tokens of each text, without begin, end or added special tokens."""
    out = np.zeros(len(texts), dtype=np.int64)
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    data, offsets = byte_view(texts.cast(pa.large_string()))
    offsets, owner = _parts(data, offsets, slice_bytes)
    for a, b in slices(data, offsets, slice_bytes):
        at = offsets[a : b + 1] - offsets[a]
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        # Every text gets the space that the model puts before it; the later parts of a long one don't.
        opens = full[(a + full == 0) | (owner[a + full] != owner[a + full - 1])]
        text = np.insert(data[offsets[a] : offsets[b]], at[:-1][opens], 0x20)
        heads = at[:-1][full] + np.searchsorted(opens, full)
        begins = np.zeros(len(text), dtype=bool)
        begins[1:] = (text[1:] == 0x20) & (text[:-1] != 0x20) | model.cut_bytes[text[:-1], text[1:]]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        bounds = pa.array(np.append(starts, len(text)), pa.int64())
        pieces = pa.LargeStringArray.from_buffers(len(starts), bounds.buffers()[1], pa.py_buffer(text)).dictionary_encode()
        tokens = model.count(pieces.dictionary)[pieces.indices.to_numpy(zero_copy_only=False)]
        np.add.at(out, owner[a + full], np.add.reduceat(tokens, np.searchsorted(starts, heads)))
    return out


def with_token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """The documents with three more columns: n_bytes, n_tokens, over_limit."""
    columns = docs.columns
    names: list[str] = []
    for wanted in ("n_bytes", "n_tokens", "over_limit"):
        names.append(free_name([*columns, *names], wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in batches:
            texts = batch.column(len(columns))
            tokens = count_tokens(texts, model)
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n_bytes, pa.array(tokens), pa.array(tokens > limit)], [*columns, *names])
            give_back()

    added = [T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.LongType(), T.BooleanType()), strict=True)]
    text = F.col("text").cast("string").alias(free_name(columns, "text_in"))
    return docs.select("*", text).mapInArrow(count, T.StructType([*docs.schema.fields, *added]))


def token_report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    return with_token_counts(docs.select("doc_id", "text"), path, limit).drop("text")
