"""Periodic runs of words in whole texts, found on a grammar of the words (Re-Pair).

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``MIN_LENGTH`` words and ``MIN_REPEATS`` periods long, that no neighbouring word extends.

1. The words of a slice of texts become numbers, equal words the same one.
2. Re-Pair: adjacent symbols that occur together more than once become a nonterminal, the most
   frequent ones first. A turn replaces all pairs that repeat, of overlapping ones the more frequent, so
   a grammar takes some ten turns and not one per rule. When no pair repeats, what is left of each
   text is paired up in a balanced way, until every text is one symbol.
3. A run lies within a smallest symbol of the derivation and there crosses the boundary of its two
   halves. So each nonterminal is looked at once, for stretches that cross its boundary: at least two
   periods of a run lie on one side of it, so period q is possible only where two adjacent blocks of
   q words are equal there. Prefix sums of hashes tell which blocks may be; stretches are then
   compared word by word, so a hash never decides.
4. Stretches are translated to all positions the nonterminal derives, and stretches of the same period
   that share q words or more are merged. A stretch cut off by the end of its nonterminal so becomes
   part of the run.

A nonterminal of L words costs O(L), a text of n words O(n log n). There is no shuffle; memory is
bounded by a slice of texts or the longest single one.

Defined results: null, empty and word-less texts have no words and no runs; repeated rows have the
same runs; a null id stays null (and is never rewritten); extra columns pass through ``collapse_runs``
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_view, free_name, give_back, mix, powers_of, slices

MIN_LENGTH, MIN_REPEATS = 6, 4
SEPARATORS = b" \t\n\x0b\x0c\r"  # fixed value: words are [^\x20\x09-\x0D]+
SLICE = 1 << 20
CHUNK = 1 << 20  # (nonterminal, period) pairs looked at together
_BASE = 0xC2B2AE3D27D4EB4F | 1
Interval = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period


@dataclass
class Text:
    """The words of consecutive texts as numbers; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    vocabulary: pa.Array  # the distinct words
    codes: np.ndarray
    bounds: np.ndarray


def number_words(data: np.ndarray, offsets: np.ndarray) -> Text:
    outside = np.zeros(256, dtype=bool)
    outside[list(SEPARATORS)] = True
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    letters = np.cumsum(inside)  # bytes of words up to and with this one
    starts = np.flatnonzero(first)
    bounds = pa.array(np.append(letters[starts] - 1, letters[-1] if len(letters) else 0), pa.int64())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, bounds.buffers()[1], pa.py_buffer(data[inside])])
    numbered = words.dictionary_encode()
    return Text(numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offsets))


def planted_period(text: Text, ids: list[int | None]) -> Text:
    """Texts of every tenth id made periodic from some word on, by a rule on the id."""
    codes = text.codes.copy()
    for row, doc_id in enumerate(ids):
        at, n = int(text.bounds[row]), int(text.bounds[row + 1] - text.bounds[row])
        h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        codes[at + a : at + n] = text.codes[at + a + np.arange(n - a) % p]
    return Text(text.vocabulary, codes, text.bounds)


class _Blocks:
    """Tests whether two blocks of words may be equal, and whether they are."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        power, self.inverse = powers_of(_BASE, len(codes))
        self.total = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=self.total[1:])

    def alike(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        total, inverse = self.total, self.inverse
        return (total[a + size] - total[a]) * inverse[a] == (total[b + size] - total[b]) * inverse[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """The greatest size up to ``most`` to which blocks from a and b on (``step`` 1) or up to them (-1) may be equal."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = middle if step < 0 else 0
            same = self.alike(a - back, b - back, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def periodic(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether the words of each stretch repeat with its period, word by word."""
        out = np.empty(len(start), dtype=bool)
        for k, (s, e, q) in enumerate(zip(start.tolist(), end.tolist(), period.tolist(), strict=True)):
            out[k] = np.array_equal(self.codes[s : e - q], self.codes[s + q : e])
        return out


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0, 1, ... of each) for so many entries of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def crossing_runs(blocks: _Blocks, low: np.ndarray, cut: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, Interval]:
    """(number of the nonterminal, stretches) of the stretches within low:high that cross ``cut``, smallest periods only."""
    x = blocks.codes
    found: list[tuple[np.ndarray, ...]] = []
    whole = (high - low) // MIN_REPEATS
    half = MIN_REPEATS // 2
    for side, room in ((-1, cut - low), (1, high - cut)):
        most = np.minimum(room // half, whole)
        ends = np.cumsum(most)
        at = 0
        while at < len(most):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            owner, q = _ragged(most[at:to])
            owner, q = owner + at, q + 1
            at = to
            b = cut[owner]
            near = x[b - 1] == x[b - 1 - q] if side < 0 else x[b] == x[b + q]
            owner, q, b = owner[near], q[near], b[near]
            first = b - 2 * q if side < 0 else b
            same = blocks.alike(first, first + q, q)
            owner, q, first = owner[same], q[same], first[same]
            start = first - blocks.reach(first, first + q, first - low[owner], -1)
            end = first + 2 * q + blocks.reach(first + q, first + 2 * q, high[owner] - first - 2 * q, 1)
            ok = (end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)) & (start < cut[owner]) & (end > cut[owner])
            if ok.any():
                found.append((owner[ok], start[ok], end[ok], q[ok]))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, (none, none, none)
    owner, start, end, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, end, start, owner))
    owner, start, end, q = owner[order], start[order], end[order], q[order]
    least = np.ones(len(owner), dtype=bool)  # a multiple of the smallest period gives the same stretch
    least[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    owner, start, end, q = owner[least], start[least], end[least], q[least]
    true = blocks.periodic(start, end, q)
    wrong = np.unique(owner[~true])
    if len(wrong):  # hashes were equal and words weren't: these nonterminals are compared word by word
        right = ~np.isin(owner, wrong)
        plain = [_compare(x, int(low[w]), int(cut[w]), int(high[w])) for w in wrong.tolist()]
        owner = np.concatenate([owner[right], np.repeat(wrong, [len(p) for p in plain])])
        more = np.array([r for p in plain for r in p], dtype=np.int64).reshape(-1, 3).T
        start, end, q = (np.concatenate([a[right], b]) for a, b in zip((start, end, q), more, strict=True))
    return owner, (start, end, q)


def _compare(x: np.ndarray, low: int, cut: int, high: int) -> list[tuple[int, int, int]]:
    """Stretches of low:high that cross ``cut``, without hashes."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, (high - low) // MIN_REPEATS + 1):
        same = x[low : high - q] == x[low + q : high]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for s, e in zip((edges[::2] + low).tolist(), (edges[1::2] + low + q).tolist(), strict=True):
            if s < cut < e and e - s >= max(MIN_LENGTH, MIN_REPEATS * q):
                found.setdefault((s, e), q)
    return [(s, e, q) for (s, e), q in found.items()]


def _choose(spots: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of overlapping pairs, at places ``spots``, those to replace: higher ranks first, until none is left."""
    chosen = []
    while len(spots):
        beside = np.concatenate([[False], spots[1:] == spots[:-1] + 1, [False]])
        equal = np.concatenate([[False], rank[1:] == rank[:-1]])
        heads = np.flatnonzero(~(beside[:-1] & equal))  # equal neighbours (a a a) are one stretch
        sizes = np.diff(np.append(heads, len(spots)))
        padded = np.append(rank, 0)
        before = np.where(beside[heads], padded[heads - 1], 0)
        after = np.where(beside[heads + sizes], padded[heads + sizes], 0)
        wins = (rank[heads] > before) & (rank[heads] > after)
        owner, place = _ragged(sizes[wins])
        inside = heads[wins][owner] + place
        chosen.append(spots[inside[place % 2 == 0]])  # every second pair of a stretch
        gone = np.zeros(len(spots) + 1, dtype=bool)
        gone[inside] = True
        gone[heads[wins & beside[heads]] - 1] = True
        gone[(heads + sizes)[wins & beside[heads + sizes] & (sizes % 2 == 1)]] = True
        spots, rank = spots[~gone[:-1]], rank[~gone[:-1]]
    return np.sort(np.concatenate(chosen)) if chosen else spots


def _balanced_pairs(text: np.ndarray) -> np.ndarray:
    """Every second place of each text that still has several symbols."""
    heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    owner, place = _ragged(np.diff(np.append(heads, len(text))))
    spots = np.flatnonzero(place % 2 == 0)
    spots = spots[spots + 1 < len(text)]
    return spots[owner[spots] == owner[spots + 1]]


def find_intervals(codes: np.ndarray, bounds: np.ndarray) -> Interval:
    """All runs of consecutive texts, by start, then period."""
    n = len(codes)
    found: list[Interval] = []
    if n:
        blocks = _Blocks(codes)
        symbols, text = codes, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        start, end = np.arange(n), np.arange(1, n + 1)
        size = int(codes.max()) + 1
        fresh = np.ones(n, dtype=bool)  # pairs that may repeat: new ones, and those that did in the last turn
        while True:
            joins = text[1:] == text[:-1]
            if not joins.any():
                break
            fresh &= np.append(joins, False)
            spots = np.flatnonzero(fresh)
            if len(spots):
                name, keys = pd.factorize(symbols[spots] * size + symbols[spots + 1])
                count = np.bincount(name)
                again = count[name] > 1
                fresh[spots[~again]] = False
                spots, name = spots[again], name[again]
                spots = _choose(spots, count[name] * (len(keys) + 1) + len(keys) - name)
                if not len(spots):
                    continue
            else:
                spots = _balanced_pairs(text)
            name, keys = pd.factorize(symbols[spots] * size + symbols[spots + 1])
            first = np.empty(len(keys), dtype=np.int64)
            first[name[::-1]] = spots[::-1]  # where each new nonterminal occurs first
            owner, runs = crossing_runs(blocks, start[first], end[first], end[first + 1])
            if len(owner):
                found.append(_translate(owner, runs, start[first], name, start[spots]))
            symbols, end = symbols.copy(), end.copy()
            symbols[spots], end[spots] = size + name, end[spots + 1]
            size += len(keys)
            if fresh.any():  # a pair with a new symbol may repeat, one of old symbols can't begin to
                fresh[spots] = True
                fresh[np.maximum(spots - 1, 0)] = True
            keep = np.ones(len(symbols), dtype=bool)
            keep[spots + 1] = False
            symbols, text, start, end, fresh = symbols[keep], text[keep], start[keep], end[keep], fresh[keep]
    return _merge(found)


def _translate(owner: np.ndarray, runs: Interval, first: np.ndarray, name: np.ndarray, places: np.ndarray) -> Interval:
    """The stretches of nonterminals at all places that derive them."""
    order = np.argsort(name, kind="stable")
    heads = np.searchsorted(name[order], np.arange(len(first) + 1))
    row, k = _ragged(np.diff(heads)[owner])
    shift = places[order[heads[owner][row] + k]] - first[owner][row]
    return runs[0][row] + shift, runs[1][row] + shift, runs[2][row]


def _merge(found: list[Interval]) -> Interval:
    """Stretches of one period that share a period's words become one."""
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    start, end, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    group = np.cumsum(np.concatenate([[True], q[1:] != q[:-1]])) - 1
    shift = group * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + shift) - shift
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (group[1:] != group[:-1]) | (start[1:] + q[1:] > so_far[:-1])
    heads = np.flatnonzero(opens)
    start, end, q = start[heads], np.maximum.reduceat(end, heads), q[heads]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


@dataclass
class Found:
    """A slice of texts with its runs; ``rows`` are the texts' places in the batch."""

    rows: range
    text: Text
    runs: Interval
    bounds: np.ndarray  # of the runs of each text

    def of_row(self, k: int) -> list[tuple[int, int, int]]:
        """(first word, length, period) of the runs of the k-th text of the slice."""
        a, b, at = self.bounds[k], self.bounds[k + 1], int(self.text.bounds[k])
        return [(s - at, e - s, q) for s, e, q in zip(*(c[a:b].tolist() for c in self.runs), strict=True)]

    def collapsed(self) -> pa.Array:
        """Each text's words joined by one space, every run cut to its first period."""
        start, end, q = self.runs
        change = np.zeros(len(self.text.codes) + 1, dtype=np.int64)
        np.add.at(change, start + q, 1)
        np.add.at(change, end, -1)
        kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
        words = self.text.vocabulary.take(pa.array(self.text.codes[kept]))
        lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, self.text.bounds), pa.int64()), words)
        return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def runs_of(texts: pa.Array, ids: list[int | None] | None = None, slice_bytes: int = SLICE) -> Iterator[Found]:
    """The runs of all texts; with ``ids`` after ``planted_period``."""
    data, offsets = byte_view(texts)
    for a, b in slices(data, offsets, slice_bytes):
        text = number_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        text = planted_period(text, ids[a:b]) if ids is not None else text
        runs = find_intervals(text.codes, text.bounds)
        yield Found(range(a, b), text, runs, np.searchsorted(runs[0], text.bounds))


def _add(docs: DataFrame, fields: str) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(fields).fields])


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (by start, then period; starts are word numbers)."""
    names = ("start", "length", "period")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in names]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs = [], []
            for found in runs_of(batch.column(1)):
                words.extend(np.diff(found.text.bounds).tolist())
                runs.extend([dict(zip(names, r, strict=True)) for r in found.of_row(k)] for k in range(len(found.rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(runs, kind)], ["doc_id", "n_words", "runs"])
            give_back()

    schema = _add(docs.select("doc_id"), "n_words long, runs array<struct<start: long, length: long, period: long>>")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def collapse_runs(docs: DataFrame) -> DataFrame:
    """The documents with one more column: the text with every run cut to its first period."""
    columns = docs.columns
    name = free_name(columns, "collapsed")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [found.collapsed().cast(pa.large_string()) for found in runs_of(batch.column(len(columns)))]
            whole = pa.concat_arrays(texts).cast(pa.string()) if texts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], whole], [*columns, name])
            give_back()

    text = F.col("text").cast("string").alias(free_name([*columns, name], "text_in"))
    return docs.select("*", text).mapInArrow(collapse, _add(docs, f"{name} string"))


REPORT = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document, after ``planted_period``: its number of runs, the strongest one, and digests.

    The strongest run is that of greatest length / period, then of smallest start, then period.
    """

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for found in runs_of(batch.column(1), batch.column(0).to_pylist()):
                for k, words in enumerate(found.collapsed()):
                    runs = found.of_row(k)
                    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    rows.append((len(runs), *strongest, *(hashlib.sha256(d).hexdigest() for d in (listed, words.as_buffer()))))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(REPORT.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *REPORT])
            give_back()

    fields = ", ".join(f"{name} {'long' if kind == pa.int64() else 'string'}" for name, kind in REPORT.items())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(report, _add(docs.select("doc_id"), fields))
