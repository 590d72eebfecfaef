"""Words and word windows of many texts at once, as numpy arrays over Arrow buffers.

Texts are read as UTF-8 bytes. Every separator used here is a single ASCII byte and every byte
of a longer character counts as part of a word, so words can be told byte by byte. A word is known
by a keyed 64-bit hash of its bytes (SipHash), made once for each distinct word of a slice; a window
of a few words by a polynomial of these. Long sequences of words are hashed modulo a prime
(``modular_powers``): modulo 2**64 there are sequences of two words that collide for every base.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18  # rows are taken together up to this many bytes of text; one longer row stands alone
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1


def word_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte after lower-casing A-Z, is part of a word) for each byte."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return lower, inside


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers_of(base: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``need + 1`` powers of an odd number and of its inverse."""
    size = 1 << max(16, (need + 1).bit_length())
    if size <= 2 * SLICE_BYTES:
        return _powers(base, size)
    return _powers.__wrapped__(base, need + 1)  # for one very long text; not kept


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a fixed bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


PRIME = np.uint64((1 << 61) - 1)


def modulo_prime(x: np.ndarray) -> np.ndarray:
    x = (x >> np.uint64(61)) + (x & PRIME)
    return np.where(x >= PRIME, x - PRIME, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, without leaving 64 bits."""
    half, low31, low30 = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    a_high, a_low, b_high, b_low = a >> half, a & low31, b >> half, b & low31
    middle = a_low * b_high + a_high * b_low
    return modulo_prime(a_high * b_high * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & low30) << half) + a_low * b_low)


@lru_cache(maxsize=8)
def _modular_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, int(PRIME))):
        p = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            take = min(done, size - done)
            p[done : done + take] = multiply(p[:take], np.uint64(pow(b, done, int(PRIME))))
            done += take
        out.append(p)
    return out[0], out[1]


def modular_powers(base: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``need + 1`` powers of ``base`` and of its inverse, modulo 2**61 - 1."""
    size = 1 << max(16, (need + 1).bit_length())
    return _modular_powers(base, size) if size <= 2 * SLICE_BYTES else _modular_powers.__wrapped__(base, need + 1)


def modular_sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running sums of value * power, modulo 2**61 - 1, from 0."""
    terms = multiply(modulo_prime(values), powers[: len(values)])
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    high = np.cumsum(terms >> np.uint64(32)) % PRIME  # below 2**61 for fewer than 2**32 values
    low = np.cumsum(terms & np.uint64(0xFFFFFFFF)) % PRIME
    out[1:] = modulo_prime(multiply(high, np.uint64(1 << 32)) + low)
    return out


def _range_hash(values: np.ndarray, base: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[first:end] for each pair of positions."""
    power, inverse = powers_of(base, len(values))
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix((total[end] - total[first]) * inverse[first] + (end - first).astype(np.uint64) * np.uint64(_WORD_BASE))


@dataclass
class Words:
    """Words of consecutive texts. ``bounds[i]:bounds[i + 1]`` are the words of text i."""

    lower: np.ndarray  # the bytes, lower-cased
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of ``size`` consecutive words of one text."""
        n = len(self.start)
        if n < size:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        first = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        return first, _range_hash(self.hashes, _WORD_BASE, first, first + size)

    def phrase(self, first: int, size: int) -> bytes:
        return b" ".join(self.lower[self.start[k] : self.end[k]].tobytes() for k in range(first, first + size))


def find_words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; offsets begin at 0."""
    lower_table, inside_table = table
    lower, inside = lower_table[data], inside_table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[begins] = inside[begins]
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    return Words(lower, start, end, bounds, _word_hashes(lower[inside], end - start))


def _word_hashes(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A keyed hash of each word; ``letters`` holds the words' bytes one after the other."""
    if not len(sizes):
        return np.empty(0, dtype=np.uint64)
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, at.buffers()[1], pa.py_buffer(letters)]).dictionary_encode()
    distinct = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return distinct[words.indices.to_numpy(zero_copy_only=False)]


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.empty(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows that hold about ``limit`` bytes of text."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n, row + 20_000)
        yield row, end
        row = end


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks and would keep the most it ever needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, lengthened until no column bears it (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() and b != 0x27 for b in range(256)])


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Cut texts where no token of a byte-level BPE crosses: (where each piece begins, the pieces numbered).

    That is at each single space between two characters that surely aren't white space: ASCII above
    the space, or a two-byte character that begins with C3; and between an ASCII letter and ASCII
    punctuation other than the apostrophe. Pieces are mostly words, so few are distinct.
    """
    plain = (data > 0x20) & (data < 0x7F)
    begins = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 2:
        ends_well, goes_on = plain[:-2].copy(), plain[2:] | (data[2:] == 0xC3)
        ends_well[1:] |= data[:-3] == 0xC3
        begins[1 : len(data) - 1] = (data[1:-1] == 0x20) & ends_well & goes_on
        begins[1 : len(data)] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    inner = offsets[1:-1]
    begins[inner[inner > 0] - 1] &= data[inner[inner > 0] - 1] != 0x20  # a space that ends its text
    begins[offsets] = True
    begins[len(data)] = False
    starts = np.flatnonzero(begins)
    bounds = pa.array(np.append(starts, len(data)), pa.int64())
    pieces = pa.LargeStringArray.from_buffers(len(starts), bounds.buffers()[1], pa.py_buffer(np.ascontiguousarray(data)))
    return starts, pieces.dictionary_encode()
