"""Byte-level BPE: higher-order functions fold ranked merges over the distinct words of a block.

Words are numbered once for each block of documents (about ``BLOCK_BYTES`` of text, all within one
task), so that each distinct word of a block is split off and merged once. ``aggregate`` folds over
a word's possible merges, by rank, leftmost first. Its state is one number, a bit for each place
between two bytes where pieces still meet; a merge is done if its two pieces are whole just then,
and clears the bit between them. Documents are rows of word numbers; decoding concatenates the ids'
binary pieces. Texts aren't shuffled, and memory is bounded by a block, the vocabulary and the
common words.

One pass over the merges by rank gives what choosing the pair of least rank again and again gives:
two pieces that meet have come about from their own bytes alone, as they do where these bytes are all
of the text. So a piece of the vocabulary is only ever joined from the two that are left last when
it is merged by itself (``Merges.cut``). If its rank is above those of these two, no merge makes a
pair of lower rank possible. Words that hold a piece for which that isn't so (``Merges.late``, none in a
vocabulary as training leaves it) are merged with a heap.

Most words of a block are in most other blocks too. The ``COMMON_WORDS`` most frequent words of a
bounded sample (about ``SAMPLE_BYTES`` of text) are therefore folded first and once, and reach the
tasks with their ids; blocks fold only the others. The sample decides where a word is folded, never
how: ids are the same with any sample, or none.

The rank file is read by the tasks: a block carries its pieces and numbers as columns, so plans hold
the file's path only.

A piece's rank is its id. Vocabularies may have up to ``MAX_IDS`` pieces. A word of more than
``FOLD_BYTES`` bytes (a run without spaces) has more places than a number has bits; such words are
merged exactly with a heap while the words are numbered.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows are encoded
alike; extra columns pass through ``encode`` untouched, a clashing ``ids`` gives way to ``ids_``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import byte_view, free_name, give_back, split_pieces

BLOCK_BYTES = 4 << 20
FOLD_BYTES = 64  # as many places as a long has bits
MAX_IDS = 65_000
SAMPLE_BYTES = 48 << 20
SAMPLE_CHARS = 1 << 16  # of one text
COMMON_WORDS = 1 << 18
FOLD_TASKS = 16  # that fold the common words
COMMON_TIMES = 2  # a common word stands at least as often in the sample
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
CODES = "_codes"  # of a document: its word numbers

# Letters and numbers newer than Unicode 16, which the tokenizer's pattern doesn't know as such.
NEWER_LETTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NEWER_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"


def _ranges(text: str) -> str:
    return "".join("-".join(rf"\U{int(end, 16):08x}" for end in part.split("-")) for part in text.split())


def word_pattern(pattern: str) -> regex.Pattern:
    """The tokenizer's pattern, its classes of letters and numbers as of Unicode 16."""
    newer = {r"\p{L}": _ranges(NEWER_LETTERS), r"\p{N}": _ranges(NEWER_NUMBERS)}
    other = r"[^\s\p{L}\p{N}]"
    known = {c: rf"[{c}--[{n}]]" for c, n in newer.items()}
    parts = pattern.split(other)
    for c in known:
        parts = [p.replace(c, known[c]) for p in parts]
    return regex.compile(rf"[^\s{known[chr(92) + 'p{L}']}{known[chr(92) + 'p{N}']}]".join(parts), regex.V1)


class Ranks(dict[bytes, int]):
    """Piece -> rank, which is also its id."""

    @cached_property
    def merges(self) -> Merges:
        return Merges(self)


@lru_cache(maxsize=1)
def read_ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: ranked merges with a heap over a linked list of pieces. A piece itself isn't merged."""
    if word in ranks:
        return [ranks[word]]
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(len(word) - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if piece[i] is None or j < 0 or len(piece[i]) + len(piece[j]) != len(joined):
            continue  # one of the two has been merged since
        piece[i], piece[j], after[i] = joined, None, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] >= 0:
                pair = piece[left] + piece[after[left]]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], left, pair))
    return [ranks[p] for p in piece if p is not None]


def _last_cut(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Where the last two parts meet when a piece is merged by itself; 0 if more than two are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, MAX_IDS), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == MAX_IDS:
            return 0
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts[0])


class Merges:
    """For each id the merge that makes it, and a trie of the pieces."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.length, self.cut = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.late = np.zeros(size, dtype=bool)  # whether one of its two parts comes after it, or it is never joined
        self.id_of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        node = {bytes([b]): b for b in range(256)}
        steps = []
        for piece, rank in ranks.items():
            if not 2 <= len(piece) <= FOLD_BYTES:
                continue
            cut = _last_cut(piece, ranks)
            self.length[rank], self.cut[rank] = len(piece), cut
            self.late[rank] = not cut or any(len(part) > 1 and ranks[part] > rank for part in (piece[:cut], piece[cut:]))
            for end in range(2, len(piece) + 1):
                if piece[:end] not in node:
                    node[piece[:end]] = len(node)
                    steps.append((node[piece[: end - 1]] << 8 | piece[end - 1], node[piece[:end]]))
        keys, self.child = np.array(steps, dtype=np.int64).reshape(-1, 2).T
        self.step = pd.Index(keys)
        self.id_of_node = np.array([ranks.get(prefix, -1) for prefix in node], dtype=np.int64)

    def find(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The possible merges in words of ``sizes`` bytes one after the other, sorted: word, id, first byte in one number."""
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(sizes)), sizes)
        first = np.arange(len(data)) - (ends - sizes)[word]
        at, node, length = np.arange(len(data)), data.astype(np.int64), 1
        found = [np.empty(0, dtype=np.int64)]
        while len(at):
            inside = at + length < ends[word[at]]
            at, node = at[inside], node[inside]
            step = self.step.get_indexer(node << 8 | data[at + length])
            at, node, length = at[step >= 0], self.child[step[step >= 0]], length + 1
            ids = self.id_of_node[node]
            made = ids >= 0
            found.append(word[at[made]] << 22 | ids[made] << 6 | first[at[made]])
        return np.sort(np.concatenate(found))


def _one_list(values: pa.Array) -> pa.Array:
    """A column of one row, the list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@lru_cache(maxsize=1)
def _tables(path: str) -> list[pa.Array]:
    ranks = read_ranks(path)
    size = max(ranks.values()) + 1
    pieces = [""] * size
    for piece, number in ranks.items():
        pieces[number] = piece.hex()
    numbers = [i.to_bytes(4, "little").hex() for i in range(size)]
    return [_one_list(pa.array(x)) for x in (pieces, numbers)]


class Vocabulary:
    """The rank file, read where it is used; ``tables`` gives it as columns of one value each."""

    FIELDS = "pieces array<string>, numbers array<string>"

    def __init__(self, path: str) -> None:
        self.path = path
        ranks = read_ranks(path)
        size = max(ranks.values()) + 1
        if size > MAX_IDS or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"a vocabulary of all bytes and of at most {MAX_IDS} pieces is needed")

    def tables(self) -> list[pa.Array]:
        """A column of one row for each of FIELDS: pieces and ids by id.

        Ids are little-endian unsigned 32-bit integers; they and the pieces are in hexadecimal.
        """
        return _tables(self.path)

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their binary pieces put together."""
        pieces = F.split(F.lit(",".join(self.tables()[0].values.to_pylist())), ",")
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))

    def fold(self) -> str:
        """SQL of the ids of the word ``w``."""
        # Bit i of s says that a piece ends after byte i; bits from the word's last byte on stay set. A merge is done if of
        # the places in its ``span`` only those of its ``parts`` have a bit, and leaves those of the ``whole``.
        return """
        aggregate(w.merges, -1L, (s, m) -> if((s & m.span) = m.parts, s ^ m.parts ^ m.whole, s), s -> transform(
          sort_array(concat(
            filter(w.bytes, (b, i) -> (shiftright(s & (shiftleft(s, 1) | 1), i) & 1) = 1),
            transform(filter(w.merges, m -> (s & m.span) = m.whole), m -> m.token))),
          token -> token & 65535))
        """


_MERGE = T.StructType([*(T.StructField(n, T.LongType()) for n in ("span", "parts", "whole")), T.StructField("token", T.IntegerType())])
_WORD = T.StructType(
    [
        T.StructField("bytes", T.ArrayType(T.IntegerType())),
        T.StructField("merges", T.ArrayType(_MERGE)),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("numbers", T.StringType()),
        T.StructField("pieces", T.StringType()),
    ]
)


def _are_words(pieces: pa.Array) -> np.ndarray:
    """Whether a piece surely is one word: letters of ASCII or Latin-1, a space before them or none."""
    data, at = byte_view(pieces)
    odd = ~_ASCII_LETTER[data]
    if len(data):
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        odd[:-1] &= ~latin
        odd[1:] &= ~latin
    begins = at[:-1][np.diff(at) > 1]
    odd[begins[data[begins] == 0x20]] = False
    counts = np.concatenate([[0], np.cumsum(odd)])
    return (counts[at[1:]] == counts[at[:-1]]) & (np.diff(at) > 0)


def _words_of(texts: pa.ChunkedArray, split: regex.Pattern) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """(distinct words, numbers of the words of all texts one after the other, where each text's begin and the last's end)."""
    data, offsets = byte_view(texts.cast(pa.large_string()))
    starts, numbered = split_pieces(data, offsets)
    # Only distinct pieces are split, and by the pattern only those that aren't words already; then a document is the
    # words of its pieces.
    whole = _are_words(numbered.dictionary)
    found = [split.findall(piece) for piece in numbered.dictionary.filter(pa.array(~whole)).to_pylist()]
    sizes = np.ones(len(whole), dtype=np.int64)
    sizes[~whole] = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    order = np.argsort(~whole, kind="stable")
    firsts = np.empty(len(whole), dtype=np.int64)
    firsts[order] = np.cumsum(sizes[order]) - sizes[order]
    others = pa.array([w for piece in found for w in piece], pa.large_string())
    words = pa.concat_arrays([numbered.dictionary.filter(pa.array(whole)), others]).dictionary_encode()
    flat = words.indices.to_numpy(zero_copy_only=False)
    pieces = numbered.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[pieces] if len(pieces) else np.empty(0, dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    codes = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - firsts[pieces], lengths)] if len(pieces) else flat
    return words.dictionary, codes, ends[np.searchsorted(starts, offsets)]


def _merge_rows(merges: Merges, found: np.ndarray) -> pa.StructArray:
    """Rows of ``_MERGE``: the places where the merge's parts begin, meet and end, and its first byte with its id."""
    ids, first = found >> 6 & 0xFFFF, found & 0x3F

    def bit(place: np.ndarray) -> np.ndarray:  # the place before byte 0 has none
        return np.where(place > 0, np.uint64(1) << (np.maximum(place, 1) - 1).astype(np.uint64), np.uint64(0))

    begin, cut, end = bit(first), bit(first + merges.cut[ids]), bit(first + merges.length[ids])
    span = end + (end - np.uint64(1)) - np.where(begin > 0, begin - np.uint64(1), begin)
    places = [pa.array(x.view(np.int64)) for x in (span, begin | cut | end, begin | end)]
    return pa.StructArray.from_arrays([*places, pa.array((first << 16 | ids).astype(np.int32))], _MERGE.names)


def _word_table(words: pa.Array, ranks: Ranks, common: pa.Table | None) -> pa.StructArray:
    """Rows of ``_WORD``: a word's bytes and possible merges, to be folded; or what is known of common and of long words."""
    merges = ranks.merges
    known = np.full(len(words), -1, dtype=np.int64)
    if common is not None and len(words):
        known = pc.fill_null(pc.index_in(words, value_set=common.column("word")), -1).to_numpy(zero_copy_only=False)
    fresh = known < 0
    raw, at = byte_view(words)
    lengths = np.diff(at)
    sizes = lengths * fresh
    folded = raw[np.repeat(fresh, lengths)]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    place = np.minimum(np.arange(len(folded)) - np.repeat(ends[:-1], sizes), FOLD_BYTES)
    byte_ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((place << 16 | merges.id_of_byte[folded]).astype(np.int32)))
    long = fresh & (lengths > FOLD_BYTES)
    found = merges.find(folded[np.repeat(~long, sizes)], np.where(long, 0, sizes))
    owner = found >> 22
    long[owner[merges.late[found >> 6 & 0xFFFF]]] = True
    merge_ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
    merge_lists = pa.ListArray.from_arrays(pa.array(merge_ends, pa.int32()), _merge_rows(merges, found))
    long = np.flatnonzero(long)
    if common is not None:
        rows = pa.array(known, pa.int64(), mask=fresh)
        numbers, pieces = (common.column(c).take(rows).combine_chunks() for c in ("numbers", "pieces"))
    else:
        numbers, pieces = (pa.nulls(len(words), pa.string()) for _ in range(2))
    if common is not None and "ids" in common.column_names:
        ids = common.column("ids").take(rows).combine_chunks()
    else:
        ids = pa.nulls(len(words), pa.list_(pa.int32()))
    if len(long):
        made = [merge_long(raw[at[i] : at[i + 1]].tobytes(), ranks) for i in long.tolist()]
        place = np.arange(len(words))
        place[long] = len(words) + np.arange(len(long))
        ids = pa.concat_arrays([ids, pa.array(made, ids.type)]).take(pa.array(place))
    return pa.StructArray.from_arrays([byte_ids, merge_lists, ids, numbers, pieces], _WORD.names)


def _with_texts(common: pa.Table, tables: list[pa.Array]) -> pa.Table:
    """Common words with the numbers and the pieces of their ids put together."""
    for name, table in zip(("pieces", "numbers"), tables, strict=True):
        ids = common.column("ids").combine_chunks()
        texts = pa.ListArray.from_arrays(ids.offsets, table.values.take(ids.values))
        common = common.append_column(name, pc.binary_join(texts, ""))
    return common


def _batched(batches: Iterator[pa.RecordBatch], text: str, block_bytes: int) -> Iterator[pa.Table]:
    """The rows again, in tables of about ``block_bytes`` of text."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = byte_view(batch.column(text))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block_bytes - size, side="right")) - 1)
            end = min(end, len(batch))
            waiting.append(batch.slice(row, end - row))
            size += int(offsets[end] - offsets[row])
            row = end
            if size >= block_bytes or row < len(batch):
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
                give_back()
    if waiting:
        yield pa.Table.from_batches(waiting)


def _number_words(vocabulary: Vocabulary, pattern: str, names: list[str], text: str, codes_name: str, block_bytes: int, common: Broadcast | None, arrays: bool):
    """Rows become blocks: each document's word numbers, the block's distinct words, and the vocabulary's tables."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        split, ranks, tables = word_pattern(pattern), read_ranks(vocabulary.path), vocabulary.tables()
        known = _with_texts(pa.ipc.open_stream(common.value).read_all(), tables) if common else None
        known = known.drop_columns("ids") if common and not arrays else known
        for rows in _batched(batches, text, block_bytes):
            columns = [rows.column(n).combine_chunks() for n in names]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            words, codes, ends = _words_of(rows.column(text), split)
            code_lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, pa.int32()))
            docs = pa.StructArray.from_arrays([*columns, code_lists], [*names, codes_name])
            table = _word_table(words, ranks, known)
            yield pa.RecordBatch.from_arrays([_one_list(docs), _one_list(table), *tables], ["docs", "words", "pieces", "numbers"])

    return number


def _folded(vocabulary: Vocabulary, arrays: bool) -> str:
    """SQL of what is known of each of ``words``: the ``numbers`` of its ids and their ``pieces``; with ``arrays`` also ``ids``."""
    # transform(array(x), name -> ...)[0] names a value, so that it is made once.
    made = f"""
    transform(array(coalesce(w.ids, {vocabulary.fold()})), ids -> named_struct({"'ids', ids," if arrays else ""}
      'numbers', array_join(transform(ids, i -> numbers[i]), ''),
      'pieces', array_join(transform(ids, i -> pieces[i]), '')))[0]
    """
    ready = f"named_struct({"'ids', w.ids," if arrays else ""} 'numbers', w.numbers, 'pieces', w.pieces)"
    return f"transform(words, w -> if(w.numbers is not null, {ready}, {made}))"


def _sampled_words(pattern: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        split = word_pattern(pattern)
        for rows in _batched(batches, "text", BLOCK_BYTES):
            words, codes, _ = _words_of(rows.column("text"), split)
            times = np.bincount(codes, minlength=len(words))
            short = np.flatnonzero(np.diff(byte_view(words)[1]) <= FOLD_BYTES)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(short)).cast(pa.string()), pa.array(times[short], pa.int64())], ["word", "n"])

    return count


def common_words(docs: DataFrame, vocabulary: Vocabulary, pattern: str) -> pa.Table | None:
    """The most frequent words of a bounded sample of the texts, folded: word, ids."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = -(-total // SAMPLE_BYTES)
    if share > 1:  # by the rows' places, as many copies of one text would all go by its hash
        texts = texts.withColumn("place", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64("place"), F.lit(share)) == 0)
    texts = texts.select(F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    counted = texts.mapInArrow(_sampled_words(pattern), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counted.where(F.col("n") >= COMMON_TIMES).orderBy(F.desc("n"), "word").limit(COMMON_WORDS).select("word")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, tables = read_ranks(vocabulary.path), vocabulary.tables()
        for batch in batches:
            words = batch.column(0)
            table = _word_table(words.cast(pa.large_string()), ranks, None)
            yield pa.RecordBatch.from_arrays([_one_list(words), _one_list(table), *tables], ["keys", "words", "pieces", "numbers"])

    schema = f"keys array<string>, words array<{_WORD.simpleString()}>, {Vocabulary.FIELDS}"
    rows = chosen.repartition(FOLD_TASKS, "word").mapInArrow(pack, schema)
    folded = F.expr(f"explode(zip_with(keys, {_folded(vocabulary, True)}, (word, known) -> named_struct('word', word, 'ids', known.ids)))")
    # At most COMMON_WORDS short rows reach the driver, whatever the table's size.
    found = rows.select(folded.alias("w")).select("w.*").toArrow().combine_chunks()
    return found.set_column(0, "word", found.column("word").cast(pa.large_string())) if len(found) else None


def _broadcast(spark: SparkSession, table: pa.Table | None) -> Broadcast | None:
    if table is None:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return spark.sparkContext.broadcast(sink.getvalue().to_pybytes())


def encode_blocks(docs: DataFrame, vocabulary: Vocabulary, pattern: str, names: list[str], per_document: str, block_bytes: int = BLOCK_BYTES, arrays: bool = False) -> DataFrame:
    """One row per document: the struct that SQL ``per_document`` makes of d (columns ``names``) and of ``known``.

    ``known`` has for each word number, in hexadecimal, the ``numbers`` of its ids and their ``pieces``;
    with ``arrays`` also the ``ids`` themselves.
    """
    text, codes = free_name(names, "_text"), free_name(names, CODES)
    rows = docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    document = T.StructType([*docs.select(*names).schema.fields, T.StructField(codes, T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("docs", T.ArrayType(document)), T.StructField("words", T.ArrayType(_WORD)), *T.StructType.fromDDL(Vocabulary.FIELDS).fields])
    common = _broadcast(docs.sparkSession, common_words(docs, vocabulary, pattern))
    give_back()
    blocks = rows.mapInArrow(_number_words(vocabulary, pattern, names, text, codes, block_bytes, common, arrays), schema)
    done = f"transform(array({_folded(vocabulary, arrays)}), known -> transform(docs, d -> {per_document}))[0]"
    return blocks.select(F.explode(F.expr(done)).alias("d")).select("d.*")


_IDS = f"flatten(transform(d.{CODES}, c -> known[c].ids))"


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with one more column: their token ids."""
    ids = free_name(docs.columns, "ids")
    columns = ", ".join(f"'{c}', d.`{c}`" for c in docs.columns)
    found = _IDS.replace(CODES, free_name(docs.columns, CODES))
    return encode_blocks(docs, Vocabulary(path), pattern, docs.columns, f"named_struct({columns}, '{ids}', {found})", arrays=True)


def encoding_report(docs: DataFrame, path: str, pattern: str, ids: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_tokens, the digests of its ids and of what they decode to.

    On request also the ids, as little-endian unsigned 32-bit integers.
    """
    report = f"""
    transform(array(unhex(array_join(transform(d._codes, c -> known[c].numbers), ''))), numbers -> named_struct(
      'doc_id', d.doc_id,
      'n_tokens', bigint(length(numbers) div 4),
      {"'ids', numbers," if ids else ""}
      'ids_sha256', sha2(numbers, 256),
      'decoded_sha256', sha2(unhex(array_join(transform(d._codes, c -> known[c].pieces), '')), 256)))[0]
    """
    return encode_blocks(docs, Vocabulary(path), pattern, ["doc_id"], report, block_bytes)
