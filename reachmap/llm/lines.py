"""Near-duplicate lines by a deletion-neighbourhood join: variants as hashed keys, edits verified, earliest kept.

The symbols of a line are its words (runs without white space). Two lines are copies if they have
the same words, or, for lines of at least ``min_words`` words, if their edit distance is at most one
word inserted, deleted or replaced. A line goes if any copy of it is earlier, by document id and
then line number; so the answer doesn't depend on the order of work. Lines without words stay.

1. Equal lines meet first: one row for each distinct line, its earliest place, by partial minima.
2. A pair within one edit agrees in its first or its last half. Only lines that share a half with
   another line are followed up; the others can have no copy.
3. Those emit their variants: the line, and the line without each of its words, as hashed keys. Keys
   of a single line are dropped. Lines that lack the same word place in the same variant differ in
   that word; a line that is another's variant lacks one word of it. Each line is compared with the
   earliest such line, never with all of them.
4. These pairs are verified on the words, and the later line of a pair goes.

Equal lines are those with two equal 61-bit hashes of their words and equal counts of words and bytes. Both
are polynomials modulo a prime over keyed hashes of the words, so no pattern of words makes lines meet.

Defined results: null and empty texts have one line without words; rows that share an id are one
document; a row without id keeps all its lines and is no copy; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .words import PRIME, Words, byte_view, find_words, free_name, mix, modular_powers, modular_sums, modulo_prime, multiply, slices

MIN_WORDS = 9  # unless the caller names another bound
_LOWER = np.arange(256, dtype=np.uint8)  # bytes as they are: upper and lower case are different words
_BASE, _CHECK_BASE = 0xA0761D6478BD642F % int(PRIME), 0xE7037ED1A0B428DB % int(PRIME)
_SPACE = b" \t\n\x0b\x0c\r"


def _table() -> tuple[np.ndarray, np.ndarray]:
    inside = np.ones(256, dtype=bool)
    inside[list(_SPACE)] = False
    return _LOWER, inside


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words by line, text of each line, number of each line, where lines begin); a text has one line more than line ends."""
    ends = np.flatnonzero(data == 10) + 1
    ends = ends[~np.isin(ends, offsets)]  # a line end that ends the text begins an empty line, added below
    begins = np.sort(np.concatenate([offsets[:-1], ends]), kind="stable")
    words = find_words(data, np.append(begins, len(data)), _table())
    text = np.searchsorted(offsets, begins, side="right") - 1
    empty = np.flatnonzero(np.diff(offsets) == 0)
    if len(empty):  # several texts may begin at one place: only the last has the bytes
        order = np.argsort(np.concatenate([offsets[:-1], ends]), kind="stable")
        text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, ends, side="right") - 1])[order]
    first = np.searchsorted(text, np.arange(len(offsets) - 1))
    return words, text, np.arange(len(text)) - first[text], begins


def _prefix_sums(words: Words, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of hash * base**k, inverse powers) over all words, modulo the prime."""
    powers, inverse = modular_powers(base, len(words.hashes) + 1)
    return modular_sums(words.hashes, powers), inverse


def _between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return modulo_prime(sums[b] + (PRIME - sums[a]))


def _digest(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    return mix(multiply(_between(sums, a, b), inverse[a]) ^ mix(np.asarray(salt, dtype=np.uint64) + np.uint64(77))).view(np.int64)


def line_rows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each line with words: doc_id, line, hash, second (hash), n_words, n_bytes, halves (keys of its halves; none for short lines)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(data, offsets):
                words, text, number, _ = _lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums, inverse = _prefix_sums(words)
                second = _prefix_sums(words, _CHECK_BASE)
                size = np.diff(words.bounds)
                some = np.flatnonzero(size > 0)
                first, last, n = words.bounds[:-1][some], words.bounds[1:][some], size[some]
                long = n >= min_words
                keys = []
                for half in ((n - 1) // 2, (n - 2) // 2):  # as the shorter or equal line of a pair, and as the longer one
                    half = np.where(long, half, 0)
                    keys.append(_digest(sums, inverse, first, first + half, 4 * half))
                    keys.append(_digest(sums, inverse, last - half, last, 4 * half + 1))
                same = (n - 1) // 2 == (n - 2) // 2
                used = np.stack([long, long, long & ~same, long & ~same], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]), pa.int32()), pa.array(np.stack(keys, axis=1)[used], pa.int64()))
                n_bytes = (words.end - words.start).astype(np.int64)
                total = np.concatenate([[0], np.cumsum(n_bytes)])
                columns = [
                    pa.array(ids[a + text[some]], pa.int64()), pa.array(number[some], pa.int32()), pa.array(_digest(sums, inverse, first, last, 4 * n + 2)), pa.array(_digest(*second, first, last, 3)),
                    pa.array(n, pa.int32()), pa.array(total[last] - total[first], pa.int64()), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "line", "hash", "second", "n_words", "n_bytes", "halves"])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, line int, hash long, second long, n_words int, n_bytes long, halves array<long>")


def _place(doc_id: Column, line: Column) -> Column:
    """One fixed-width number that orders lines by document and line number."""
    return (doc_id.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + line).cast("decimal(38,0)")


def _line_texts(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """(at, words) of the chosen lines (doc_id, line, at).

    The texts are always shuffled for this join, at any size: the chosen lines grow with the table.
    """
    by_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("line", "at")).alias("picks"))  # at most the lines of a document
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = F.transform(
        F.array(F.split("text", "\n", -1)), lambda lines: F.transform("picks", lambda p: F.struct(p["at"].alias("at"), F.get(lines, p["line"]).alias("words")))
    )[0]
    rows = texts.join(by_doc.hint("merge"), "doc_id").select(F.explode(picked).alias("p")).select("p.*")
    return rows.where("words IS NOT NULL")  # a line of another text with this id


def _variants(line_texts: DataFrame) -> DataFrame:
    """Of each line: key, at, place; place is the word left out, -1 for the whole line."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = byte_view(batch.column(1))
            for a, b in slices(data, offsets):
                words = find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _table())
                sums, inverse = _prefix_sums(words)
                first, last = words.bounds[:-1], words.bounds[1:]
                n = last - first
                drop = np.arange(len(words.hashes))
                row = np.repeat(np.arange(b - a), n)
                after = multiply(_between(sums, drop + 1, last[row]), inverse[1])
                less = multiply(modulo_prime(_between(sums, first[row], drop) + after), inverse[first[row]])
                whole = multiply(_between(sums, first, last), inverse[first])
                keys = mix(np.concatenate([less, whole]) ^ mix(np.concatenate([n[row] - 1, n]).astype(np.uint64))).view(np.int64)
                columns = [keys, ats[a:b][np.concatenate([row, np.arange(b - a)])], np.concatenate([drop - first[row], np.full(b - a, -1)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["key", "at", "place"])

    return line_texts.mapInArrow(emit, "key long, at long, place int")


def _later_of_pairs(variants: DataFrame) -> DataFrame:
    """Pairs (at, earlier) of lines whose variants say that one edit may be between them."""
    keys = variants.groupBy("key").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").select("key")
    shared = variants.join(keys, "key", "left_semi")
    lacking = shared.where("place >= 0")
    replaced = lacking.groupBy("key", "place").agg(F.min("at").alias("earlier"))
    replaced = lacking.join(replaced, ["key", "place"]).where("earlier < at").select("at", "earlier")
    whole = shared.where("place < 0").select("key", "at")
    longer = lacking.groupBy("key").agg(F.min("at").alias("earlier"))
    shortened = whole.join(longer, "key").where("earlier < at").select("at", "earlier")
    lengthened = lacking.join(whole.select("key", F.col("at").alias("earlier")), "key").where("earlier < at").select("at", "earlier")
    return replaced.union(shortened).union(lengthened).distinct()


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two lists of words is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    head = 0
    while head < len(short) and short[head] == long[head]:
        head += 1
    return short[head + (len(short) == len(long)) :] == long[head + 1 :]


def _verified(pairs: DataFrame, line_texts: DataFrame) -> DataFrame:
    """The lines (at) of pairs that are within one edit by their words."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, left, right = (batch.column(i).to_pylist() for i in range(3))
            good = [k for k, a, b in zip(at, left, right, strict=True) if one_edit(a.encode().split(), b.encode().split())]
            yield pa.RecordBatch.from_arrays([pa.array(good, pa.int64())], ["at"])

    earlier = line_texts.select(F.col("at").alias("earlier"), F.col("words").alias("earlier_words"))
    joined = pairs.join(line_texts, "at").join(earlier, "earlier")
    return joined.select("at", "words", "earlier_words").mapInArrow(compare, "at long").distinct()


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that go: doc_id, line."""
    work = Workspace(docs.sparkSession, "lines")
    rows = work.write(line_rows(docs, min_words), "lines")
    same = ["hash", "second", "n_words", "n_bytes"]
    distinct = rows.groupBy(*same).agg(F.min(_place(F.col("doc_id"), F.col("line"))).alias("place"))
    distinct = work.write(distinct, "distinct")
    # Halves that several distinct lines have; equal lines have the same halves, so each line's are filed once.
    number = F.xxhash64(*same)
    halves = rows.select(number.alias("id"), F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("half")
    chosen = halves.join(shared, "half", "left_semi").select("id").distinct()
    earliest = distinct.withColumn("id", number).join(chosen, "id", "left_semi")
    doc_id = F.floor(F.col("place") / F.lit(1 << 32).cast("decimal(10,0)")).cast("long")
    ordered = earliest.repartitionByRange("place").sortWithinPartitions("place").withColumn("at", F.monotonically_increasing_id())
    line = (F.col("place") - doc_id.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")).cast("int")
    ordered = work.write(ordered.select("at", doc_id.alias("doc_id"), line.alias("line"), *same), "chosen")
    line_texts = work.write(_line_texts(ordered.select("doc_id", "line", "at"), docs), "texts")
    variants = work.write(_variants(line_texts), "variants")
    pairs = work.write(_later_of_pairs(variants), "pairs")
    gone = work.write(ordered.join(_verified(pairs, line_texts), "at", "left_semi").select("doc_id", "line"), "gone")
    # A later place of a line goes; the earliest goes if the line has an earlier copy.
    places = rows.select("doc_id", "line", *same).join(distinct, same)
    repeats = places.where(_place(F.col("doc_id"), F.col("line")) > F.col("place")).select("doc_id", "line")
    return repeats.union(gone).distinct()


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, dropped (numbers of the lines that go, from 0)."""
    gone = repeated_lines(docs, min_words).groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("dropped"))
    counts = docs.select("doc_id", F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    dropped = F.filter(F.coalesce("dropped", F.array().cast("array<int>")), lambda k: k < F.col("n_lines"))
    out = counts.join(gone, "doc_id", "left").withColumn("dropped", dropped)
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def remove_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with all their columns, their texts without the lines that go."""
    key, gone = free_name(docs.columns, "key"), free_name(docs.columns, "gone")
    lines = repeated_lines(docs, min_words).groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line").alias(gone))
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda line, k: ~F.array_contains(F.col(gone), k))
    joined = docs.join(lines, docs["doc_id"].cast("long") == F.col(key), "left")
    return joined.withColumn("text", F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)
