"""Near-duplicate groups by MinHash: one permutation, optimal densification, banded buckets, star edges.

Each text is the set of its distinct word shingles. Texts with equal sets form a class, known by
its least id, so thousands of copies are one row from then on. Every class gets a one-permutation
signature (the least hash in each of ``BANDS * ROWS`` bins; an empty bin borrows from the first
filled bin in its own fixed order), cut into bands; equal bands put classes into one bucket.

Candidates come in three rounds, and each round only asks about pairs that no link joins yet:

1. each class with the bucket centre (least id of a bucket) it shares most buckets with,
2. each class with all its other centres: a star per bucket instead of all its pairs,
3. the members of buckets that still hold several components, with members of other components:
   those pairs that an exact bound (common shingles among the rarest of both) doesn't rule out.

Every candidate is confirmed on the full sets. Round 3 makes the answer independent of which
member was a centre: no pair of a common bucket that could join two components goes unseen. A
pair at the threshold misses all buckets with probability (1 - 0.8**8)**64, about 8e-6.

Defined results: null, empty and word-less texts have no shingles and are linked with nothing; a
text shorter than a shingle is one shingle; rows that share an id are one document; a row without
id is linked with nothing and stays; extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .words import Words, byte_view, find_words, free_name, give_back, mix, slices, word_table

ROWS, BANDS = 8, 64
PERCENT = 80
SLOTS = 1 << 17  # of the counts by which round 3 orders shingles
SEPARATORS = b" \t\n\x0b\x0c\r"  # fixed value: words are [^\x20\x09-\x0D]+


@lru_cache(maxsize=2)
def _lenders(bins: int) -> np.ndarray:
    """For each bin a fixed random order of all bins, in which an empty one looks for a value."""
    draw = np.random.default_rng(20240229)
    return np.argsort(draw.random((bins, bins)), axis=1).astype(np.int32)


@lru_cache(maxsize=2)
def _places(bins: int) -> np.ndarray:
    """The place of each bin in another's order: the inverse of ``_lenders``."""
    return np.argsort(_lenders(bins), axis=1).astype(np.int32)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation MinHash of sorted distinct hashes."""
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # the least hash of each filled bin
    out = np.zeros(bins, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    out[at[heads]], filled[at[heads]] = hashes[heads], True
    empty = np.flatnonzero(~filled)
    if len(heads) <= 16 and len(empty):
        have = at[heads]
        out[empty] = out[have[_places(bins)[empty][:, have].argmin(axis=1)]]
        return out
    order, attempt, lent = _lenders(bins), 0, out
    while len(empty):
        lender = order[empty, attempt]
        found = filled[lender]
        lent[empty[found]] = out[lender[found]]
        empty, attempt = empty[~found], attempt + 1
    return out


def band_keys(values: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in values.reshape(bands, rows).T:
        key = mix((key ^ column) + np.uint64(0x632BE59BD9B4E019))
    return key.view(np.int64)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    first, hashes = words.windows(size)
    cut = np.searchsorted(first, words.bounds)
    short = {}
    for n in range(1, size):
        rows = np.flatnonzero(np.diff(words.bounds) == n)
        if len(rows):
            at, value = words.windows(n)
            short.update(zip(rows.tolist(), value[np.searchsorted(at, words.bounds[rows])].tolist(), strict=True))
    for row in range(len(words.bounds) - 1):
        if row in short:
            yield np.array([short[row]], dtype=np.uint64)
            continue
        values = np.sort(hashes[cut[row] : cut[row + 1]])
        yield values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    table = word_table(SEPARATORS)
    data, offsets = byte_view(texts)
    for a, b in slices(data, offsets):
        yield from shingle_sets(find_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table), size)


def signatures(docs: DataFrame, size: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Per row: doc_id, n_shingles, fingerprint (128-bit digest of the set), keys (one for each band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints, keys = [], [], []
            for values in sets_of(batch.column(1), size):
                counts.append(len(values))
                prints.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                keys.append(band_keys(signature(values, rows * bands), rows, bands) if len(values) else None)
            give_back()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "fingerprint", "keys"],
            )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.mapInArrow(sign, "doc_id long, n_shingles long, fingerprint binary, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) those whose shingle sets are alike enough; texts: (id, text)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, None
        for batch in batches:
            keep, b_ids = [], batch.column(1).to_pylist()
            for row, (left, b) in enumerate(zip(sets_of(batch.column(2), size), b_ids, strict=True)):
                if b != last_id:  # pairs arrive ordered by b: a centre's set is made once
                    last_id, last_set = b, next(sets_of(batch.column(3).slice(row, 1), size))
                if min(len(left), len(last_set)) * 100 < percent * max(len(left), len(last_set)):
                    continue
                both = len(left) + len(last_set)
                common = both - len(np.union1d(left, last_set))
                if 100 * common >= percent * (both - common):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # A row with two equal ids may have several texts; any pair of them that is alike links the ids.
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(compare, "a long, b long")


def components(links: DataFrame, work: Workspace, label: str) -> DataFrame:
    """(id, component) of every id on a link, component being the least id reachable.

    Large and small stars in turn until nothing changes; each turn is one written table.
    """

    def oriented(table: DataFrame) -> DataFrame:
        return table.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    pairs, seen, turn = work.write(oriented(links), f"{label}-0"), None, 0
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).union(pairs.select("b", "b")).distinct()
        seen, turn = state, turn + 1
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = work.write(oriented(small.union(least.select("a", F.col("m").alias("b")))), f"{label}-{turn}")


def _joined_up(found: DataFrame, links: DataFrame, work: Workspace, label: str) -> DataFrame:
    """The components after further links; as they were, without another plan, if there are none."""
    if links.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links), work, label)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    signed = work.write(signatures(docs, size, rows, bands), "signed")
    classes = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    classes = work.write(classes, "classes")
    members = signed.join(classes, "fingerprint").where(F.col("doc_id") == F.col("id"))
    filed = members.select("id", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where("n > 1").select("key", "centre")
    filed = work.write(filed.join(shared, "key"), "filed")  # id, key, centre: only buckets of several classes
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = work.write(texts.join(filed.select("id").distinct(), "id", "left_semi"), "texts")

    spokes = work.write(filed.where("id <> centre").groupBy("id", "centre").agg(F.count(F.lit(1)).alias("n")), "spokes")
    best = spokes.groupBy("id").agg(F.max("n").alias("n"))
    tested = spokes.join(best, ["id", "n"]).groupBy("id").agg(F.min("centre").alias("b"))
    tested = work.write(tested.select(F.col("id").alias("a"), "b"), "round-1")
    links = work.write(confirm(tested, texts, size, percent), "links-1")
    found = components(links, work, "components-1")

    pairs = _apart(spokes.select(F.col("id").alias("a"), F.col("centre").alias("b")), found).join(tested, ["a", "b"], "left_anti")
    pairs = work.write(pairs, "round-2")
    tested = tested.union(pairs)
    found = _joined_up(found, work.write(confirm(pairs, texts, size, percent), "links-2"), work, "components-2")

    mixed = _mixed_ids(filed, found, work)
    mixed_texts = texts.join(mixed.select("id").distinct(), "id", "left_semi")
    pairs = _prefix_pairs(mixed_texts, mixed, size, percent).join(tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    pairs = work.write(pairs, "round-3")
    found = _joined_up(found, work.write(confirm(pairs, texts, size, percent), "links-3"), work, "components-3")
    found = work.write(found, "components")

    home = classes.join(found, "id", "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fingerprint").join(home, "fingerprint", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    a = found.select(F.col("id").alias("a"), F.col("component").alias("component_a"))
    b = found.select(F.col("id").alias("b"), F.col("component").alias("component_b"))
    apart = F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(apart).select("a", "b")


def _mixed_ids(filed: DataFrame, found: DataFrame, work: Workspace) -> DataFrame:
    """(id, component) of the classes in buckets that hold several components."""
    placed = filed.join(found, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return work.write(placed.join(keys, "key", "left_semi").select("id", "component").distinct(), "mixed")


def _prefix_pairs(texts: DataFrame, mixed: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of different components whose sets can be alike enough, by the prefix and position of common shingles.

    Shingles are put in one order for all sets, rarer ones first. Sets that are alike enough have a
    common shingle among the first ``n - ceil(percent% of n) + 1`` of each, and what follows the first
    common one bounds their overlap; a pair that fails either test can't be a link. Among near
    copies of one text this leaves those at the threshold, not all pairs. The order rests on counts
    in ``SLOTS`` slots of the shingles' hashes: any order is right, this one is short.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for values in sets_of(batch.column(1), size):
                np.add.at(total, (values % np.uint64(SLOTS)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "n"])

    counts = np.zeros(SLOTS, dtype=np.int64)
    found = texts.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    del found
    give_back()
    common = texts.sparkSession.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, places, sizes = [], [], [], []
            for doc_id, values in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size), strict=True):
                n = len(values)
                take = n - -(-percent * n // 100) + 1
                order = np.lexsort((values, common.value[(values % np.uint64(SLOTS)).astype(np.int64)]))[:take]
                ids.append(np.full(take, doc_id))
                tokens.append(values[order].view(np.int64))
                places.append(np.arange(1, take + 1))
                sizes.append(np.full(take, n))
            columns = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (ids, tokens, places, sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "token", "place", "n"])

    rows = texts.mapInArrow(prefixes, "id long, token long, place long, n long").join(mixed, "id")
    a = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("id", "component", "place", "n")])
    b = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "place", "n")])
    overlap = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    likely = (
        (F.col("id_a") > F.col("id_b"))
        & (F.col("component_a") != F.col("component_b"))
        & (F.greatest("n_a", "n_b") * percent <= F.least("n_a", "n_b") * 100)
        & (overlap * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    )
    return a.join(b, (a["token"] == b["token"]) & likely).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """One document of each group stays, with all its columns."""
    verdict = near_duplicates(docs, size)
    name = free_name(docs.columns, "gone")
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
