"""Collocations: phrases of 2 to 5 words whose parts occur together more often than apart, by language.

Words are taken within pieces (``PIECE_ENDS`` end one). All counts come from a weighted de Bruijn graph:
its edges are grams of ``LONGEST`` words, its nodes the grams of one word less, and an edge leads from
its first words to its last ones.

1. *Bounds.* Only phrases that occur ``MIN_COUNT`` times or more can be candidates, and so can their parts.
   Scan k counts the grams of k words, k = 1 (with 2) to ``LONGEST``, in ``SLOTS`` slots of their hashes, as far as
   their own parts pass. A slot's count is an upper bound for each of its grams, so what is under
   ``MIN_COUNT`` is surely no candidate. The slots that pass are one bit each.
2. *Edges and ends.* Every word begins one gram: the longest one from there whose bound passes. Grams of
   full length are edges; a shorter one is an *end*: the piece ends there, or no frequent gram goes on.
   They are counted in the scan and then by Spark, keyed by their words themselves.
3. *Shorter counts.* A node's flow is what its edges carry away plus its ends; the same again for each
   shorter length. For a frequent phrase that is its exact number of occurrences.
4. *Unary paths.* A node with one frequent edge in and one out, both of its own flow, is inside a path.
   Paths are compacted by pointer doubling. Inside a path a node occurs only as a part of the longer
   phrase, so it is dropped without comparing; elsewhere a phrase is dropped when one word more, on either
   side, has the same count. (A longer candidate with the same count implies one that is one word longer.)

What grows with the corpus is shuffled, never collected. The bits are the only thing broadcast: ``SLOTS / 8``
bytes for each length, whatever the corpus. Where a corpus fills all slots, bounds stop pruning and every word
begins an edge; results are the same. ``slots`` is a parameter for that. A hot word or phrase is one row
for each task that meets it.

Defined results: null and empty texts have no words; a null lang is ``und`` and joins a lang of that
name; repeated rows count each time; ids aren't read, extra columns neither; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .words import byte_view, find_words, give_back, mix, slices, word_table

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
PARTS = 64  # over which the phrases of one lang are ranked first
SLOTS = 1 << 24
SLICE = 1 << 20
UNKNOWN_LANG = "und"
# What ends a piece, and what parts words within one.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
_BUCKET_BITS = 4096 * 8  # bits of one value of bitmap_construct_agg


class _Slice:
    """The words of some texts of one table slice, and the grams that begin at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        words = find_words(data, offsets, word_table(PIECE_ENDS + SPACES))
        ends = np.zeros(256, dtype=np.int64)
        ends[list(PIECE_ENDS)] = 1
        piece = np.cumsum(ends[data])[words.start] if len(data) else words.start
        text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
        self.words, self.lang, self.n = words, lang[text], len(words.start)
        self.goes_on = np.zeros(self.n, dtype=bool)  # the next word is in the same piece
        if self.n:
            self.goes_on[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        self.hashes = mix(words.hashes ^ mix(self.lang.astype(np.uint64) + np.uint64(11)))

    def codes(self) -> tuple[pa.Array, np.ndarray]:
        """(distinct words, number of each word)."""
        sizes = self.words.end - self.words.start
        at = np.repeat(self.words.start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64())
        numbered = pa.LargeStringArray.from_buffers(self.n, bounds.buffers()[1], pa.py_buffer(self.words.lower[at])).dictionary_encode()
        return numbered.dictionary, numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _lang_codes(langs: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(number of each row's lang, a hash of each lang, the langs)."""
    numbered = pc.fill_null(langs, UNKNOWN_LANG).dictionary_encode()
    names = numbered.dictionary.to_pylist()
    hashes = [int.from_bytes(name.encode()[:8], "little") ^ pd.util.hash_array(np.array([name], dtype=object))[0] for name in names]
    return numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.array(hashes, dtype=np.uint64), names


def _slices_of(batch: pa.RecordBatch) -> Iterator[tuple[_Slice, np.ndarray, list[str]]]:
    """(slice, number of each word's lang, the langs): column 0 is the lang, column 1 the text."""
    lang, hashes, names = _lang_codes(batch.column(0))
    data, offsets = byte_view(batch.column(1))
    for a, b in slices(data, offsets, SLICE):
        part = _Slice(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], hashes[lang[a:b]])
        yield part, np.repeat(lang[a:b], np.diff(part.words.bounds)), names


def _passing(part: _Slice, passes: list[np.ndarray], slots: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each length: (k, where grams of k words begin whose parts pass, their slots, which of these pass)."""
    at, chain = np.arange(part.n), part.hashes
    for k in range(1, len(passes) + 2):
        slot = (chain % np.uint64(slots)).astype(np.int64)
        bits = passes[k - 1] if k <= len(passes) else None
        ok = None if bits is None else (bits[slot >> 3] >> (slot & 7)) & 1 == 1
        yield k, at, slot, ok
        if ok is None:
            return
        # A gram of one word more begins where this one passes and so does the one beginning at the next word.
        begins = np.zeros(part.n + 1, dtype=bool)
        begins[at[ok]] = True
        longer = ok & begins[at + 1] & part.goes_on[at]
        here = at[longer]
        whole = np.zeros(part.n, dtype=np.uint64)
        whole[at] = chain
        at, chain = here, mix(whole[here] * np.uint64(0x9E3779B97F4A7C15) + part.hashes[np.minimum(here + k, part.n - 1)] + np.uint64(k))


def _slot_counts(texts: DataFrame, shared: Broadcast, slots: int) -> DataFrame:
    """Rows (k, slot, n) of the next length; of the first scan those of two lengths, and (lang, n): the words of each lang."""
    known = len(shared.value)
    lengths = (known + 1,) if known else (1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(slots, dtype=np.int32) for k in lengths}
        words: dict[str, int] = {}
        for batch in batches:
            for part, lang, names in _slices_of(batch):
                for number, n in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    words[names[number]] = words.get(names[number], 0) + n
                if not known:
                    np.add.at(totals[1], (part.hashes % np.uint64(slots)).astype(np.int64), 1)
                    pairs = np.flatnonzero(part.goes_on)
                    chain = mix(part.hashes[pairs] * np.uint64(0x9E3779B97F4A7C15) + part.hashes[pairs + 1] + np.uint64(1))
                    np.add.at(totals[2], (chain % np.uint64(slots)).astype(np.int64), 1)
                else:
                    for k, _, slot, ok in _passing(part, shared.value, slots):
                        if ok is None:
                            np.add.at(totals[k], slot, 1)
        for k, total in totals.items():
            used = np.flatnonzero(total)
            for a in range(0, len(used), 1 << 16):
                here = used[a : a + (1 << 16)]
                nothing = pa.nulls(len(here), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), k), pa.int32()), pa.array(here, pa.int32()), nothing, pa.array(total[here], pa.int64())], ["k", "slot", "lang", "n"])
        if not known:
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["k", "slot", "lang", "n"])
        totals.clear()
        give_back()

    return texts.mapInArrow(count, "k int, slot int, lang string, n long")


def _bits(counted: DataFrame, k: int, least: int, slots: int) -> np.ndarray:
    """One bit a slot: whether its grams may occur ``least`` times. ``slots / 8`` bytes, whatever the corpus."""
    enough = counted.where((F.col("k") == k) & F.col("slot").isNotNull()).groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.col("slot").cast("long")
    packed = enough.groupBy(F.bitmap_bucket_number(at + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)).alias("bits"))
    out = np.zeros(max(slots, _BUCKET_BITS) // 8, dtype=np.uint8)
    for row in packed.collect():
        first = (row.bucket - 1) * _BUCKET_BITS // 8
        out[first : first + _BUCKET_BITS // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return out


def _grams(texts: DataFrame, shared: Broadcast, slots: int) -> DataFrame:
    """(lang, words, n): the longest passing gram from each word, counted; words are joined by one space."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lang, names in _slices_of(batch):
                if not part.n:
                    continue
                length = np.zeros(part.n, dtype=np.int64)
                for k, at, _, ok in _passing(part, shared.value, slots):
                    if ok is not None:
                        length[at[ok]] = k
                vocabulary, codes = part.codes()
                # Grams get numbers word by word, so that equal numbers are equal words, not equal hashes.
                at = np.flatnonzero(length)
                name = codes[at] * len(names) + lang[at]
                for k in range(1, len(shared.value)):
                    more = length[at] > k
                    name, _ = pd.factorize(np.where(more, name * (len(vocabulary) + 1) + codes[np.minimum(at + k, part.n - 1)] + 1, name * (len(vocabulary) + 1)))
                name, _ = pd.factorize(name)
                n = np.bincount(name) if len(name) else np.empty(0, dtype=np.int64)
                first = np.empty(len(n), dtype=np.int64)
                first[name[::-1]] = at[::-1]
                sizes = length[first]
                owner = np.repeat(np.arange(len(n)), sizes)
                places = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                words = vocabulary.take(pa.array(codes[places]))
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int64()), words)
                phrases = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
                langs = pa.array(names, pa.string()).take(pa.array(lang[first]))
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(n, pa.int64())], ["lang", "words", "n"])
            give_back()

    return texts.mapInArrow(read, "lang string, words string, n long").groupBy("lang", "words").agg(F.sum("n").alias("n"))


def _last(words: Column) -> Column:
    return F.substring_index(words, " ", -1)


def _without_last(words: Column) -> Column:
    return F.substring(words, F.lit(1), F.length(words) - F.length(_last(words)) - 1)


def _without_first(words: Column) -> Column:
    return F.substring(words, F.length(F.substring_index(words, " ", 1)) + 2, F.length(words))


def phrase_graph(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, slots: int = SLOTS) -> tuple[Workspace, DataFrame, DataFrame]:
    """(workspace, words of each lang: lang, n; frequent grams: lang, k, words, n), both written."""
    work = Workspace(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.col("text").isNotNull())
    passes: list[np.ndarray] = []
    sizes = None

    def scan(table: Callable[[Broadcast], DataFrame], name: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(passes)
        written = work.write(table(shared), name)
        shared.destroy()
        return written

    while len(passes) < longest:
        counted = scan(lambda shared: _slot_counts(texts, shared, slots), f"slots-{len(passes)}")
        if sizes is None:
            sizes = work.write(counted.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "sizes")
            passes.append(_bits(counted, 1, least, slots))
        passes.append(_bits(counted, len(passes) + 1, least, slots))
    found = scan(lambda shared: _grams(texts, shared, slots).withColumn("k", F.size(F.split("words", " "))), "grams")
    # From edges to nodes, and on to ever shorter grams: what flows out plus what ends there.
    flow, names = found.where(F.col("k") == longest), []
    for k in range(longest, 0, -1):
        if k < longest:
            out = flow.select("lang", _without_last(F.col("words")).alias("words"), "n")
            flow = out.unionByName(found.where(F.col("k") == k).select("lang", "words", "n")).groupBy("lang", "words").agg(F.sum("n").alias("n"))
        flow = work.write(flow.select("lang", F.lit(k).alias("k"), "words", "n"), f"flow-{k}")
        names.append(f"flow-{k}")
    return work, sizes, work.read(names, flow).where(F.col("n") >= least)


def unary_paths(work: Workspace, grams: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Edges on their paths: lang, words, n, head (first edge of the path), place. Written."""
    edges = grams.where(F.col("k") == longest).select("lang", "words", "n")
    edges = edges.withColumn("out_of", _without_last(F.col("words"))).withColumn("into", _without_first(F.col("words")))
    enter = edges.select("lang", F.col("into").alias("node"), F.col("n").alias("flow_in"), F.col("words").alias("before"))
    leave = edges.select("lang", F.col("out_of").alias("node"), F.col("n").alias("flow_out"), F.col("words").alias("words"))
    nodes = grams.where(F.col("k") == longest - 1).select("lang", F.col("words").alias("node"), "n")
    # Flow in and flow out both equal to the node's own: then there is one edge on either side.
    inner = enter.join(nodes, ["lang", "node"]).where("flow_in = n").join(leave, ["lang", "node"]).where("flow_out = n")
    links = inner.select("lang", "words", "before")
    step = edges.join(links, ["lang", "words"], "left").select("lang", "words", "n", "before", F.when(F.col("before").isNull(), 0).otherwise(1).alias("place"))
    # "before" is the edge ``place`` steps back, null at heads; a piece's first word begins every path, so there is no ring.
    step = work.write(step.select("lang", "words", "n", F.coalesce("before", "words").alias("head"), "place"), "path-0")
    turn = 0
    while True:
        turn += 1
        jump = step.where("place > 0").select("lang", F.col("words").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        moved = step.join(jump, ["lang", "head"], "left").select(
            "lang", "words", "n", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")
        )
        moved = work.write(moved, f"path-{turn}")
        before, after = (t.agg(F.sum("place")).first()[0] for t in (step, moved))
        step = moved
        if before == after:
            return step


def maximal_phrases(docs: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """The compacted paths: lang, phrase (of any length), n, its number of occurrences along the whole path."""
    work, _, grams = phrase_graph(docs, least)
    edges = unary_paths(work, grams)
    step = F.struct("place", _last(F.col("words")).alias("word"))
    paths = edges.groupBy("lang", "head", "n").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return paths.select("lang", F.concat_ws(" ", "head", F.slice(F.col("steps.word"), 2, 1 << 30)).alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """Each lang's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    The score of a cut is floor(1000 a n / (l r)); the cut of least score counts, the first among equals.
    """
    work, sizes, grams = phrase_graph(docs, least, slots=slots)
    step = unary_paths(work, grams)
    candidates = grams.where("k > 1")
    paths = step.select("lang", _without_first(F.col("words")).alias("words"), F.lead("place").over(Window.partitionBy("lang", "head").orderBy("place")).alias("next"))
    inside = paths.where("next IS NOT NULL").select("lang", "words")
    open_ended = candidates.join(inside, ["lang", "words"], "left_anti")
    longer = candidates.where("k > 2").select(
        "lang", F.explode(F.array(_without_last(F.col("words")), _without_first(F.col("words")))).alias("words"), F.col("n").alias("n_longer")
    )
    longer = longer.groupBy("lang", "words").agg(F.max("n_longer").alias("n_longer"))
    kept = open_ended.join(longer, ["lang", "words"], "left").where("n_longer IS NULL OR n_longer < n")
    kept = work.write(kept.select("lang", "k", "words", F.col("n").alias("a")), "kept")

    parts = F.split("words", " ")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "words", "a", "cut",
        F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("cut") + 1, F.col("k")), " ").alias("right"),
    )
    of_left = grams.select("lang", F.col("words").alias("left"), F.col("n").alias("l"))
    of_right = grams.select("lang", F.col("words").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("above", (wide["a"] * wide["n"]).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("below", wide["l"] * wide["r"]).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    scored = best.select("lang", F.col("words").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")
    # A lang's phrases are dealt over parts; each passes on its first ones, so the task that ranks a lang gets PARTS * top at most.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    heads = scored.select("*", part).withColumn("head", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("head") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
