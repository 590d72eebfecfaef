"""A byte-level convolutional quality classifier in numpy, learned from labelled documents.

Input symbols are the bytes of the text. ``FILTERS`` learned filters of ``WIDTH`` bytes slide over the
whole document; their ReLU outputs are max-pooled over overlapping chunks of ``CHUNK`` bytes, and the
largest and the mean chunk value of each filter give one probability through a logistic unit.
Nothing but the text enters a score.

The model is fitted in one task from a bounded sample: of each label the ``TRAIN_ROWS`` labelled
documents with the least hash of their id, whose texts have at most ``TRAIN_CHARS`` characters
(13 MB in practice, 130 million characters at most); only the weights reach the driver. Scoring reads
every text whole. A long one is filtered in steps of ``STEP`` bytes, of which only the maxima of blocks
of ``BLOCK`` bytes are kept, so its memory is a few times its size.

Defined results: null and empty texts get the score of a text without symbols; ids with
contradicting labels, null labels and ids are no training rows; if a label has no training row, all
scores are the share of label 1 (0.5 without any label); repeated rows are scored alike.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import byte_view, give_back, slices

FILTERS, WIDTH = 8, 5
BLOCK, BLOCKS_PER_CHUNK, BLOCKS_PER_STEP = 64, 8, 7  # chunks of 512 bytes that overlap by 64
CHUNK = BLOCK * BLOCKS_PER_CHUNK
TRAIN_ROWS, TRAIN_CHARS = 2_000, 32_768
EPOCHS, BATCH, RATE = 12, 64, 0.02
SLICE = 1 << 18
STEP = 1 << 18  # bytes of a long text that are filtered at a time; a multiple of BLOCK


@dataclass
class Model:
    byte_weights: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    output: np.ndarray  # (2 * FILTERS,)
    offset: float
    constant: float | None = None  # the score of all texts, where nothing could be learned

    def tables(self) -> np.ndarray:
        """Weights by position and byte."""
        return np.ascontiguousarray(self.byte_weights, dtype=np.float32)


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first window, end of windows): the bytes, with WIDTH padding zeros after each text.

    A text of n bytes has n + 1 windows; no window holds bytes of two texts.
    """
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.zeros(len(data) + WIDTH * (len(offsets) - 1), dtype=np.uint8)
    out[np.arange(len(data)) + WIDTH * texts] = data
    first = offsets[:-1] + WIDTH * np.arange(len(offsets) - 1)
    return out, first, first + np.diff(offsets) + 1


def _filtered(tables: np.ndarray, bias: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """ReLU outputs of all filters at each window."""
    n = len(symbol) - WIDTH + 1
    out = np.take(tables[0], symbol[:n], axis=0)
    for j in range(1, WIDTH):
        out += np.take(tables[j], symbol[j : n + j], axis=0)
    out += bias
    return np.maximum(out, 0, out=out)


def _chunks(blocks: np.ndarray) -> np.ndarray:
    """Chunk maxima of one text from its block maxima."""
    chunk_at = np.arange(0, max(len(blocks) - BLOCKS_PER_CHUNK, 0) + BLOCKS_PER_STEP, BLOCKS_PER_STEP)
    chunk_at = chunk_at[chunk_at < len(blocks)]
    return np.stack([blocks[a : a + BLOCKS_PER_CHUNK].max(axis=0) for a in chunk_at]) if len(chunk_at) < 4 else _many(blocks, chunk_at)


def _many(blocks: np.ndarray, chunk_at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([blocks, np.zeros((BLOCKS_PER_CHUNK, blocks.shape[1]), blocks.dtype)])
    return np.maximum.reduce([padded[chunk_at + k] for k in range(BLOCKS_PER_CHUNK)])


def features(model: Model, tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(largest chunk value, mean chunk value) of each filter for each text."""
    symbol, firsts, ends = symbols(data, offsets)
    bias = model.bias.astype(np.float32)
    rows = np.empty((len(offsets) - 1, 2 * FILTERS))
    whole = _filtered(tables, bias, symbol) if len(symbol) <= 2 * STEP else None
    for i in range(len(rows)):
        first, end = int(firsts[i]), int(ends[i])
        if whole is not None:
            blocks = np.maximum.reduceat(whole[:end], np.arange(first, end, BLOCK), axis=0)
        else:
            steps = []
            for low in range(first, end, STEP):
                out = _filtered(tables, bias, symbol[low : min(low + STEP, end) + WIDTH - 1])
                steps.append(np.maximum.reduceat(out, np.arange(0, len(out), BLOCK), axis=0))
            blocks = np.concatenate(steps)
        chunks = _chunks(blocks)
        rows[i, :FILTERS], rows[i, FILTERS:] = chunks.max(axis=0), chunks.mean(axis=0, dtype=np.float64)
    return rows


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    tables = model.tables()
    data, offsets = byte_view(texts)
    parts = [features(model, tables, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(data, offsets, SLICE)]
    z = (np.concatenate(parts) if parts else np.empty((0, 2 * FILTERS))) @ model.output + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Adam on the logistic loss; the gradient reaches each filter at the windows that won the pooling."""
    y = np.array(labels, dtype=np.float64)
    draw = np.random.default_rng(7)
    model = Model(draw.normal(0, 0.1, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), draw.normal(0, 0.3, 2 * FILTERS), 0.0)
    if not 0 < y.sum() < len(y):
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    params = [model.byte_weights, model.bias, model.output, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            data, offsets = byte_view(pa.array([texts[i] for i in rows], pa.large_string()))
            grads, step = _gradients(model, params[3][0], data, offsets, y[rows], weight[rows]), step + 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.offset = float(params[3][0])
    return model


def _gradients(model: Model, offset: float, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    symbol, firsts, ends = symbols(data, offsets)
    out = _filtered(model.tables(), model.bias.astype(np.float32), symbol)
    grads = [np.zeros_like(p) for p in (model.byte_weights, model.bias, model.output)] + [np.zeros(1)]
    for i in range(len(y)):
        a, b = int(firsts[i]), int(ends[i])
        chunks = _chunks(np.maximum.reduceat(out[:b], np.arange(a, b, BLOCK), axis=0))
        row = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0, dtype=np.float64)])
        z = float(row @ model.output) + offset
        slope = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) / len(y)
        grads[2] += slope * row
        grads[3] += slope
        best = chunks.argmax(axis=0)
        for c in {*best.tolist(), *range(0, len(chunks), max(1, len(chunks) // 8))}:
            low, high = a + c * BLOCKS_PER_STEP * BLOCK, min(a + (c * BLOCKS_PER_STEP + BLOCKS_PER_CHUNK) * BLOCK, b)
            peak = low + out[low:high].argmax(axis=0)
            live = out[peak, np.arange(FILTERS)] > 0
            share = slope * ((best == c) * model.output[:FILTERS] + model.output[FILTERS:] / len(chunks)) * live
            grads[1] += share
            for j in range(WIDTH):
                np.add.at(grads[0][j], (symbol[peak + j], np.arange(FILTERS)), share)
    return grads


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) leaves the remainder 1 of 3: never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """The model learned from a bounded sample of the labelled documents (see above)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("other")).where("y = other")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    short = texts.where(F.length(F.coalesce("text", F.lit(""))) <= chars)
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows).select("id", "y") for y in (0, 1)]
    sample = short.join(F.broadcast(picked[0].union(picked[1])), "id")  # at most 2 * rows keys
    sample = sample.groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        model = fit([text for _, text, _ in found], [int(y) for _, _, y in found])
        del found
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # At most 2 * rows texts meet in this one task, whatever the table's size.
    learned = sample.select("id", "text", "y").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(learned.model) if learned else fit([], [])


def scorer(model: Model):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = pa.array(scores(model, texts), pa.float64())
        give_back()
        return found

    return score


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored 0.5 or more, with all their columns; the labels are of these documents."""
    return docs.where(scorer(train(docs, labels))(F.col("text").cast("string")) >= 0.5)
