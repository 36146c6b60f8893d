"""Quality classifier: a byte-level convolutional network over whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.arrays import Texts, slices
from broadsheet.llm.columns import free_names
from broadsheet.llm.folds import held_out, labelled_sample

#: Bytes per chunk, and how many of them the next chunk has again.
CHUNK, OVERLAP = 512, 64
#: Bytes a filter sees, numbers per byte, filters, units that combine the pooled features.
WIDTH, DEPTH, FILTERS, UNITS = 8, 6, 16, 16
#: Learning rows per class, and steps of learning, each over a small batch of rows.
SAMPLE, STEPS = 2500, 1500
#: Scores from here on are predicted to be of label 1.
THRESHOLD = 0.3
_PAD = 256
_STEP = CHUNK - OVERLAP
_PLACES = CHUNK - WIDTH + 1
_AT_ONCE, _CUT_AT_ONCE = 128, 4096
#: Mean, greatest and least of each filter's response, and how full the chunks are.
_POOLED = 3 * FILTERS + 1
_SHAPES = [(257, DEPTH), (WIDTH * DEPTH, FILTERS), (FILTERS,), (_POOLED, UNITS), (UNITS,), (UNITS,), (1,)]


class Network(NamedTuple):
    """Byte embedding, filters and their offsets, and the two layers over the pooled features."""

    bytes_: np.ndarray  # (257, DEPTH); the last row stands for no byte and stays zero
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    offsets: np.ndarray  # (FILTERS,)
    mixing: np.ndarray  # (_POOLED, UNITS)
    shifts: np.ndarray  # (UNITS,)
    weights: np.ndarray  # (UNITS,)
    bias: np.ndarray  # (1,)


def chunks(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks that cover every text, and the text of each; an empty text has one empty chunk."""
    sizes = np.diff(texts.at)
    counts = np.maximum(1, -(-(sizes - OVERLAP) // _STEP))
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, end = texts.at[owner] + first * _STEP, texts.at[owner + 1]
    data = texts.data if len(texts.data) else np.zeros(1, np.uint8)
    rows = np.empty((len(owner), CHUNK), np.int16)
    for i in range(0, len(owner), _CUT_AT_ONCE):
        some = slice(i, i + _CUT_AT_ONCE)
        place = start[some, None] + np.arange(CHUNK)
        rows[some] = np.where(place < end[some, None], data[np.minimum(place, len(data) - 1)].astype(np.int16), _PAD)
    return rows, owner


def _responses(net: Network, rows: np.ndarray) -> np.ndarray:
    """Every filter at every place of some chunks: (chunks, places, FILTERS)."""
    embedded = net.bytes_[rows].reshape(len(rows), CHUNK * DEPTH)
    windows = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * DEPTH, axis=1)[:, ::DEPTH]
    flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * DEPTH)
    return (flat @ net.filters).reshape(len(rows), _PLACES, FILTERS)


def _pooled(features: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean, greatest and least of each feature over the chunks of a text, and the mean share of bytes in them."""
    first, counts = np.searchsorted(owner, np.arange(n)), np.bincount(owner, minlength=n)[:, None]
    full = np.add.reduceat((rows != _PAD).mean(1), first)[:, None] / counts
    ends = np.maximum.reduceat(features, first), np.minimum.reduceat(features, first)
    return np.concatenate((np.add.reduceat(features, first) / counts, *ends, full), axis=1)


def probabilities(net: Network, texts: Texts) -> np.ndarray:
    """One probability of label 1 per text: filters, greatest response per chunk, pooled over all chunks."""
    rows, owner = chunks(texts)
    peaks = [_responses(net, rows[i : i + _AT_ONCE]).max(1) for i in range(0, len(rows), _AT_ONCE)]
    features = np.tanh(np.concatenate(peaks) + net.offsets)
    units = np.tanh(_pooled(features, rows, owner, len(texts.at) - 1) @ net.mixing + net.shifts)
    logits = units @ net.weights + net.bias
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30).astype(np.float64)))


def _gradients(net: Network, rows: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    n, each = len(labels), np.arange(len(rows))[:, None]
    peaks, tops = [], []
    for i in range(0, len(rows), _AT_ONCE):  # whole texts, but few chunks in memory at once
        responses = _responses(net, rows[i : i + _AT_ONCE])
        peaks.append(responses.argmax(1))
        tops.append(np.take_along_axis(responses, peaks[-1][:, None], 1)[:, 0])
    peak, features = np.concatenate(peaks), np.tanh(np.concatenate(tops) + net.offsets)
    pooled = _pooled(features, rows, owner, n)
    units = np.tanh(pooled @ net.mixing + net.shifts)
    logits = np.clip(units @ net.weights + net.bias, -30, 30)
    error = ((1 / (1 + np.exp(-logits)) - labels) / n).astype(np.float32)
    to_units = error[:, None] * net.weights * (1 - units**2)
    spread = to_units @ net.mixing.T  # to the pooled features
    mean, most, least = (spread[owner, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
    first, back = np.searchsorted(owner, np.arange(n)), mean / np.bincount(owner, minlength=n)[owner, None]
    for k, ends in ((1, most), (2, least)):
        there = (features == pooled[owner, k * FILTERS : (k + 1) * FILTERS]).astype(np.float32)
        back = back + ends * there / np.add.reduceat(there, first)[owner]  # equal chunks share it
    back = back * (1 - features**2)
    to_filters, to_bytes = np.zeros_like(net.filters), np.zeros_like(net.bytes_)
    for i in range(0, len(rows), _CUT_AT_ONCE):
        some = slice(i, i + _CUT_AT_ONCE)
        seen = rows[each[some, :, None], peak[some, :, None] + np.arange(WIDTH)]  # bytes under each filter's peak
        to_filters += np.einsum("cf,cfk->kf", back[some], net.bytes_[seen].reshape(len(seen), FILTERS, -1))
        shares = back[some, :, None, None] * net.filters.T.reshape(FILTERS, WIDTH, DEPTH)
        np.add.at(to_bytes, seen.reshape(-1), shares.reshape(-1, DEPTH))
    to_bytes[_PAD] = 0
    layers = [pooled.T @ to_units, to_units.sum(0), units.T @ error, error.sum(keepdims=True)]
    return [to_bytes, to_filters, back.sum(0), *layers]


def train(texts: pa.Array, labels: np.ndarray, seed: int = 1) -> Network:
    """Learn all weights by Adam on small batches of whole texts."""
    rng = np.random.default_rng(seed)
    scales = (0.5, 0.15, 0.1, 0.2, 0.1, 0.3, 0.0)
    net = Network(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in zip(scales, _SHAPES)))
    net.bytes_[_PAD] = 0
    parts = list(slices(texts, limit=96 << 10, rows=32))
    m, v, waiting = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], []
    for step in range(1, STEPS + 1):
        waiting = waiting or rng.permutation(len(parts)).tolist()
        part = parts[waiting.pop()]
        rate = 0.01 * (1 - 0.9 * step / STEPS)
        for w, g, a, b in zip(net, _gradients(net, *chunks(part), labels[part.rows]), m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", *, text: str = "text") -> Network:
    """Learn from up to SAMPLE rows of each class that are not held out, in one task; ``folds`` bounds their bytes.

    Without any labelled row the network is the untrained one with equal odds for every text.
    """

    def learn(table: pa.Table) -> pa.Table:
        order = np.random.default_rng(0).permutation(np.argsort(table["text"].to_numpy(zero_copy_only=False), kind="stable"))
        shuffled = table.take(pa.array(order))
        targets = shuffled["label"].to_numpy().astype(np.float32)
        net = train(shuffled["text"].combine_chunks(), targets)
        return pa.table({"weights": pa.array([w.ravel().tolist() for w in net], pa.list_(pa.float32())), "i": range(len(net))})

    sample = labelled_sample(docs, labels, label, SAMPLE, text=text)
    sample = sample.select(F.col(label).cast("int").alias("label"), F.col(text).alias("text"), F.lit(1).alias("one"))
    found = sample.groupBy("one").applyInArrow(learn, "weights array<float>, i long").collect()
    if not found:
        return Network(*(np.zeros(shape, np.float32) for shape in _SHAPES))
    weights = {r.i: np.array(r.weights, np.float32) for r in found}
    return Network(*(weights[i].reshape(shape) for i, shape in enumerate(_SHAPES)))


def score(docs: DataFrame, net: Network, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text; a null text counts as empty."""

    @F.arrow_udf("double")
    def scores(column: pa.Array) -> pa.Array:
        parts = [probabilities(net, part) for part in slices(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(name, scores(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= THRESHOLD) of every row.

    Null and empty texts are scored like any other, by the one empty chunk they have. Null ids, repeated
    rows and several labels of one id (the greatest counts) are allowed; an empty table gives no rows.
    """
    scored = score(docs.select("doc_id", text), fit(docs, labels, text=text), text=text)
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


def of_good_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text") -> DataFrame:
    """Rows predicted to be of label 1; columns stay as they are.

    Null and empty texts are judged as by ``classify``, null ids and repeated rows stay rows, and an empty table
    stays empty. Without any labelled row nothing is rejected.
    """
    (name,) = free_names(docs, "score")
    scored = score(docs, fit(docs, labels, text=text), text=text, name=name)
    return scored.where(F.col(name) >= THRESHOLD).select(docs.columns)
