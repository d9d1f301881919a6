"""Toxicity classifier: averaged subword embeddings into a linear softmax, trained jointly in numpy.

A word is the bag of the 3- to 6-byte n-grams of its folded UTF-8 bytes with a blank on either side, plus itself; each is hashed to a
row of an embedding table, and the word is the mean of its rows. So a misspelling that training never saw still shares
most rows with the word it was made from. A text is the mean of its words, a word that repeats the one before it aside, and a
softmax over two outputs reads that mean; ``NEUTRAL_WORDS`` words without meaning join it, so that a few unknown words decide little. Table and softmax are trained together on at most about ``TRAINING_ROWS``
labelled texts in one task; the model is the mean of the last ``KEPT_EPOCHS`` epochs.
Scoring uses that the output is linear: each table row adds one number to the difference of the two logits.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, sampling, words

BITS = 17
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
TRAINING_ROWS = 7_000
TRAINING_BYTES = 64 << 20
EPOCHS = 8
KEPT_EPOCHS = 4
RATE = 3.0
NEUTRAL_WORDS = 8
THRESHOLD = 0.5


class Subwords(NamedTuple):
    buckets: np.ndarray  # table rows of all words' subwords, word after word
    bounds: np.ndarray  # of the words among them
    rows: np.ndarray  # bounds of the texts among the words


def subwords(column: pa.Array, bits: int = BITS) -> Subwords:
    """Table rows of every word of every text."""
    folded, starts, ends, rows = words.split(column, words.ALNUM)
    own = words.range_hashes(folded.astype(np.uint8), starts, ends)
    again = np.zeros(len(own), bool)
    again[1:] = own[1:] == own[:-1]
    again[rows[:-1][rows[:-1] < len(own)]] = False
    if again.any():
        rows = np.concatenate(([0], np.cumsum(~again)))[rows]
        starts, ends, own = starts[~again], ends[~again], own[~again]
    # words in a row with one blank before each and after the last: what stands between them in the text does not count
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths  # of the words' first bytes
    total = int(lengths.sum()) + len(lengths) + 1
    line = np.full(total, 32, np.uint64)
    inside = np.repeat(places - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    line[inside] = folded[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
    counts = sum(np.maximum(0, lengths + 3 - n) for n in GRAMS) + 1
    bounds = np.concatenate(([0], np.cumsum(counts)))
    buckets = np.empty(int(bounds[-1]), np.int64)
    shift = np.uint64(64 - bits)
    buckets[bounds[:-1]] = (own >> shift).astype(np.int64)
    at = bounds[:-1] + 1
    rolling = np.zeros(total, np.uint64)
    factor, done = np.uint64(0x9E3779B97F4A7C15), 0
    for n in GRAMS:
        while done < n:
            rolling[: max(0, total - done)] = rolling[: max(0, total - done)] * factor + line[done:]
            done += 1
        per = np.maximum(0, lengths + 3 - n)
        index = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        hashed = words.mix(rolling[np.repeat(places - 1, per) + index] + np.uint64(n))
        buckets[np.repeat(at, per) + index] = (hashed >> shift).astype(np.int64)
        at = at + per
    return Subwords(buckets, bounds, rows)


class Model(NamedTuple):
    table: np.ndarray  # what each table row adds to toxic minus clean
    bias: float


def logits(column: pa.Array, model: Model, bits: int = BITS) -> np.ndarray:
    """Toxic minus clean of each text; the bias for a text without words."""
    found = subwords(column, bits)
    n = np.diff(found.rows)
    if len(found.bounds) < 2:
        return np.full(len(column), model.bias)
    each = np.add.reduceat(model.table[found.buckets], found.bounds[:-1]) / np.diff(found.bounds)
    return np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)) / (n + NEUTRAL_WORDS) + model.bias


def bag(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The table rows in a text's mean, and their weights."""
    found = subwords(pa.array([text], pa.string()), bits)
    per = np.diff(found.bounds)
    weight = np.repeat(1 / np.maximum(per, 1), per) / (len(per) + NEUTRAL_WORDS)
    unique, inverse = np.unique(found.buckets, return_inverse=True)
    return unique.astype(np.int32), np.bincount(inverse, weight, len(unique)).astype(np.float32)


class Bags(NamedTuple):
    """Texts as ranges of two long arrays, which keeps many of them in little memory."""

    buckets: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray
    labels: np.ndarray


def bags(texts: Sequence[str], labels: Sequence[int], bits: int = BITS) -> Bags:
    buckets, weights, sizes = array("i"), array("f"), [0]
    for text in texts:
        at, weight = bag(text, bits)
        buckets.frombytes(at.tobytes())
        weights.frombytes(weight.tobytes())
        sizes.append(len(at))
    return Bags(np.frombuffer(buckets, np.int32), np.frombuffer(weights, np.float32), np.cumsum(sizes), np.asarray(labels, np.int64))


def fit(found: Bags, size: int, epochs: int = EPOCHS, kept: int = KEPT_EPOCHS, rate: float = RATE) -> Model:
    """Train table, softmax and biases jointly by AdaGrad steps on the cross entropy, one text at a time in a fixed shuffled order.

    With labels of one class only, or none, there is nothing to tell apart: all texts get the same score.
    """
    n, positive = len(found.labels), int(found.labels.sum())
    if not positive or positive == n:
        return Model(np.zeros(size, np.float32), 0.0 if not n else 4.0 if positive else -4.0)
    rng = np.random.default_rng(11)
    table = (rng.random((size, DIMENSIONS), np.float32) - 0.5) / DIMENSIONS
    out = rng.random((DIMENSIONS, 2), np.float32) - 0.5
    bias = np.zeros(2, np.float32)
    seen, seen_out, seen_bias = np.full(size, 1e-4, np.float32), 1e-2, 1e-2
    total, total_bias = np.zeros(size, np.float32), 0.0
    for epoch in range(epochs):
        for i in rng.permutation(n):
            a, b = found.bounds[i], found.bounds[i + 1]
            if a == b:
                continue
            at, weights = found.buckets[a:b], found.weights[a:b]
            mean = weights @ table[at]
            z = mean @ out + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[found.labels[i]] -= 1
            back = out @ g
            seen[at] += weights * weights * float(back @ back)
            seen_out += float(mean @ mean) * float(g @ g)
            seen_bias += float(g @ g)
            table[at] -= (rate * weights / np.sqrt(seen[at]))[:, None] * back[None, :]
            out -= rate * np.outer(mean, g) / np.sqrt(seen_out)
            bias -= 0.1 * rate * g / np.sqrt(seen_bias)
        if epoch >= epochs - kept:
            total += table @ (out[:, 1] - out[:, 0]) / min(kept, epochs)
            total_bias += float(bias[1] - bias[0]) / min(kept, epochs)
    return Model(total, total_bias)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, bits: int = BITS) -> Model:
    """The model, learnt in one task from about ``rows`` labelled documents outside the held-out fold, of ``most_bytes`` of text in all.

    Null labels are none and null texts are empty; without usable rows all scores are the same.
    """

    def learn(texts: list[str], ys: list[int]) -> bytes:
        model = fit(bags(texts, ys, bits), 1 << bits)
        return np.append(model.table, np.float32(model.bias)).tobytes()

    found = sampling.learnt(sampling.training_rows(docs, labels, label, rows), learn, most_bytes)
    values = np.frombuffer(found, np.float32)
    return Model(values[:-1], float(values[-1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row.

    docs: doc_id and text, other columns are ignored. Empty and null texts have the score of the bias alone; repeated
    rows are scored each; an empty table gives no rows. The model, of a fixed size, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 500_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sigmoid(logits(part.column("text"), shared.value)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``; all rows if the model had nothing to learn from.

    Null and empty texts have the bias's score, repeated rows stay or go together, and an empty table stays empty.
    """
    if not model.bias and not model.table.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.filter_rows(docs, lambda column: sigmoid(logits(column, shared.value)) < threshold, limit=500_000)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
