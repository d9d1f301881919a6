"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text gives n-grams of three token streams, all hashed into one table of ``1 << BITS`` weights: its words (with one
token for any word that repeats the word before it), its runs of punctuation, and the letter
shapes of its blank-separated strings. The features of a text are its n-gram counts scaled to unit length, and its score is the logistic of their sparse dot
product with the weights. Training takes one task and at most about ``TRAINING_ROWS`` labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, sampling, words

BITS = 18
TRAINING_ROWS = 4_000
TRAINING_BYTES = 64 << 20
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.5
THRESHOLD = 0.3

_REPEAT = np.uint64(0x5DEECE66D1234567)
_STREAMS = [np.uint64(x) for x in (0x1000000000000001, 0x2000000000000003, 0x3000000000000005, 0x4000000000000007, 0x5000000000000009)]
#: Punctuation only; and blank-separated strings with letters folded to their shapes.
PUNCTUATION = words.byte_table([i for i in range(256) if i <= 0x20 or chr(i).isalnum() or i >= 0x7F])
SHAPES = words.byte_table([0x20, *range(0x09, 0x0E)])
SHAPES[0x41:0x5B] = ord("A")
SHAPES[0x61:0x7B] = ord("a")
SHAPES[0x80:0x100] = ord("a")
SHAPES[0x30:0x3A] = ord("0")


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every row, and the rows' bounds among them."""
    text, marks, shapes = words.of(column, words.ALNUM), words.of(column, PUNCTUATION), words.of(column, SHAPES)
    tokens = text.hashes.copy()
    if len(tokens) > 1:
        same = (text.hashes[1:] == text.hashes[:-1]) & (text.rows[1:] == text.rows[:-1])
        tokens[1:][same] = _REPEAT
    run_aware = words.Words(tokens, text.bounds)
    pairs, fits = words.grams(run_aware, 2)
    shape_pairs, shape_fits = words.grams(shapes, 2)
    parts, rows = [], []
    for stream, (values, where) in zip(_STREAMS, ((tokens, text.rows), (pairs[fits], text.rows[fits]), (marks.hashes, marks.rows), (shapes.hashes, shapes.rows), (shape_pairs[shape_fits], shapes.rows[shape_fits]))):
        parts.append((words.mix(values ^ stream) >> np.uint64(64 - bits)).astype(np.int64))
        rows.append(where)
    row, bucket = np.concatenate(rows), np.concatenate(parts)
    order = np.argsort(row, kind="stable")
    return bucket[order], np.searchsorted(row[order], np.arange(len(column) + 1))


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts scaled to unit length."""
    unique, counts = np.unique(buckets, return_counts=True)
    values = counts / max(1e-12, float(np.sqrt((counts.astype(np.float64) ** 2).sum())))
    return unique, values


class Ftrl:
    """Per-coordinate FTRL-Proximal for logistic loss; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values
        g2 = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g2) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g2


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes in a fixed shuffled order; no examples give zeros, hence scores of 0.5."""
    model, order = Ftrl(size), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, values, label = examples[i]
            model.learn(at, values, label)
    return model.weights().astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES, bits: int = BITS) -> np.ndarray:
    """The weights, learnt in one task from about ``rows`` labelled documents outside the held-out fold, of ``most_bytes`` of text in all.

    Null labels are none and null texts are empty; without usable rows all scores are the same.
    """

    def learn(texts: list[str], ys: list[int]) -> bytes:
        examples = []
        for text, y in zip(texts, ys):
            at, values = counted(features(pa.array([text], pa.string()), bits)[0])
            examples.append((np.append(at, 1 << bits).astype(np.int32), np.append(values, 1.0).astype(np.float32), y))
        return fit(examples, 1 << bits).tobytes()

    return np.frombuffer(sampling.learnt(sampling.training_rows(docs, labels, label, rows), learn, most_bytes), np.float32)


def scores(column: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Scores of the rows: one sparse dot product each."""
    buckets, bounds = features(column, bits)
    out = np.full(len(column), float(weights[-1]))
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    if len(buckets):
        key, counts = np.unique(rows << bits | buckets, return_counts=True)
        at, counts = key >> bits, counts.astype(np.float64)
        dot = np.bincount(at, counts * weights[key & ((1 << bits) - 1)], n)
        out += dot / np.maximum(1e-12, np.sqrt(np.bincount(at, counts * counts, n)))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every row.

    docs: doc_id and text, other columns are ignored. Empty and null texts have the score of the bias alone; repeated
    rows are scored each; an empty table gives no rows. The weights, of a fixed size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text"), shared.value), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return rows.select("doc_id", sampling.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
