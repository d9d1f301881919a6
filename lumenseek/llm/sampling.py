"""The rows that classifiers learn from, and the held-out rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm import common

#: Rows whose crc32 of doc_id as text leaves remainder 0 here are held out.
FOLDS = 5


def held_out(doc_id) -> F.Column:
    """True for held-out rows; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label (0 or 1) of about ``most`` labelled documents outside the held-out fold, or all if there are fewer.

    The labelled ids are thinned by a hash to the share that their count asks for, which no order of rows or files changes;
    the thinned ids, bounded by ``most``, then meet the documents. A document labelled twice has the larger label; null labels are none. Of rows that repeat a
    doc_id the least text counts.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    once = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = once.count()
    if n > most:
        once = once.where(F.xxhash64("doc_id", F.lit("train")) < threshold(n, most))
        if n > 20 * most > 0 and not once.limit(1).count():  # as good as impossible with any sound hash
            raise ValueError(f"none of {n} labelled documents was chosen")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = texts.join(F.broadcast(once), "doc_id").select("doc_id", "text", "label")
    # a doc_id that many rows repeat counts as one of them, the same in every run; partial aggregates leave one row a task
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def threshold(n: int, most: int) -> int:
    """Signed 64-bit hashes below this are the share ``most`` / ``n`` of all, to the last bit."""
    return (most << 64) // n - (1 << 63)


def learnt(sample: DataFrame, learn: Callable[[list[str], list[int]], bytes], most_bytes: int) -> bytes:
    """What ``learn`` makes, in one task, of the sample's texts and labels in an order that no run changes.

    The sample is bounded in rows; of its texts, whole ones are used as far as they fit into ``most_bytes`` together, so the task's memory is bounded too.
    A text that does not fit takes no room from those after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                n = len((text or "").encode())
                if size + n <= most_bytes:
                    size += n
                    texts.append(text or "")
                    labels.append(label)
        model = learn(texts, labels)
        texts.clear()
        common.release()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    # an empty sample has no task, so learn from nothing on the driver then
    found = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "text", "label").mapInArrow(run, "model binary").collect()
    return found[0]["model"] if found else learn([], [])
