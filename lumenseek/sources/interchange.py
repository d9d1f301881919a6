"""Vector dumps in their binary format, as tables, and the numbering of a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenseek.functions import codec


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """file, seq and embedding of every vector of the dumps at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                matrix = codec.unpack_vectors(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(matrix), pa.string()), pa.array(np.arange(len(matrix)), pa.int64()), pa.array(list(matrix), pa.list_(pa.float32()))], ["file", "seq", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, seq bigint, embedding array<float>")


def first_vectors(vectors: DataFrame, most: int = 256) -> DataFrame:
    """The rows (seq, embedding) that a dump holds: the first ``most`` in order."""
    return vectors.orderBy("seq").limit(most)


def dump_vectors(vectors: DataFrame, path: str, most: int = 256) -> int:
    """Write the first vectors to a local file; returns how many."""
    rows = first_vectors(vectors.select("seq", "embedding"), most).collect()
    Path(path).write_bytes(codec.pack_vectors([r["embedding"] for r in rows] or np.zeros((0, 0)), most))
    return len(rows)


def with_seq(corpus: DataFrame) -> DataFrame:
    """seq from 0 in (blob_sha, chunk_idx) order. Ids are hashes: rows are numbered within ranges of ids, and only the ranges' totals are summed in one place."""
    ranged = corpus.withColumn("__range", F.substring("blob_sha", 1, 3))
    totals = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("__range", before.alias("__base"))  # at most 4,096 rows
    place = F.row_number().over(Window.partitionBy("__range").orderBy("blob_sha", "chunk_idx"))
    joined = ranged.join(F.broadcast(base), "__range")
    return joined.withColumn("seq", F.col("__base") + place - 1).drop("__range", "__base")
