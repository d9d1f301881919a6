"""Vectors that lie in a git repository as notes, one payload for each content id, taken over into a store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions import codec, hashing
from lumenseek.operators.store import BLOBS, VECTORS, VERSION, Store
from lumenseek.sources import gitobjects


def payloads(spark: SparkSession, path: str, tree: str) -> DataFrame:
    """blob_sha and payload of every entry of a notes tree; names that are no content id are left out."""
    files = gitobjects.tree_files(spark, path, tree)
    named = files.select(hashing.sha_of_entry(F.col("path")).alias("blob_sha"), F.col("blob_sha").alias("id")).where("blob_sha IS NOT NULL")
    return gitobjects.contents(named, path).select("blob_sha", F.col("content").alias("payload"))


def unpacked(rows: DataFrame, dim: int) -> DataFrame:
    """blob_sha, n_chunks, starts, ends and the embeddings, one after the other, of the payloads that are valid for ``dim``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(sha, data) for sha, data in zip(batch.column("blob_sha").to_pylist(), batch.column("payload").to_pylist()) if data is not None and codec.payload_valid(data, dim)]
            found = [codec.unpack_payload(data) for _, data in told]
            ranges = [np.array(r, np.int32).reshape(-1, 2) for _, r, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([sha for sha, _ in told], pa.string()), pa.array([len(r) for r in ranges], pa.int32()), pa.array([r[:, 0] for r in ranges], pa.list_(pa.int32())), pa.array([r[:, 1] for r in ranges], pa.list_(pa.int32())), pa.array([list(v) for _, _, v in found], pa.list_(pa.list_(pa.float32())))],
                ["blob_sha", "n_chunks", "starts", "ends", "embeddings"],
            )

    return rows.mapInArrow(run, "blob_sha string, n_chunks int, starts array<int>, ends array<int>, embeddings array<array<float>>")


def take_over(spark: SparkSession, path: str, revision: str, store: Store) -> int:
    """Commit the valid entries of a notes reference that the store lacks; returns how many."""
    return take_over_tree(spark, path, gitobjects.resolve(path, revision), store)


def take_over_tree(spark: SparkSession, path: str, tree: str, store: Store) -> int:
    """The same from the notes' tree. Damaged entries are left out and are embedded by the next index."""
    known = store.known()
    told = unpacked(payloads(spark, path, tree).join(known, "blob_sha", "left_anti"), store.dim)
    staged = f"{store.location}/staging/notes-{uuid.uuid4().hex}"
    try:
        told.write.parquet(staged)
        read = spark.read.parquet(staged)
        entries = read.select("blob_sha", F.lit(VERSION).alias("version"), F.lit(store.dim).alias("dim"), "n_chunks")
        rows = read.select("blob_sha", F.posexplode(F.arrays_zip("starts", "ends", "embeddings")).alias("chunk_idx", "c")).select("blob_sha", "chunk_idx", F.col("c.starts").alias("start_line"), F.col("c.ends").alias("end_line"), F.col("c.embeddings").alias("embedding"))
        n = entries.count()
        if n:
            store.commit(rows.select(*(c.split()[0] for c in VECTORS.split(", "))), entries.select(*(c.split()[0] for c in BLOBS.split(", "))))
        return n
    finally:
        store.files.delete(staged)
