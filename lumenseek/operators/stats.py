"""Counts over files and store, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.functions import paths, vectors
from lumenseek.operators.store import Store


def store_counts(files: DataFrame, blobs: DataFrame, dim: int) -> DataFrame:
    """One row: files, blobs_current, blobs_cached, chunks, payload_bytes (of current blobs), entries (all of the store)."""
    listed = files.where(paths.is_textual(F.col("path")))
    current = listed.select("blob_sha").distinct()
    cached = blobs.join(current, "blob_sha", "left_semi")
    size = F.lit(12) + 8 * F.col("n_chunks").cast("bigint") + 4 * F.col("n_chunks").cast("bigint") * dim
    return (
        listed.agg(F.count("*").alias("files"))
        .crossJoin(current.agg(F.count("*").alias("blobs_current")))
        .crossJoin(cached.agg(F.count("*").alias("blobs_cached"), F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("bigint").alias("chunks"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("payload_bytes")))
        .crossJoin(blobs.agg(F.count("*").alias("entries")))
    )


def report(store: Store, files: DataFrame) -> dict:
    row = store_counts(files, store.blobs(), store.dim).first().asDict()
    return row | {"location": store.location, "model": store.model, "dim": store.dim}


def compare_runs(run: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean and least inner product of two runs' vectors (seq, embedding) of the same rows, and how many met."""
    both = run.select("seq", F.col("embedding").alias("a")).join(reference.select("seq", F.col("embedding").alias("b")), "seq")
    cosine = vectors.dot(F.col("a"), F.col("b"))
    return both.select(cosine.alias("c")).agg(F.avg("c").alias("mean"), F.min("c").alias("worst"), F.count("*").alias("n"))


def corpus(files: DataFrame) -> DataFrame:
    """seq and text of every chunk of every distinct blob, in id and chunk order; each blob is read from its first path."""
    from lumenseek.functions import chunking

    listed = files.where(paths.is_textual(F.col("path")))
    first = listed.groupBy("blob_sha").agg(F.min_by("content", "path").alias("content"))
    return chunking.with_chunks(first).select("blob_sha", "chunk_idx", "text").orderBy("blob_sha", "chunk_idx")
