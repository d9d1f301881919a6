"""Continuous indexing: new files of a stream go through the same incremental index, batch by batch.

What is known lies in the store, so the stream needs neither state nor a watermark, and a batch that is run again after a
failure embeds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenseek.operators import embedders, indexer
from lumenseek.operators.store import Store
from lumenseek.sources import tables


def index_stream(files: DataFrame, store: Store, embedder: embedders.Embedder, checkpoint: str, *, group_chunks: int = indexer.GROUP_CHUNKS, trigger: dict | None = None) -> StreamingQuery:
    """Index a streaming DataFrame of files (path, blob_sha, raw_sha, content). By default it ends when all that is there has been taken."""

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            indexer.index(spark, batch, Store(spark, store.location, store.model, store.dim), embedder, group_chunks=group_chunks)
        finally:
            batch.unpersist()

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(take).start()


def table_stream(spark: SparkSession, directory: str, schema: str, path: str, content: str) -> DataFrame:
    """Files from a directory of Parquet files that grows: ``path`` and ``content`` are SQL expressions over its rows."""
    rows = spark.readStream.schema(schema).parquet(directory)
    return tables.from_table(rows, F.expr(path), F.expr(content))
