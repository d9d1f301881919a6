"""Shared helpers: table access, scratch tables in the shared folder, broadcast-free plumbing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.operators import shared


#: Arrow batches between Spark and Python: Spark's own limit of 64 MB is held several times over in an executor.
BATCH_BYTES = 4 << 20
#: Row groups of scratch tables; Parquet's own 128 MB stay in an executor's heap until they are full.
ROW_GROUP_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``BATCH_BYTES``, unless it is lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the cluster shares; removed when the session's JVM ends, or earlier by ``discard``."""
    base = shared.folder(spark)
    path = f"{base}/lumenseek/{tag}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def materialize(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage. Row groups are small, as a task holds one in memory.

    ``files``: as many tasks and files at most, for tables that are small beside the number of partitions; each file costs several calls of the file system.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, tag)
    written = df if files is None else df.coalesce(files)
    written.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.scratch = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes that Spark estimates for ``df``; where it knows nothing (tables made of local rows or RDDs), the bytes of ``column`` are summed up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a text column; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``limit`` bytes of ``column`` (at least one row each), so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.float64))
    group = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def filter_rows(docs: DataFrame, keep, column: str = "text", limit: int = 2_000_000) -> DataFrame:
    """The rows, with all their columns, for which ``keep`` (of an Arrow text column) is true.

    ``keep`` sees about ``limit`` bytes at a time, and columns pass through as they are. Null texts reach ``keep`` as nulls, repeated rows are judged each, and an empty
    table stays empty.
    """
    names = docs.columns
    place = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.rename_columns([f"c{i}" for i in range(len(names))])
            for part in slices(plain, f"c{place}", limit):
                yield part.filter(pa.array(keep(part.column(place)), pa.bool_())).rename_columns(names)
        release()

    return docs.mapInArrow(run, docs.schema)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers idle between stages while others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
