"""A git working tree as a Spark data source: the files that the index tracks, with the ids that their content has now.

Rows: path, blob_sha, raw_sha (the id was made from the bytes on disk because the file differs from the index),
is_modified (path filter first: only files that hold text by their path, unless option ``textual`` is false), and, with option ``content``, the bytes on disk. Modified files that cannot be read are dropped, as are
unreadable files if their content is asked for. The listing is sliced into partitions; executors must see the tree.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType
from lumenseek.functions.paths import textual_path

SCHEMA = "path string, blob_sha string, raw_sha boolean, is_modified boolean"
FILES_PER_PARTITION = 2_000


def _git(directory: str, *args: str) -> bytes:
    found = subprocess.run(["git", "-C", directory, *args], capture_output=True)
    if found.returncode:
        raise RuntimeError(f"git {args[0]} failed in {directory}: {found.stderr.decode('utf-8', 'replace').strip()}")
    return found.stdout


def find_root(start: str) -> str:
    """The top of the working tree that holds ``start``; fails outside one."""
    return _git(start, "rev-parse", "--show-toplevel").decode().rstrip("\n")


def list_tracked(root: str) -> list[tuple[str, str]]:
    """(path, id in the index) of every entry, in the index's order; all stages of an unmerged path. Paths must be UTF-8."""
    out = []
    for entry in _git(root, "ls-files", "-s", "-z").split(b"\0"):
        if entry:
            meta, _, path = entry.partition(b"\t")
            out.append((path.decode("utf-8"), meta.split()[1].decode()))
    return out


def modified_paths(root: str) -> set[str]:
    """Paths whose file differs from the index, deleted ones included."""
    return {p.decode("utf-8") for p in _git(root, "diff", "--name-only", "-z").split(b"\0") if p}


def blob_sha(content: bytes) -> str:
    return hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


class _Slice(InputPartition):
    def __init__(self, root: str, entries: list[tuple[str, str, bool]]) -> None:
        self.root, self.entries = root, entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.start = options.get("path", ".")
        self.content = options.get("content", "false").lower() == "true"
        self.textual = options.get("textual", "true").lower() == "true"
        self.keep_stages = options.get("unmerged", "merge") == "keep"
        self.per_partition = int(options.get("filesperpartition", FILES_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        root = find_root(self.start)
        modified = modified_paths(root)
        entries = [(path, sha, path in modified) for path, sha in list_tracked(root) if not self.textual or textual_path(path)]
        if not self.keep_stages:  # stages of an unmerged path that come to the same row
            entries = list(dict.fromkeys((p, "" if m else s, m) for p, s, m in entries))
        return [_Slice(root, entries[a : a + self.per_partition]) for a in range(0, len(entries), self.per_partition)] or [_Slice(root, [])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        for path, sha, modified in partition.entries:
            data = None
            if modified or self.content:
                try:
                    data = Path(partition.root, path).read_bytes()
                except OSError:
                    continue
            row = (path, blob_sha(data) if modified else sha, modified, modified)
            yield (*row, data) if self.content else row


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitfiles"

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self.options.get("content", "false").lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})


def read(spark: SparkSession, path: str, *, content: bool = False, **options: str) -> DataFrame:
    spark.dataSource.register(GitFiles)
    return spark.read.format("gitfiles").options(path=path, content=str(content).lower(), **options).load()


def contents(rows: DataFrame, root: str) -> DataFrame:
    """``rows`` (with a path relative to ``root``) with the files' bytes; null for what cannot be read."""

    def load(path: str) -> bytes | None:
        try:
            return Path(root, path).read_bytes()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = pa.array([load(p) for p in part.column("path").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, "content"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))
