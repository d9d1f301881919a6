"""The corpus format as a data source that tasks write and read in parallel.

A corpus is a folder of files in the format (magic, count, then length and UTF-8 bytes of each text), each written by one task, or any single such file. Beside
a file that this library writes lies an index, ``<name>.idx``: the offset of every ``STRIDE``-th text. It makes the file splittable; without one it is
read as a whole, text by text. The rows are file, seq (from 0 in each file) and text. A write is all or nothing: files get their names when all
tasks are done.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lumenseek.functions.codec import CORPUS_MAGIC
from lumenseek.operators.shared import filesystem

SCHEMA = "file string, seq bigint, text string"
STRIDE = 1000
#: Bytes of a file that one partition reads, and that are read at once.
SPLIT_BYTES, READ_BYTES = 64 << 20, 1 << 20


class _Stretch(InputPartition):
    def __init__(self, file: str, offset: int, seq: int, n: int) -> None:
        self.file, self.offset, self.seq, self.n = file, offset, seq, n


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        files, plain = filesystem(self.path)
        prefix = self.path[: len(self.path) - len(plain)]
        info = files.get_file_info(plain)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no corpus at {self.path}")
        names = [plain] if info.type == fs.FileType.File else sorted(f.path for f in files.get_file_info(fs.FileSelector(plain)) if f.base_name[0] not in "._" and not f.base_name.endswith(".idx"))
        out: list[InputPartition] = []
        for name in names:
            with files.open_input_file(name) as f:
                head = f.read_at(16, 0)
            if head[:8] != CORPUS_MAGIC:
                raise ValueError(f"{name} is not a corpus file")
            (n,) = struct.unpack_from("<Q", head, 8)
            offsets = [16]
            if files.get_file_info(f"{name}.idx").type == fs.FileType.File:
                with files.open_input_file(f"{name}.idx") as f:
                    data = f.read()
                offsets = list(struct.unpack(f"<{len(data) // 8}Q", data)) or [16]
            at = 0
            while at < len(offsets):  # whole strides, as many as fit into a split
                to = at + 1
                while to < len(offsets) and offsets[to] - offsets[at] < self.split:
                    to += 1
                first, last = at * STRIDE, n if to == len(offsets) else to * STRIDE
                out.append(_Stretch(prefix + name, offsets[at], first, last - first))
                at = to
        return out or [_Stretch("", 0, 0, 0)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        if not partition.n:
            return
        files, plain = filesystem(partition.file)
        with files.open_input_file(plain) as f:
            f.seek(partition.offset)
            data, at = b"", 0
            for i in range(partition.n):
                while len(data) - at < 4 or len(data) - at - 4 < struct.unpack_from("<I", data, at)[0]:
                    more = f.read(READ_BYTES)
                    if not more:
                        raise ValueError(f"{partition.file} is cut short in text {partition.seq + i}")
                    data, at = data[at:] + more, 0
                (size,) = struct.unpack_from("<I", data, at)
                yield partition.file, partition.seq + i, data[at + 4 : at + 4 + size].decode("utf-8")
                at += 4 + size


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    name: str


class _Writer(DataSourceArrowWriter):
    """Each task writes a file under a hidden name; the driver gives all of them their names, or deletes them."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        files, plain = filesystem(self.path)
        there = files.get_file_info(plain).type != fs.FileType.NotFound and bool(files.get_file_info(fs.FileSelector(plain)))
        if there and not overwrite:
            raise ValueError(f"{self.path} exists already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, plain = filesystem(self.path)
        files.create_dir(plain, recursive=True)
        temporary = f"{plain}/.{self.job}-{uuid.uuid4().hex}"
        n, at, offsets = 0, 16, []
        # the count stands before the texts, so they go to a file of their own first
        with files.open_output_stream(temporary + ".texts") as f:
            for batch in iterator:
                for text in batch.column("text").to_pylist():
                    if text is None:
                        continue
                    data = text.encode()
                    if n % STRIDE == 0:
                        offsets.append(at)
                    f.write(struct.pack("<I", len(data)) + data)
                    n, at = n + 1, at + 4 + len(data)
        with files.open_output_stream(temporary) as f, files.open_input_stream(temporary + ".texts") as texts:
            f.write(CORPUS_MAGIC + struct.pack("<Q", n))
            while data := texts.read(READ_BYTES):
                f.write(data)
        files.delete_file(temporary + ".texts")
        with files.open_output_stream(temporary + ".idx") as f:
            f.write(struct.pack(f"<{len(offsets)}Q", *offsets))
        return _Written(temporary, f"part-{task.partitionId():06d}.corpus")

    def _hidden(self, files: fs.FileSystem, plain: str) -> list[str]:
        return [f.path for f in files.get_file_info(fs.FileSelector(plain, allow_not_found=True)) if f.base_name.startswith(f".{self.job}-")]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, plain = filesystem(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(plain, allow_not_found=True)):
                if f.base_name.removesuffix(".idx").endswith(".corpus"):
                    files.delete_file(f.path)
        for message in messages:
            if message is not None:
                files.move(message.temporary + ".idx", f"{plain}/{message.name}.idx")
                files.move(message.temporary, f"{plain}/{message.name}")
        for name in self._hidden(files, plain):  # of attempts that another one replaced
            files.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:  # noqa: ARG002
        files, plain = filesystem(self.path)
        for name in self._hidden(files, plain):
            files.delete_file(name)


class Corpus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader({k.lower(): v for k, v in dict(self.options).items()})

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if "text" not in schema.names:
            raise ValueError("a corpus is written from a column called text")
        return _Writer({k.lower(): v for k, v in dict(self.options).items()}, overwrite)


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """file, seq and text of every text of the corpus at ``path``; files in another format and files cut short end the query."""
    spark.dataSource.register(Corpus)
    return spark.read.format("corpus").options(path=path, **options).load()


def write(corpus: DataFrame, path: str, *, mode: str = "append") -> None:
    """Write the texts (columns seq and text) in the order of seq: files in the order of their names hold ranges of it. Null texts are left out. A folder that holds
    a corpus is only replaced by ``mode`` overwrite.
    """
    corpus.sparkSession.dataSource.register(Corpus)
    corpus.select("seq", "text").repartitionByRange("seq").sortWithinPartitions("seq").select("text").write.format("corpus").mode(mode).option("path", path).save()
