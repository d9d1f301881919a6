"""Git's object store as tables: contents of any revision by object id, files of a commit without a work tree, and the index.

- ``located`` is a data source over the indexes of all packs and the loose objects: a row per object with where it lies. Slices of a pack's index, by its
  fan-out, are partitions; the driver lists files only.
- ``contents`` joins wanted ids with that, deals them by pack and offset, so that a task reads one stretch of a pack, and resolves deltas there.
- ``tree_files`` walks trees level by level: the distinct trees of a level are read at once and joined with the paths that lead to them.
- ``index_files`` reads the binary index, in blocks where it tells their offsets.

Folders may lie in any file system that pyarrow opens by its address; executors must see them.
"""

from __future__ import annotations

import bisect
import posixpath
import struct
import subprocess
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from lumenseek.functions import gitformat, hashing
from lumenseek.operators import shared
from lumenseek.operators.shared import filesystem

#: Objects of a partition of ``located``, and compressed bytes read at once.
IDS_PER_PARTITION = 100_000
READ_BYTES = 1 << 16
#: So few ids are looked up one by one; more are joined with the list of all objects.
FEW_IDS = 50_000
#: Bytes of resolved bases that a task keeps, and rows that it hands on together.
KEPT_BYTES = 32 << 20
ROWS, ROW_BYTES = 256, 4 << 20

LOCATED = "id string, pack string, offset bigint"
INDEX = "path string, mode int, stage int, blob_sha string, size bigint"


def _names(files: fs.FileSystem, directory: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(directory, allow_not_found=True))
    return sorted(f.base_name for f in found)


def _text(files: fs.FileSystem, path: str) -> str:
    if files.get_file_info(path).type != fs.FileType.File:
        return ""
    with files.open_input_file(path) as f:
        return f.read().decode()


def own_directory(path: str) -> str:
    """The folder of a repository's own files, among them the index: itself if it is bare, its .git otherwise, followed where that is a file."""
    files, plain = filesystem(path)
    told = _text(files, f"{plain}/.git")
    found = posixpath.normpath(posixpath.join(plain, told.split(":", 1)[1].strip())) if told.startswith("gitdir:") else f"{plain}/.git"
    if files.get_file_info(found).type != fs.FileType.Directory:
        found = plain
    return path[: len(path) - len(plain)] + found


def git_directory(path: str) -> str:
    """The folder with the objects: the own one, or the one that it names as common."""
    own = own_directory(path)
    files, plain = filesystem(own)
    common = _text(files, f"{plain}/commondir").strip()
    found = posixpath.normpath(posixpath.join(plain, common)) if common else plain
    if files.get_file_info(f"{found}/objects").type != fs.FileType.Directory:
        raise ValueError(f"no git repository at {path}")
    return own[: len(own) - len(plain)] + found


def object_folders(directory: str) -> list[str]:
    """The repository's object folder and those of its alternates."""
    files, plain = filesystem(directory)
    prefix = directory[: len(directory) - len(plain)]
    out, waiting = [], [f"{plain}/objects"]
    while waiting:
        at = waiting.pop()
        if at not in out:
            out.append(at)
            waiting += [posixpath.normpath(posixpath.join(at, line)) for line in _text(files, f"{at}/info/alternates").splitlines() if line and not line.startswith("#")]
    return [prefix + at for at in out]


def id_width(directory: str) -> int:
    """Bytes of an object id: 32 if the repository's settings name SHA-256."""
    files, plain = filesystem(directory)
    lines = [line.strip().lower().replace(" ", "") for line in _text(files, f"{plain}/config").splitlines()]
    return 32 if "objectformat=sha256" in lines else 20


class PackIndex:
    """An open pack index of version 2: ids in order behind a fan-out table, then checksums, then offsets."""

    def __init__(self, files: fs.FileSystem, path: str, width: int) -> None:
        self.file, self.width = files.open_input_file(path), width
        head = self.file.read_at(8 + 1024, 0)
        if head[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError(f"{path}: not a pack index of version 2")
        self.fanout = [0, *struct.unpack(">256I", head[8:])]
        self.n = self.fanout[-1]

    def rows(self, first: int, last: int) -> tuple[list[str], list[int]]:
        """Ids and offsets of the objects numbered first to last - 1."""
        n, width = last - first, self.width
        names = self.file.read_at(n * width, 1032 + first * width)
        at = 1032 + self.n * (width + 4)
        offsets = list(struct.unpack(f">{n}I", self.file.read_at(4 * n, at + 4 * first)))
        for i, offset in enumerate(offsets):
            if offset >> 31:  # in the table of large offsets
                offsets[i] = struct.unpack(">Q", self.file.read_at(8, at + 4 * self.n + 8 * (offset & 0x7FFFFFFF)))[0]
        return [names[width * i : width * (i + 1)].hex() for i in range(n)], offsets

    def offset(self, sha: bytes) -> int | None:
        """Where an object lies, by bisection of its fan-out slot."""
        place = range(self.fanout[sha[0]], self.fanout[sha[0] + 1])
        i = bisect.bisect_left(place, sha, key=lambda k: self.file.read_at(self.width, 1032 + k * self.width))
        if i == len(place):
            return None
        (found,), (offset,) = self.rows(place[i], place[i] + 1)
        return offset if found == sha.hex() else None


class Pack:
    """An open pack; objects are read by offset, and deltas are resolved through bases, the latest of which are kept."""

    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width
        self.files, self.plain = filesystem(path)
        self.file = self.files.open_input_file(self.plain)
        self.index: PackIndex | None = None
        self.bases: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.held = 0

    def _entry(self, offset: int) -> tuple[int, int | None, bytes]:
        """Type number, offset of the base, and the inflated bytes of one entry."""
        data = self.file.read_at(READ_BYTES, offset)
        kind, size, at = gitformat.entry_head(data)
        base = None
        if kind == gitformat.OFFSET_DELTA:
            back, at = gitformat.back_offset(data, at)
            base = offset - back
        elif kind == gitformat.REF_DELTA:
            if self.index is None:
                self.index = PackIndex(self.files, self.plain.removesuffix(".pack") + ".idx", self.width)
            base = self.index.offset(data[at : at + self.width])
            if base is None:
                raise ValueError(f"{self.path}: the base of the object at {offset} is not in the pack")
            at += self.width
        stream = zlib.decompressobj()
        parts = [stream.decompress(data[at:])]
        reached = offset + len(data)
        while not stream.eof:
            more = self.file.read_at(READ_BYTES, reached)
            if not more:
                raise ValueError(f"{self.path} is cut short in the object at {offset}")
            parts.append(stream.decompress(more))
            reached += len(more)
        out = b"".join(parts)
        if len(out) != size:
            raise ValueError(f"{self.path}: {len(out)} bytes at {offset}, its head tells {size}")
        return kind, base, out

    def object(self, offset: int) -> tuple[str, bytes]:
        """Kind and content of the object at an offset."""
        chain = []
        while offset not in self.bases:
            kind, base, data = self._entry(offset)
            chain.append((offset, data))
            if base is None:
                self._keep(offset, gitformat.KINDS[kind], data)
                chain.pop()
                break
            offset = base
        self.bases.move_to_end(offset)
        kind, content = self.bases[offset]
        for at, delta in reversed(chain):
            content = gitformat.apply_delta(content, delta)
            self._keep(at, kind, content)
        return kind, content

    def _keep(self, offset: int, kind: str, content: bytes) -> None:
        self.bases[offset] = kind, content
        self.held += len(content)
        while self.held > KEPT_BYTES and len(self.bases) > 1:
            self.held -= len(self.bases.popitem(last=False)[1][1])


class _Slice(InputPartition):
    def __init__(self, folder: str, pack: str | None, first: int, last: int, width: int) -> None:
        self.folder, self.pack, self.first, self.last, self.width = folder, pack, first, last, width


class _Located(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.directory = git_directory(options["path"])
        self.per_partition = int(options.get("idsperpartition", IDS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        width, out = id_width(self.directory), []
        for folder in object_folders(self.directory):
            files, plain = filesystem(folder)
            for name in _names(files, f"{plain}/pack"):
                if name.endswith(".idx"):
                    n = PackIndex(files, f"{plain}/pack/{name}", width).n
                    out += [_Slice(folder, f"{folder}/pack/{name.removesuffix('.idx')}.pack", a, min(n, a + self.per_partition), width) for a in range(0, n, self.per_partition)]
            out += [_Slice(folder, None, int(name, 16), 0, width) for name in _names(files, plain) if len(name) == 2]
        return out or [_Slice(f"{self.directory}/objects", None, 0, 0, width)]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        files, plain = filesystem(partition.folder)
        if partition.pack is None:
            first = f"{partition.first:02x}"
            for name in _names(files, f"{plain}/{first}"):
                if len(name) == 2 * partition.width - 2:
                    yield first + name, f"{partition.folder}/{first}/{name}", None
            return
        index = PackIndex(files, filesystem(partition.pack)[1].removesuffix(".pack") + ".idx", partition.width)
        for sha, offset in zip(*index.rows(partition.first, partition.last)):
            yield sha, partition.pack, offset


class GitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitobjects"

    def schema(self) -> str:
        return LOCATED

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Located({k.lower(): v for k, v in dict(self.options).items()})


def located(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """id, pack and offset of every object; a loose object's file stands for the pack and it has no offset. Objects in several packs have several rows."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("gitobjects").options(path=path, **options).load()


def _places(asked: DataFrame, path: str) -> DataFrame:
    """id, __pack and __offset of those of the distinct ids that the repository has, a packed place before a loose one, by a join with all that it has."""
    found = located(asked.sparkSession, path).join(asked, "id", "left_semi").groupBy("id").agg(F.min(F.struct(F.col("offset").isNull().alias("loose"), "pack", "offset")).alias("at"))
    return found.select("id", F.col("at.pack").alias("__pack"), F.col("at.offset").alias("__offset"))


def _looked_up(asked: DataFrame, path: str) -> DataFrame:
    """The same for few ids, each by bisection of the packs' indexes."""
    directory = git_directory(path)
    width, folders = id_width(directory), object_folders(directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = []
        for folder in folders:
            files, plain = filesystem(folder)
            indexes += [(f"{folder}/pack/{name.removesuffix('.idx')}.pack", PackIndex(files, f"{plain}/pack/{name}", width)) for name in _names(files, f"{plain}/pack") if name.endswith(".idx")]
        indexes.sort(key=lambda x: x[0])
        for batch in batches:
            rows = []
            for sha in batch.column("id").to_pylist():
                if len(sha) != 2 * width or set(sha) - set("0123456789abcdef"):
                    continue
                at = next(((sha, pack, offset) for pack, index in indexes if (offset := index.offset(bytes.fromhex(sha))) is not None), None)
                for folder in () if at else folders:
                    files, plain = filesystem(f"{folder}/{sha[:2]}/{sha[2:]}")
                    if files.get_file_info(plain).type == fs.FileType.File:
                        at = sha, f"{folder}/{sha[:2]}/{sha[2:]}", None
                        break
                rows += [at] if at else []
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], (pa.string(), pa.string(), pa.int64()))], ["id", "__pack", "__offset"])

    return asked.mapInArrow(run, "id string, __pack string, __offset bigint")


def contents(wanted: DataFrame, path: str, *, check: bool = True) -> DataFrame:
    """The rows of ``wanted`` (column id and any others; ids may repeat or be null) with kind and content of the object; null where the repository lacks it.

    Rows are dealt by where their object lies and read in that order, so contents are never shuffled. ``check``: an object whose bytes have another id than
    its key ends the query.
    """
    width = id_width(git_directory(path))
    asked = wanted.select("id").where("id IS NOT NULL").distinct()
    places = _looked_up(asked, path) if asked.limit(FEW_IDS + 1).count() <= FEW_IDS else _places(asked, path)
    # rows of one object may be many: they are dealt on by their number
    names = wanted.columns
    placed = wanted.join(places, "id", "left").select(*names, "__pack", "__offset", F.monotonically_increasing_id().alias("__row"))
    ordered = placed.repartitionByRange("__pack", "__offset", "__row").sortWithinPartitions("__pack", "__offset").drop("__row")
    kinds = StructType([*wanted.schema.fields, StructField("kind", StringType()), StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack: Pack | None = None
        last, kind, content = None, None, None
        for batch in batches:
            columns = batch.rename_columns([*(f"c{i}" for i in range(len(names))), "pack", "offset"])
            at, size, found = 0, 0, []
            for i, (sha, name, offset) in enumerate(zip(*(columns.column(c).to_pylist() for c in (f"c{names.index('id')}", "pack", "offset")))):
                if name is None:
                    last, kind, content = None, None, None
                elif (name, offset) != last:
                    if offset is None:
                        files, plain = filesystem(name)
                        with files.open_input_file(plain) as f:
                            kind, content = gitformat.loose(f.read())
                    else:
                        if pack is None or pack.path != name:
                            pack = Pack(name, width)
                        kind, content = pack.object(offset)
                    if check and gitformat.object_id(kind, content, width) != sha:
                        raise ValueError(f"object {sha} has other bytes")
                    last = name, offset
                found.append((kind, content))
                size += len(content or b"")
                if len(found) >= ROWS or size >= ROW_BYTES or i + 1 == batch.num_rows:
                    part = columns.slice(at, len(found)).columns[: len(names)]
                    yield pa.RecordBatch.from_arrays([*part, pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], [*names, "kind", "content"])
                    at, size, found = i + 1, 0, []

    return ordered.mapInArrow(run, kinds)


def resolve(path: str, revision: str) -> str:
    """The id of the tree that a revision names."""
    found = subprocess.run(["git", "-C", path, "rev-parse", "--verify", "--quiet", f"{revision}^{{tree}}"], capture_output=True, text=True)
    if found.returncode:
        raise ValueError(f"no revision {revision} in {path}")
    return found.stdout.strip()


def tree_files(spark: SparkSession, path: str, tree: str) -> DataFrame:
    """path, mode and blob_sha of every file below a tree (its id; ``resolve`` tells a revision's), submodules included.

    One step for each level of folders: all distinct trees of the level are read at once. The steps' tables lie in the shared folder. A tree that the repository lacks ends the walk with an error.
    """
    width = id_width(git_directory(path))
    folder = shared.scratch(spark, "trees")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, kind, content in zip(*(batch.column(c).to_pylist() for c in ("id", "kind", "content"))):
                if kind != "tree":
                    raise ValueError(f"{sha} is {'missing' if kind is None else f'a {kind}'}, not a tree")
                modes, names, shas = zip(*gitformat.tree_entries(content, width)) if content else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([sha] * len(names), pa.string()), pa.array(modes, pa.int32()), pa.array(names, pa.string()), pa.array(shas, pa.string())], ["tree", "mode", "name", "sha"])

    frontier = spark.createDataFrame([("", tree)], "prefix string, tree string")
    found = None
    level = 0
    while frontier.limit(1).count():
        trees = frontier.select(F.col("tree").alias("id")).distinct()
        read = contents(trees, path).mapInArrow(entries, "tree string, mode int, name string, sha string")
        at = f"{folder}/{level}"
        frontier.join(read, "tree").select(F.concat("prefix", "name").alias("path"), "mode", F.col("sha").alias("blob_sha")).write.parquet(at)
        step = spark.read.parquet(at)
        files = step.where(F.col("mode") != gitformat.DIRECTORY)
        found = files if found is None else found.union(files)
        frontier = step.where(F.col("mode") == gitformat.DIRECTORY).select(F.concat("path", F.lit("/")).alias("prefix"), F.col("blob_sha").alias("tree"))
        level += 1
    return found


def revision_files(spark: SparkSession, path: str, revision: str = "HEAD") -> DataFrame:
    """The files of a revision as the index takes them: path, blob_sha, raw_sha and content (null where it is no blob of this repository)."""
    files = tree_files(spark, path, resolve(path, revision)).where(F.col("mode") != gitformat.GITLINK)
    return contents(files.withColumnRenamed("blob_sha", "id"), path).select("path", F.col("id").alias("blob_sha"), F.lit(False).alias("raw_sha"), "content")


class _Block(InputPartition):
    def __init__(self, path: str, version: int, start: int, end: int, n: int, width: int) -> None:
        self.path, self.version, self.start, self.end, self.n, self.width = path, version, start, end, n, width


class _Index(DataSourceReader):
    """The blocks that the index's own table of offsets tells, or all entries as one block."""

    def __init__(self, options: dict[str, str]) -> None:
        self.directory = options["path"]

    def partitions(self) -> list[InputPartition]:
        width = id_width(git_directory(self.directory))
        own = own_directory(self.directory)
        files, plain = filesystem(f"{own}/index")
        path = f"{own}/index"
        if files.get_file_info(plain).type != fs.FileType.File:
            return [_Block(path, 2, 0, 0, 0, width)]
        with files.open_input_file(plain) as f:
            size = f.size()
            magic, version, n = struct.unpack(">4sII", f.read_at(12, 0))
            if magic != b"DIRC" or version not in (2, 3, 4):
                raise ValueError(f"{path}: not an index of version 2 to 4")
            end, blocks = size - width, []
            tail = f.read_at(12 + width, size - 2 * width - 12)
            if tail[:4] == b"EOIE":
                end = struct.unpack(">I", tail[8:12])[0]
                at = end
                while at < size - width:
                    name, length = struct.unpack(">4sI", f.read_at(8, at))
                    if name == b"link":
                        raise ValueError(f"{path}: entries of a shared index are not read")
                    if name == b"IEOT":
                        numbers = struct.unpack(f">{length // 4}I", f.read_at(length // 4 * 4, at + 8))[1:]
                        blocks = list(zip(numbers[::2], numbers[1::2]))
                    at += 8 + length
        blocks = blocks or [(12, n)]
        ends = [*(start for start, _ in blocks[1:]), end]
        return [_Block(path, version, start, stop, count, width) for (start, count), stop in zip(blocks, ends)]

    def read(self, partition: _Block) -> Iterator[tuple]:
        if not partition.n:
            return
        files, plain = filesystem(partition.path)
        with files.open_input_file(plain) as f:
            data = f.read_at(partition.end - partition.start, partition.start)
        yield from gitformat.index_entries(data, partition.version, partition.n, partition.width)


class GitIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitindex"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Index({k.lower(): v for k, v in dict(self.options).items()})


def index_files(spark: SparkSession, path: str) -> DataFrame:
    """path, mode, stage, blob_sha and size of the entries of a work tree's index, read by tasks."""
    spark.dataSource.register(GitIndex)
    return spark.read.format("gitindex").options(path=path).load()


def pack_file(objects: list[tuple[int, bytes]], width: int = 20) -> tuple[str, bytes, bytes]:
    """Name, pack and index of whole objects (type number, content); objects that repeat are written once."""
    distinct = {gitformat.object_id(gitformat.KINDS[kind], content, width): (kind, content) for kind, content in objects}
    body, rows = [b"PACK" + struct.pack(">II", 2, len(distinct))], []
    at = 12
    for sha in sorted(distinct):
        data = gitformat.entry(*distinct[sha])
        rows.append((bytes.fromhex(sha), zlib.crc32(data), at))
        body.append(data)
        at += len(data)
    if at >> 31:
        raise ValueError("packs of 2 GB and more are not written")
    whole = b"".join(body)
    digest = gitformat.hasher(width)(whole).digest()
    counts = [0] * 256
    for sha, _, _ in rows:
        counts[sha[0]] += 1
    fanout = [sum(counts[: i + 1]) for i in range(256)]
    index = b"\xfftOc" + struct.pack(">I256I", 2, *fanout) + b"".join(r[0] for r in rows) + b"".join(struct.pack(">I", r[1]) for r in rows) + b"".join(struct.pack(">I", r[2]) for r in rows) + digest
    index += gitformat.hasher(width)(index).digest()
    return f"pack-{gitformat.hasher(width)(b''.join(r[0] for r in rows)).hexdigest()}", whole + digest, index


def trees(files: DataFrame) -> tuple[DataFrame, str]:
    """The tree objects (kind, id, content) of files (path, mode, blob_sha; no path may be another's folder), and the root's id.

    One aggregation for each level of folders, the deepest first. A folder is one object, so its entries meet in one task: keep folders small where files are many.
    """
    spark = files.sparkSession
    folder = shared.scratch(spark, "made-trees")
    parts = F.split("path", "/")
    rows = files.select(F.slice(parts, F.lit(1), F.size(parts) - 1).alias("folder"), F.col("mode").cast("int").alias("mode"), F.element_at(parts, -1).alias("name"), F.col("blob_sha").alias("sha"))
    depth = rows.agg(F.max(F.size("folder"))).first()[0] or 0

    @F.pandas_udf("binary")
    def encoded(column):
        return column.map(lambda entries: gitformat.tree([(e["mode"], e["name"], e["sha"]) for e in entries]))

    made = None
    for level in range(depth, -1, -1):
        here = rows.where(F.size("folder") == level).groupBy("folder").agg(F.collect_list(F.struct("mode", "name", "sha")).alias("entries"))
        content = here.select("folder", F.lit("tree").alias("kind"), encoded("entries").alias("content"))
        content.withColumn("id", hashing.git_object_sha(F.col("content"), "tree")).write.parquet(f"{folder}/{level}")
        step = spark.read.schema("folder array<string>, kind string, content binary, id string").parquet(f"{folder}/{level}")
        made = step if made is None else made.union(step)
        up = step.where(F.size("folder") > 0).select(F.slice("folder", F.lit(1), F.size("folder") - 1).alias("folder"), F.lit(gitformat.DIRECTORY).alias("mode"), F.element_at("folder", -1).alias("name"), F.col("id").alias("sha"))
        rows = rows.where(F.size("folder") < level).union(up)
    root = made.where(F.size("folder") == 0).select("id").first()
    return made.select("kind", "id", "content"), root["id"] if root else gitformat.object_id("tree", b"")


#: Bytes and objects of a pack that a task writes.
PACK_BYTES, PACK_OBJECTS = 16 << 20, 50_000


def write_packs(objects: DataFrame, directory: str) -> int:
    """Write objects (kind, content) as packs of the repository at ``directory``, each task its own; returns how many distinct ones each pack holds, summed up.

    A pack is named by what it holds, so a task that runs again writes the same file. Its index appears last and makes it visible.
    """
    target = git_directory(directory)
    width = id_width(target)
    numbers = {name: number for number, name in gitformat.KINDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, plain = filesystem(f"{target}/objects/pack")
        files.create_dir(plain, recursive=True)
        held, size = [], 0

        def put() -> pa.RecordBatch:
            name, pack, index = pack_file(held, width)
            for suffix, data in ((".pack", pack), (".idx", index)):
                whole = f"{plain}/{name}{suffix}"
                if files.get_file_info(whole).type == fs.FileType.NotFound:
                    temporary = f"{plain}/tmp_{uuid.uuid4().hex}{suffix}"
                    with files.open_output_stream(temporary) as f:
                        f.write(data)
                    files.move(temporary, whole)
            return pa.RecordBatch.from_arrays([pa.array([len({c for _, c in held})], pa.int64())], ["n"])

        for batch in batches:
            for kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((numbers[kind], content))
                size += len(content)
                if size >= PACK_BYTES or len(held) >= PACK_OBJECTS:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    told = objects.where("content IS NOT NULL").select("kind", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n bigint")
    return told.agg(F.sum("n")).first()[0] or 0


def new_repository(directory: str) -> str:
    """An empty bare repository in a folder of any file system."""
    files, plain = filesystem(directory)
    for name in ("objects/pack", "objects/info", "refs/heads"):
        files.create_dir(f"{plain}/{name}", recursive=True)
    for name, text in (("HEAD", "ref: refs/heads/main\n"), ("config", "[core]\n\trepositoryformatversion = 0\n\tbare = true\n")):
        with files.open_output_stream(f"{plain}/{name}") as f:
            f.write(text.encode())
    return directory
