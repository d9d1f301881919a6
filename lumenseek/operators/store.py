"""The vector store: append-only snapshots in Parquet, one partition per model, published by manifests.

Layout below the location, which may lie in any file system that Spark writes to:

    vectors/model=M/snap=S/   blob_sha, chunk_idx, start_line, end_line, embedding
    blobs/model=M/snap=S/     blob_sha, version, dim, n_chunks (0: known, but nothing to embed)
    tombstones/model=M/snap=S/  blob_sha
    damaged/model=M/snap=S/   blob_sha of the entries that do not fit their vectors
    checks/M/S.json           the snapshot's files with their lengths when it was checked, and how many entries are damaged
    manifests/M/<number>.json  what changed: the snapshots that came to those of the manifest before
    lineage/M/<id>.json       the manifests before one that came from another store

A commit writes a fresh snapshot, checks it, and then writes the next manifest, which must not exist yet. Whoever
finds its number taken reads the newer manifest and tries the next number, so no writer's snapshot is lost. A crash before the manifest
leaves files that nothing refers to. Readers see the state of the last manifest only. Of a blob in several
snapshots the newest counts; a tombstone ends what older snapshots hold.

Manifests are a log: each tells what it adds, and every ``FULL_EVERY``-th tells all live snapshots, and the ids of the manifests since the full one before it.
So a commit writes a few hundred bytes however long the history is, and a reader reads ``FULL_EVERY`` small files at most.

Whether entries fit their vectors is examined once, when a snapshot is written, and again only if the snapshot's files are not the ones
that were examined. A search reads the vectors once.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions import codec, hashing
from lumenseek.operators import shared
from lumenseek.operators.joins import broadcast_if_small

VERSION = 1
VECTORS = "blob_sha string, chunk_idx int, start_line int, end_line int, embedding array<float>"
BLOBS = "blob_sha string, version int, dim int, n_chunks int"
TOMBSTONES = "blob_sha string"
KINDS = {"vectors": VECTORS, "blobs": BLOBS, "tombstones": TOMBSTONES}
#: Manifests between two that tell the whole state.
FULL_EVERY = 100


class Diverged(RuntimeError):
    """The other side's head is not among this side's manifests."""


class Files:
    """The few file operations that manifests need, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, location: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.location = location.rstrip("/")
        self.fs = self.path(self.location).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, directory: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(directory))) if self.exists(directory) else []

    def lengths(self, directory: str) -> dict[str, int]:
        """Length of each data file in a directory."""
        if not self.exists(directory):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self.path(directory)) if s.getPath().getName()[0] not in "._"}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        if self.exists(name):
            return False
        whole, temporary = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            # renaming without overwriting: on shared stores one of two racing writers fails here, on a local disk the lock orders them
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(temporary, whole, options)
        except Exception as e:  # noqa: BLE001
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        if self.exists(name):
            self.fs.delete(self.path(name), True)

    @contextlib.contextmanager
    def lock(self, name: str) -> Iterator[None]:
        """Held for a manifest's publication on a local disk; other stores rename atomically."""
        place = urlparse(self.location)
        if place.scheme not in ("", "file"):
            yield
            return
        self.fs.mkdirs(self.path(f"{self.location}/locks"))
        with open(f"{place.path or self.location}/locks/{name}.lock", "w") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            yield


@dataclass
class Manifest:
    """The state that a manifest stands for."""

    number: int = 0
    id: str = ""
    snaps: list[dict] = field(default_factory=list)  # {"id", "kinds"} in order
    created: float = 0.0
    full: int = 0  # number of the last manifest, up to this one, that tells the whole state
    since: list[str] = field(default_factory=list)  # ids of that manifest and those after it, oldest first


class Store:
    """One model's vectors at a location."""

    def __init__(self, spark: SparkSession, location: str, model: str, dim: int) -> None:
        self.spark, self.model, self.dim = spark, model, dim
        self.files = Files(spark, location)
        self.location = self.files.location

    # -- manifests --------------------------------------------------------------------------------

    def _manifests(self) -> str:
        return f"{self.location}/manifests/{self.model}"

    def _manifest(self, number: int) -> str:
        return f"{self._manifests()}/{number:010d}.json"

    def head(self) -> Manifest:
        """The state of the last manifest; an empty one if the model has none."""
        names = [n for n in self.files.names(self._manifests()) if n.endswith(".json")]
        if not names:
            return Manifest()
        told, numbers = [], [int(n.split(".")[0]) for n in names]
        while not told or "snaps" not in told[-1]:
            told.append(json.loads(self.files.read(self._manifest(numbers.pop()))))
        told.reverse()
        snaps = [*told[0]["snaps"], *(s for t in told[1:] for s in t["add"])]
        return Manifest(told[-1]["number"], told[-1]["id"], snaps, told[-1]["created"], told[0]["number"], [t["id"] for t in told])

    def ancestors(self, head: Manifest) -> set[str]:
        """Ids of all manifests before a head, read from one in ``FULL_EVERY``."""
        out, at = set(head.since) - {head.id}, head.full
        while at:
            told = json.loads(self.files.read(self._manifest(at)))
            out |= set(told["since"])
            if told.get("lineage"):
                out |= set(json.loads(self.files.read(f"{self.location}/lineage/{self.model}/{told['lineage']}.json")))
            at = told["previous"]
        return out

    def _write(self, number: int, id_: str, head: Manifest, snaps: list[dict], *, lineage: str | None = None) -> bool:
        """Write a manifest that follows ``head``, as a change to it if it only adds snapshots and few have done so; False if the number is taken."""
        data: dict = {"number": number, "id": id_, "created": time.time()}
        added = len(head.snaps)
        if lineage is None and head.id and snaps[:added] == head.snaps and len(head.since) < FULL_EVERY:
            data["add"] = snaps[added:]
        else:
            data |= {"snaps": snaps, "since": head.since, "previous": head.full, "lineage": lineage}
        return self.files.create(self._manifest(number), json.dumps(data))

    def _publish(self, change) -> Manifest:
        """Publish what ``change`` makes of the head's snapshots; it is asked again if another writer was faster, and may return None to give up."""
        while True:
            with self.files.lock(self.model):
                head = self.head()
                snaps = change(head)
                if snaps is None:
                    return head
                if self._write(head.number + 1, uuid.uuid4().hex, head, snaps):
                    return self.head()

    def _data(self, kind: str, snap: str) -> str:
        return f"{self.location}/{kind}/model={self.model}/snap={snap}"

    # -- reading ----------------------------------------------------------------------------------

    def _rows(self, kind: str, head: Manifest) -> DataFrame:
        """All rows of a kind in the live snapshots, with the snapshot's place as ``seq``. Other models' files are never listed."""
        order = [(s["id"], i) for i, s in enumerate(head.snaps) if kind in s["kinds"]]
        if not order:
            return self.spark.createDataFrame([], f"{KINDS[kind]}, seq int")
        rows = self.spark.read.schema(f"{KINDS[kind]}, model string, snap string").option("basePath", f"{self.location}/{kind}").parquet(*(self._data(kind, s) for s, _ in order))
        places = self.spark.createDataFrame(order, "snap string, seq int")  # as few as the snapshots
        return rows.join(F.broadcast(places), "snap").drop("snap", "model")

    def blobs(self, head: Manifest | None = None) -> DataFrame:
        """The newest live entry of each blob, whatever its state: blob_sha, version, dim, n_chunks, seq."""
        head = head or self.head()
        newest = self._rows("blobs", head).groupBy("blob_sha").agg(F.max(F.struct("seq", "version", "dim", "n_chunks")).alias("e"))
        ended = self._rows("tombstones", head).groupBy("blob_sha").agg(F.max("seq").alias("ended"))
        live = newest.join(ended, "blob_sha", "left").where("ended IS NULL OR e.seq >= ended")
        return live.select("blob_sha", "e.version", "e.dim", "e.n_chunks", "e.seq")

    def known(self) -> DataFrame:
        """Ids that need no embedding, damaged entries included; they are found when they are loaded."""
        return self.blobs().where(hashing.is_blob_sha(F.col("blob_sha"))).select("blob_sha")

    def _damaged(self, head: Manifest) -> DataFrame | None:
        """blob_sha and seq of the damaged entries of the live snapshots; None if there are none. Snapshots whose files are not those that were examined are examined now."""
        found = None
        for seq, snap in enumerate(head.snaps):
            if "blobs" in snap["kinds"] and self._checked(snap):
                rows = self.spark.read.schema("blob_sha string").parquet(self._data("damaged", snap["id"])).select("blob_sha", F.lit(seq).alias("seq"))
                found = rows if found is None else found.union(rows)
        return found

    def _files(self, snap: dict) -> dict:
        return {kind: self.files.lengths(self._data(kind, snap["id"])) for kind in sorted(snap["kinds"])}

    def _checked(self, snap: dict) -> int:
        """How many entries of a snapshot are damaged, from its check; it is made if there is none for the files as they are and this dim."""
        at = f"{self.location}/checks/{self.model}/{snap['id']}.json"
        files = self._files(snap)
        if self.files.exists(at):
            told = json.loads(self.files.read(at))
            if told["files"] == files and told["dim"] == self.dim:
                return told["damaged"]
        return self._examine(snap, files, at)

    def _examine(self, snap: dict, files: dict, at: str) -> int:
        """Write down which entries of a snapshot do not fit: their version, dim, the count or numbers of their rows, or a vector's length."""
        read = {kind: self.spark.read.schema(KINDS[kind]).parquet(self._data(kind, snap["id"])) if kind in snap["kinds"] else self.spark.createDataFrame([], KINDS[kind]) for kind in ("blobs", "vectors")}
        self._misfits(read["blobs"], read["vectors"]).write.mode("overwrite").parquet(self._data("damaged", snap["id"]))
        damaged = self.spark.read.schema("blob_sha string").parquet(self._data("damaged", snap["id"])).count()
        self.files.replace(at, json.dumps({"files": files, "dim": self.dim, "damaged": damaged}))
        return damaged

    def _misfits(self, blobs: DataFrame, rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("blob_sha").agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != self.dim).alias("n_bad"), F.count_distinct("chunk_idx").alias("n_idx"))
        both = blobs.join(counted, "blob_sha", "left")
        n = F.coalesce("n", F.lit(0))
        fits = (F.col("version") == VERSION) & (F.col("dim") == self.dim) & (n == F.col("n_chunks")) & (F.coalesce("n_idx", F.lit(0)) == n) & (F.coalesce("n_bad", F.lit(0)) == 0)
        return both.where(~F.coalesce(fits, F.lit(False))).select("blob_sha").distinct()

    def live(self, wanted: DataFrame | None = None, *, head: Manifest | None = None) -> DataFrame:
        """blob_sha and seq of the live blobs (of ``wanted``, a table of blob_sha, if given) that are not damaged. No vector is read."""
        head = head or self.head()
        blobs = self.blobs(head).select("blob_sha", "seq")
        if wanted is not None:
            blobs = blobs.join(wanted.select("blob_sha").distinct(), "blob_sha", "left_semi")
        damaged = self._damaged(head)
        return blobs if damaged is None else blobs.join(damaged, ["blob_sha", "seq"], "left_anti")

    def rows(self, head: Manifest | None = None) -> DataFrame:
        """All rows of vectors with their snapshot's place ``seq``, of which those that ``live`` names count."""
        return self._rows("vectors", head or self.head())

    def vectors(self, wanted: DataFrame | None = None, *, head: Manifest | None = None) -> DataFrame:
        """Rows of the valid live blobs (of ``wanted``, a table of blob_sha, if given)."""
        head = head or self.head()
        # the vectors are wide: they are only shuffled if there are too many blobs to send to every task
        return self._rows("vectors", head).join(broadcast_if_small(self.live(wanted, head=head)), ["blob_sha", "seq"], "left_semi").drop("seq")

    def sound_vectors(self, wanted: DataFrame) -> DataFrame:
        """``vectors`` of ``wanted`` after ``heal``: the damaged entries are tombstoned and left out."""
        self.heal(wanted)
        return self.vectors(wanted)

    def invalid(self, wanted: DataFrame) -> DataFrame:
        """blob_sha of the damaged ones of the wanted blobs."""
        head = self.head()
        damaged = self._damaged(head)
        if damaged is None:
            return self.spark.createDataFrame([], "blob_sha string")
        return self.blobs(head).join(damaged, ["blob_sha", "seq"], "left_semi").join(wanted.select("blob_sha").distinct(), "blob_sha", "left_semi").select("blob_sha")

    def heal(self, wanted: DataFrame) -> int:
        """Tombstone the damaged ones of the wanted blobs, so that the next index embeds them again; returns how many."""
        if self._damaged(self.head()) is None:
            return 0
        bad = self.invalid(wanted).distinct().cache()
        try:
            n = bad.count()
            if n:
                self.commit(deletes=bad)
            return n
        finally:
            bad.unpersist()

    # -- writing ----------------------------------------------------------------------------------

    def commit(self, chunks: DataFrame | None = None, blobs: DataFrame | None = None, deletes: DataFrame | None = None) -> Manifest:
        """Append a snapshot: vectors, the entries they belong to, and tombstones for older snapshots. Nothing given changes nothing.

        An entry and a tombstone of one commit for the same blob leave the entry.
        """
        snap, kinds = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}", []
        for kind, df in (("vectors", chunks), ("blobs", blobs), ("tombstones", deletes)):
            if df is not None:
                names = [c.strip().split(" ")[0] for c in KINDS[kind].split(",")]
                df.select(*names).write.parquet(self._data(kind, snap))
                kinds.append(kind)
        if not kinds:
            return self.head()
        if "blobs" in kinds:
            self._checked({"id": snap, "kinds": kinds})
        return self._publish(lambda head: [*head.snaps, {"id": snap, "kinds": kinds}])

    def remove(self, blob_shas: DataFrame) -> Manifest:
        return self.commit(deletes=blob_shas.select("blob_sha").distinct())

    def gc(self, *, vacuum: bool = False) -> tuple[str, str] | None:
        """Rewrite what is live into one snapshot and make it all of the history. Returns the old and the new head's id, None if there is nothing.

        Fails if another writer published meanwhile. ``vacuum`` deletes the files that are no longer referred to; readers of older heads must be gone.
        """
        head = self.head()
        if not head.id:
            return None
        snap = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
        live = self.blobs(head)
        live.select("blob_sha", "version", "dim", "n_chunks").write.parquet(self._data("blobs", snap))
        self._rows("vectors", head).join(live.select("blob_sha", "seq"), ["blob_sha", "seq"], "left_semi").drop("seq").write.parquet(self._data("vectors", snap))

        def swap(now: Manifest):
            if now.id != head.id:
                raise Diverged("the store changed during the compaction")
            return [{"id": snap, "kinds": ["vectors", "blobs"]}]

        self._checked({"id": snap, "kinds": ["vectors", "blobs"]})
        after = self._publish(swap)
        if vacuum:
            for kind in (*KINDS, "damaged"):
                for name in self.files.names(f"{self.location}/{kind}/model={self.model}"):
                    if name != f"snap={snap}":
                        self.files.delete(f"{self.location}/{kind}/model={self.model}/{name}")
            for name in self.files.names(f"{self.location}/checks/{self.model}"):
                if name != f"{snap}.json":
                    self.files.delete(f"{self.location}/checks/{self.model}/{name}")
            # the history's ids stay, as one file, so that other stores can still tell whether they are behind or apart
            self._forget()
        return head.id, after.id

    def _forget(self) -> None:
        """Replace the log by one manifest of the same state."""
        with self.files.lock(self.model):
            head = self.head()
            self._note_lineage(head.id, self.ancestors(head))
            if not self._write(head.number + 1, head.id, Manifest(), head.snaps, lineage=head.id):
                raise Diverged("another writer was faster")
            for name in self.files.names(self._manifests())[:-1]:
                self.files.delete(f"{self._manifests()}/{name}")

    def _note_lineage(self, id_: str, ids: set[str]) -> None:
        self.files.replace(f"{self.location}/lineage/{self.model}/{id_}.json", json.dumps(sorted(ids)))

    def clear(self) -> bool:
        """Delete this model; others stay. False if there was nothing."""
        there = bool(self.head().id)
        self.files.delete(self._manifests())
        for place in ("checks", "lineage"):
            self.files.delete(f"{self.location}/{place}/{self.model}")
        for kind in (*KINDS, "damaged"):
            self.files.delete(f"{self.location}/{kind}/model={self.model}")
        return there

    # -- interchange ------------------------------------------------------------------------------

    def payloads(self, wanted: DataFrame | None = None) -> DataFrame:
        """blob_sha and its vectors in the binary payload format, one row per valid live blob with or without vectors."""
        head, dim = self.head(), self.dim
        valid = self.live(wanted, head=head).select("blob_sha")
        packed = self.vectors(wanted, head=head).groupBy("blob_sha").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "start_line", "end_line", "embedding"))).alias("rows"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("blob_sha"), codec.pack_payloads(dim, batch.column("rows"))], ["blob_sha", "payload"])

        return valid.join(packed, "blob_sha", "left").select("blob_sha", "rows").mapInArrow(pack, "blob_sha string, payload binary")


def models(spark: SparkSession, location: str) -> list[str]:
    files = Files(spark, location)
    return files.names(f"{files.location}/manifests")


def _copy_model(spark: SparkSession, source: Store, target: Store) -> None:
    """Copy the files of the live snapshots that the target lacks, byte by byte and by tasks, then their checks.

    A file appears under its name when it is whole; one that is there with the right length is not copied again, so a copy that broke off goes on where it stopped.
    """
    snaps = source.head().snaps
    wanted = []
    for snap in snaps:
        for kind in (*snap["kinds"], "damaged"):
            have = target.files.lengths(target._data(kind, snap["id"]))
            wanted += [(source._data(kind, snap["id"]), target._data(kind, snap["id"]), name, size) for name, size in source.files.lengths(source._data(kind, snap["id"])).items() if have.get(name) != size]
    copy_files(spark, wanted)
    for snap in snaps:
        told = f"{source.location}/checks/{source.model}/{snap['id']}.json"
        if source.files.exists(told):
            target.files.replace(f"{target.location}/checks/{target.model}/{snap['id']}.json", source.files.read(told))


def copy_files(spark: SparkSession, wanted: list[tuple[str, str, str, int]]) -> int:
    """Copy files (from folder, to folder, name, length) by tasks; returns the bytes. What arrives is compared with what was read by its hash."""
    if not wanted:
        return 0
    rows = spark.createDataFrame(wanted, "source string, target string, name string, size bigint").repartition(min(len(wanted), 10_000), "source", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [transfer(r["source"], r["target"], r["name"], r["size"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["size"])

    return rows.mapInArrow(run, "size bigint").agg(F.sum("size")).first()[0]


def transfer(source: str, target: str, name: str, size: int, *, piece: int = 8 << 20) -> int:
    """Copy one file in pieces under another name, read it again to compare hashes, and give it its name."""
    (files, plain), (others, place) = shared.filesystem(f"{source}/{name}"), shared.filesystem(target)
    others.create_dir(place, recursive=True)
    temporary, n, sent = f"{place}/.{name}.{uuid.uuid4().hex}", 0, hashlib.sha256()
    with files.open_input_stream(plain) as f, others.open_output_stream(temporary) as g:
        while data := f.read(piece):
            g.write(data)
            sent.update(data)
            n += len(data)
    arrived = hashlib.sha256()
    with others.open_input_stream(temporary) as f:
        while data := f.read(piece):
            arrived.update(data)
    if n != size or arrived.digest() != sent.digest():
        others.delete_file(temporary)
        raise OSError(f"{source}/{name} did not arrive whole")
    others.move(temporary, f"{place}/{name}")
    return n


def push(spark: SparkSession, location: str, remote: str, *, force: bool = False) -> list[str]:
    """Publish all models of ``location`` at ``remote``; refused if a remote head is not among the local manifests, unless forced."""
    done = []
    for model in models(spark, location):
        mine, theirs = Store(spark, location, model, 0), Store(spark, remote, model, 0)
        head, other = mine.head(), theirs.head()
        if other.id and other.id != head.id and not force and other.id not in mine.ancestors(head):
            raise Diverged(f"{model}: the remote has changes that this store lacks")
        if other.id != head.id:
            _copy_model(spark, mine, theirs)
            _set_head(theirs, mine)
        done.append(model)
    return done


def pull(spark: SparkSession, location: str, remote: str) -> list[str]:
    """Take over all models of ``remote``; its state replaces the local one."""
    done = []
    for model in models(spark, remote):
        mine, theirs = Store(spark, location, model, 0), Store(spark, remote, model, 0)
        if theirs.head().id != mine.head().id:
            _copy_model(spark, theirs, mine)
            _set_head(mine, theirs)
        done.append(model)
    return done


def _set_head(store: Store, source: Store) -> None:
    """Make the head of ``source`` that of ``store``: a manifest of the whole state, with the ids of all that came before it in a file of its own."""
    head = source.head()
    store._note_lineage(head.id, source.ancestors(head))
    with store.files.lock(store.model):
        number = max(head.number, store.head().number + 1)
        if not store._write(number, head.id, Manifest(), head.snaps, lineage=head.id):
            raise Diverged("another writer was faster")


def merge(spark: SparkSession, location: str, remote: str) -> list[str]:
    """Union of two diverged stores into ``location``: the remote's snapshots that it lacks are appended, and each blob counts once."""
    done = []
    for model in models(spark, remote):
        mine, theirs = Store(spark, location, model, 0), Store(spark, remote, model, 0)
        _copy_model(spark, theirs, mine)
        snaps = theirs.head().snaps

        def union(head: Manifest, snaps=snaps):
            have = {s["id"] for s in head.snaps}
            new = [s for s in snaps if s["id"] not in have]
            return [*head.snaps, *new] if new else None

        mine._publish(union)
        done.append(model)
    return done


def configure_remote(spark: SparkSession, location: str, name: str, url: str) -> bool:
    """Note a remote and that divergent stores are merged by union; False if it was noted already."""
    files = Files(spark, location)
    at = f"{files.location}/settings.json"
    settings = json.loads(files.read(at)) if files.exists(at) else {}
    remotes = settings.setdefault("remotes", {})
    if remotes.get(name) == url and settings.get("merge") == "union":
        return False
    remotes[name], settings["merge"] = url, "union"
    files.replace(at, json.dumps(settings, indent=2))
    return True


def remote_url(spark: SparkSession, location: str, name: str) -> str:
    files = Files(spark, location)
    at = f"{files.location}/settings.json"
    remotes = json.loads(files.read(at)).get("remotes", {}) if files.exists(at) else {}
    if name not in remotes:
        raise ValueError(f"no remote called {name}")
    return remotes[name]
