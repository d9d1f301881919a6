"""The incremental index: embed each content once, in bounded groups that are committed one by one."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.functions import chunking, formatting, hashing, paths
from lumenseek.operators import embedders
from lumenseek.operators.joins import broadcast_if_small
from lumenseek.operators.store import VERSION, Store

log = logging.getLogger(__name__)
#: Chunks that are embedded between two commits. The larger, the fewer snapshots; what a crash loses is one group.
GROUP_CHUNKS = 1_000_000
#: Leading digits of an id that make a range of the greedy cut: 65,536 ranges.
RANGE_DIGITS = 4


@dataclass
class IndexStats:
    files_total: int = 0
    blobs_unique: int = 0
    blobs_already_cached: int = 0
    blobs_embedded: int = 0
    blobs_skipped: int = 0
    blobs_pruned: int = 0  # the store is append-only: always 0
    chunks_embedded: int = 0
    elapsed_ms: int = 0

    def __str__(self) -> str:
        return formatting.stats_line(asdict(self))


def resolved(listed: DataFrame, modified: DataFrame) -> DataFrame:
    """path, blob_sha, raw_sha from listed files (path, index_sha) and the modified ones (path, disk_sha; null: unreadable).

    A modified file counts with what is on disk, and is dropped if that cannot be read.
    """
    changed = modified.select("path", F.col("disk_sha"), F.lit(True).alias("is_modified"))
    rows = listed.where(paths.is_textual(F.col("path"))).join(changed, "path", "left")
    rows = rows.where("is_modified IS NULL OR disk_sha IS NOT NULL")
    return rows.select("path", F.coalesce("disk_sha", "index_sha").alias("blob_sha"), F.coalesce("is_modified", F.lit(False)).alias("raw_sha"))


def canonical(files: DataFrame) -> DataFrame:
    """For each blob the one path that it is read from: a modified file's if any, else the first in path order."""
    order = F.struct(~F.coalesce(F.col("raw_sha"), F.lit(False)), F.col("path"))
    return files.groupBy("blob_sha").agg(F.min_by(F.struct("path", "raw_sha"), order).alias("c")).select("blob_sha", "c.path", "c.raw_sha")


def todo(files: DataFrame, known: DataFrame) -> DataFrame:
    return canonical(files).join(known.select("blob_sha"), "blob_sha", "left_anti")


def unchanged(read: DataFrame) -> DataFrame:
    """Blobs whose bytes are still those that were listed; only modified files are hashed again, as filters may alter others."""
    return read.where("content IS NOT NULL").where(~F.col("raw_sha") | (hashing.git_blob_sha(F.col("content")) == F.col("blob_sha")))


def checkpoint_groups(sizes: DataFrame, most: int) -> DataFrame:
    """blob_sha, n and group: the greedy cut in id order. A group ends before a blob that would take it over ``most`` chunks, and once it has ``most``;
    a blob is never split, and one without chunks goes with its neighbours. n: null counts as 0.

    Ids are hashes, so they are dealt to ranges of like size. The cut of one blob depends on all before it, but only through the chunks that the open
    group holds by then: a range is a function of that carry, which gives the number of cuts and the carry that it leaves. Functions are composed: those of
    neighbouring ranges by one task for each first half of ``RANGE_DIGITS``, and the composed ones, at most 256, are applied one after the other. Then each range
    knows its carry and cuts itself. A function has at most ``most`` + 1 pieces, so no task holds more than that, or than the sizes of one range.
    """
    ranged = sizes.select("blob_sha", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).groupBy(F.substring("blob_sha", 1, RANGE_DIGITS).alias("range"))
    arrays = ranged.agg(F.array_sort(F.collect_list(F.struct("blob_sha", "n"))).alias("blobs"))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, ns in zip(batch.column("range").to_pylist(), batch.column("ns")):
                yield _told([name], [carry_function(np.asarray(ns.values.to_numpy(zero_copy_only=False), np.int64), most)])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole = None, None
        for name, function in _functions(batches):
            if name[: RANGE_DIGITS // 2] != at:
                if at is not None:
                    yield _told([at], [whole])
                at, whole = name[: RANGE_DIGITS // 2], function
            else:
                whole = compose(whole, function)
        if at is not None:
            yield _told([at], [whole])

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for name, function in _functions(batches):
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([held], pa.int64())], ["part", "number", "held"])
            cuts, held = apply(function, held)
            number += cuts

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held = None, 0, 0
        for batch in batches:
            begins = zip(batch.column("part").to_pylist(), batch.column("number").to_pylist(), batch.column("held").to_pylist())
            for (name, function), (part, first, carry) in zip(_functions([batch]), begins):
                if part != at:
                    at, number, held = part, first, carry
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([held], pa.int64())], ["range", "first", "held"])
                cuts, held = apply(function, held)
                number += cuts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [greedy_cuts(np.asarray(ns.values.to_numpy(zero_copy_only=False), np.int64), held, most)[0] for ns, held in zip(batch.column("ns"), batch.column("held").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("range"), batch.column("first"), pa.array(found, pa.list_(pa.int64()))], ["range", "first", "cuts"])

    lists = arrays.select("range", F.transform("blobs", lambda x: x["n"]).alias("ns"))
    told = lists.mapInArrow(functions, _FUNCTION).withColumn("part", F.substring("range", 1, RANGE_DIGITS // 2))
    parts = told.repartition("part").sortWithinPartitions("range").drop("part").mapInArrow(composed, _FUNCTION)
    starts = parts.repartition(1).sortWithinPartitions("range").mapInArrow(applied, "part string, number bigint, held bigint")
    carries = told.join(F.broadcast(starts), "part").repartition("part").sortWithinPartitions("range").mapInArrow(within, "range string, first bigint, held bigint")
    found = lists.join(carries, "range").mapInArrow(cut, "range string, first bigint, cuts array<bigint>")
    each = arrays.join(found, "range").select("first", "cuts", F.posexplode("blobs").alias("place", "blob"))
    return each.select("blob.blob_sha", "blob.n", (F.col("first") + F.size(F.filter("cuts", lambda c: c <= F.col("place")))).alias("group"))


class Carry(NamedTuple):
    """A function of the chunks held, from 0 on, in pieces: from ``start[i]`` on there are ``cuts[i]`` cuts and ``out[i]`` chunks are held afterwards.

    Only the first piece can be one without a cut, where what was held is added: ``adds``.
    """

    start: np.ndarray
    cuts: np.ndarray
    out: np.ndarray
    adds: bool


_FUNCTION = "range string, start array<bigint>, cuts array<bigint>, out array<bigint>, adds boolean"


def _told(names: list[str], functions: list[Carry]) -> pa.RecordBatch:
    lists = [pa.array([getattr(f, c) for f in functions], pa.list_(pa.int64())) for c in ("start", "cuts", "out")]
    return pa.RecordBatch.from_arrays([pa.array(names), *lists, pa.array([f.adds for f in functions])], ["range", "start", "cuts", "out", "adds"])


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Carry]]:
    for batch in batches:
        for i, (name, adds) in enumerate(zip(batch.column("range").to_pylist(), batch.column("adds").to_pylist())):
            yield name, Carry(*(batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("start", "cuts", "out")), adds)


def _pieces(start: np.ndarray, cuts: np.ndarray, out: np.ndarray, adds: bool) -> Carry:
    """Neighbouring pieces that say the same are one."""
    new = np.ones(len(start), bool)
    new[1:] = (cuts[1:] != cuts[:-1]) | (out[1:] != out[:-1])
    if adds and len(new) > 1:
        new[1] = True
    return Carry(start[new], cuts[new], out[new], adds)


def carry_function(sizes: np.ndarray, most: int) -> Carry:
    """What the greedy cut makes of blobs of these sizes, for every number of chunks that may be held before: 0 to ``most`` - 1."""
    sums, m = np.cumsum(sizes), len(sizes)
    total = int(sums[-1]) if m else 0
    # from every blob on, with nothing held: how many cuts follow, and what is held at the end
    before = sums - sizes
    full = np.searchsorted(sums, before + most)
    cuts, out = np.zeros(m + 1, np.int64), np.append(total - before, 0)
    for at in range(m - 1, -1, -1):
        j = int(full[at])
        if j < m:
            following = j if before[j] > before[at] and sums[j] - before[at] > most else j + 1
            cuts[at], out[at] = cuts[following] + 1, out[following]
    # the blob that fills the group: exactly, so that it is cut after the blob, or beyond it, so that it is cut before unless nothing was held
    filled = np.flatnonzero(sizes > 0)
    exact, beyond = most - sums[filled], most - before[filled]
    rest = np.maximum(exact + 1, 0)
    alone = (rest == 0) & (before[filled] == 0)
    starts = np.concatenate((exact, rest[alone], np.where(alone, 1, rest)))
    places = np.concatenate((filled + 1, filled[alone] + 1, filled))
    valid = np.concatenate((exact >= 0, np.ones(alone.sum(), bool), np.where(alone, 1, rest) < np.minimum(beyond, most)))
    starts, places = starts[valid], places[valid]
    order = np.argsort(starts, kind="stable")
    starts, places = starts[order], places[order]
    adds = total < most
    first = [0] if adds else []
    return _pieces(np.append(first, starts).astype(np.int64), np.append([0] * adds, cuts[places] + 1).astype(np.int64), np.append([total] * adds, out[places]).astype(np.int64), adds)


def apply(function: Carry, held: int) -> tuple[int, int]:
    """Cuts, and the chunks held afterwards."""
    i = int(np.searchsorted(function.start, held, "right")) - 1
    return int(function.cuts[i]), int(function.out[i]) + (held if function.adds and i == 0 else 0)


def compose(first: Carry, second: Carry) -> Carry:
    """The function of two stretches of blobs, one after the other."""
    start, cuts, out = [], [], []
    fixed = slice(1 if first.adds else 0, None)
    if first.adds:
        add = int(first.out[0])
        end = int(first.start[1]) if len(first.start) > 1 else None
        low = int(np.searchsorted(second.start, add, "right")) - 1
        high = len(second.start) if end is None else int(np.searchsorted(second.start, add + end, "left"))
        start.append(np.maximum(second.start[low:high] - add, 0))
        cuts.append(second.cuts[low:high])
        outs = second.out[low:high].copy()
        if second.adds and low == 0:
            outs[0] += add
        out.append(outs)
    at = np.searchsorted(second.start, first.out[fixed], "right") - 1
    start.append(first.start[fixed])
    cuts.append(first.cuts[fixed] + second.cuts[at])
    out.append(second.out[at] + np.where((at == 0) & second.adds, first.out[fixed], 0))
    return _pieces(np.concatenate(start), np.concatenate(cuts), np.concatenate(out), first.adds and second.adds and int(np.searchsorted(second.start, int(first.out[0]), "right")) == 1)


def greedy_cuts(sizes: np.ndarray, held: int, most: int) -> tuple[list[int], int]:
    """Places before which a new group begins, ``held`` chunks being in the open group already, and the chunks in the group that stays open."""
    sums, cuts, at, done = np.cumsum(sizes), [], 0, 0
    while at < len(sizes):
        # the first blob that fills the open group
        j = at + int(np.searchsorted(sums[at:], most - held + done))
        if j == len(sizes):
            return cuts, held + int(sums[-1]) - done
        before = held + (int(sums[j - 1]) if j else 0) - done
        at = j if before > 0 and before + int(sizes[j]) > most else j + 1
        cuts.append(at)
        held, done = 0, int(sums[at - 1]) if at else 0
    return cuts, held


def index(spark: SparkSession, files: DataFrame, store: Store, embedder: embedders.Embedder, *, read: Callable[[DataFrame], DataFrame] | None = None, group_chunks: int = GROUP_CHUNKS, quiet: bool = True, verbose: bool = False) -> IndexStats:
    """Embed what the store lacks of ``files`` (path, blob_sha, raw_sha, content) and return the counts.

    With ``read``, files need no content: it adds the column to the rows (path, blob_sha, raw_sha) that are to be embedded, so nothing else is read.

    Files whose path holds no text are left out. Contents without chunks become entries with 0 chunks; unreadable ones (null content) and modified
    files that changed since the listing are skipped. Each group of about ``group_chunks`` chunks is committed as soon as it is embedded, so an interrupted run
    goes on where it stopped. With nothing to embed, no content is read. Unless ``quiet``, progress is logged: the share done after each group, or, ``verbose``, a line for each.
    """
    began = time.monotonic()
    listed = files.where(paths.is_textual(F.col("path")))
    counts = listed.agg(F.count("*").alias("files"), F.count_distinct("blob_sha").alias("blobs")).first()
    stats = IndexStats(files_total=counts["files"], blobs_unique=counts["blobs"])
    known = store.known()
    wanted = todo(listed.select("path", "blob_sha", "raw_sha"), known)
    stats.blobs_already_cached = listed.select("blob_sha").distinct().join(known, "blob_sha", "left_semi").count()
    if stats.blobs_already_cached < stats.blobs_unique:
        staged = f"{store.location}/staging/{uuid.uuid4().hex}"
        try:
            _embed(spark, listed, wanted, store, embedder, read, staged, group_chunks, quiet, verbose, stats)
        finally:
            store.files.delete(staged)
    stats.elapsed_ms = int((time.monotonic() - began) * 1000)
    return stats


def _embed(spark, listed, wanted, store, embedder, read, staged, group_chunks, quiet, verbose, stats) -> None:
    if read is not None:
        found = read(wanted)
    else:  # contents are wide: they are only shuffled if there is too much to do to send its list to every task
        found = listed.select("path", "blob_sha", "content").join(broadcast_if_small(wanted), ["path", "blob_sha"]).dropDuplicates(["blob_sha"])
    # a snapshot of what to embed: files may change while groups are embedded
    unchanged(found).select("blob_sha", "content").write.parquet(f"{staged}/contents")
    contents = spark.read.parquet(f"{staged}/contents")
    counted = contents.select("blob_sha", chunking.chunk_count(F.col("content")).alias("n"))
    checkpoint_groups(counted, group_chunks).write.partitionBy("group").parquet(f"{staged}/groups")
    if not store.files.exists(f"{staged}/groups"):
        return
    grouped = spark.read.schema("blob_sha string, n bigint, group bigint").parquet(f"{staged}/groups")
    totals = grouped.agg(F.count("*").alias("blobs"), F.sum("n").alias("chunks")).first()
    stats.blobs_skipped = stats.blobs_unique - stats.blobs_already_cached - totals["blobs"]
    if not quiet and totals["chunks"]:
        log.warning(formatting.backend_line(embedder.model, embedder.batch_size))
        log.warning(formatting.groups_line(totals["chunks"], totals["blobs"], group_chunks) if verbose else formatting.progress(totals["chunks"], totals["blobs"], stats.blobs_already_cached, stats.blobs_unique))
    # chunks lie by group, so each group reads its own only
    placed = contents.join(broadcast_if_small(grouped.where("n > 0").select("blob_sha", "group")), "blob_sha")
    chunking.with_chunks(placed).repartitionByRange("group", "blob_sha").write.partitionBy("group").parquet(f"{staged}/chunks")
    chunks = spark.read.schema("blob_sha string, chunk_idx int, start_line int, end_line int, text string, group bigint").parquet(f"{staged}/chunks") if totals["chunks"] else None
    for done, row in enumerate(grouped.groupBy("group").agg(F.sum("n").alias("n"), F.count("*").alias("blobs")).orderBy("group").collect(), 1):
        part = grouped.where(F.col("group") == row["group"])
        entries = part.select("blob_sha", F.lit(VERSION).alias("version"), F.lit(store.dim).alias("dim"), F.col("n").cast("int").alias("n_chunks"))
        rows = chunks.where(F.col("group") == row["group"]).drop("group") if row["n"] else None
        vectors = embedders.embed_column(rows, embedder) if row["n"] else None
        store.commit(vectors, entries)
        stats.chunks_embedded += row["n"]
        stats.blobs_embedded += row["blobs"]
        if not quiet and totals["chunks"]:
            log.warning(formatting.group_line(done, stats.chunks_embedded) if verbose else formatting.percent_line(stats.chunks_embedded, totals["chunks"]))
