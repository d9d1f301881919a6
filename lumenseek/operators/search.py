"""Exact search: inner product with every current vector, top k windows, then all paths of each winner.

Order: score descending, then blob_sha, chunk_idx and path, so ties have one answer. Scores that are not finite never win.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lumenseek.functions import chunking, formatting, paths, vectors
from lumenseek.operators import joins, shared
from lumenseek.operators.joins import broadcast_if_small, is_small
from lumenseek.operators.store import Store

#: Keys of current blobs, some 100 bytes each, up to which they are sent to the scan.
KEY_ROWS = 100_000
HIT_COLUMNS = ["path", "start_line", "end_line", "score", "blob_sha", "chunk_idx"]
_ROW = ["blob_sha", "chunk_idx", "start_line", "end_line"]


def query_text(words: Sequence[str]) -> str:
    """The words of a query as one text; an empty query is an error."""
    text = " ".join(words)
    if not text:
        raise ValueError("query is empty")
    return text


def candidates(vector_rows: DataFrame, files: DataFrame, prefix: str | None = None) -> DataFrame:
    """Vectors of blobs that some current path (below the prefix) holds."""
    current = files.where(paths.under_prefix(F.col("path"), prefix)).select("blob_sha")
    # the vectors are wide: they are only shuffled if there are too many current blobs to send to every task
    return vector_rows.join(broadcast_if_small(current), "blob_sha", "left_semi")


def scored(rows: DataFrame, query: Column) -> DataFrame:
    score = vectors.dot(F.col("embedding"), query)
    return rows.select(*_ROW, score.alias("score")).where(vectors.is_finite(F.col("score")))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The k best of scored rows; fewer if there are fewer, none for k = 0."""
    return rows.orderBy(F.desc("score"), "blob_sha", "chunk_idx").limit(k)


def scan_top_k(rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """``top_k`` of ``scored``, by one matrix product per Arrow batch; each batch hands on its k best rows only."""
    q = np.asarray(query, np.float64)
    schema = rows.select(*_ROW).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            if not batch.num_rows or not k:
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            if (sizes != len(q)).any():
                raise ValueError(f"expected vectors of {len(q)}")
            score = flat.reshape(-1, len(q)).astype(np.float64) @ q
            place = np.flatnonzero(np.isfinite(score))
            if len(place) > k:
                kth = np.partition(score[place], len(place) - k)[len(place) - k]
                place = place[score[place] >= kth]
            kept = batch.select(_ROW).take(pa.array(place))
            found = pa.table([*kept.columns, pa.array(score[place])], schema=pa.schema([*kept.schema, ("score", pa.float64())]))
            found = found.sort_by([("score", "descending"), ("blob_sha", "ascending"), ("chunk_idx", "ascending")]).slice(0, k)
            yield from found.to_batches()

    return top_k(rows.select(*_ROW, "embedding").mapInArrow(run, schema), k)


def scores(rows: DataFrame, query: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``scored`` of all rows by one matrix product per Arrow batch, with the columns ``keys`` besides; the vectors stay behind."""
    q = np.asarray(query, np.float64)
    names = [*_ROW, *(c for c in keys if c not in _ROW)]
    schema = rows.select(*names).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _matrix(batch.column("embedding"), len(q)) @ q
            told = pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(score)], [*names, "score"])
            yield told.filter(pa.array(np.isfinite(score)))

    return rows.select(*names, "embedding").mapInArrow(run, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != dim).any():
        raise ValueError(f"expected vectors of {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def top_of(rows: DataFrame, current: DataFrame, query: Sequence[float], k: int, keys: Sequence[str]) -> DataFrame:
    """The k best of the rows whose ``keys`` are in ``current``. No plan shuffles vectors.

    Few keys are sent to the scan. Many are not: then all rows are scored where they are read, and what meets the keys is a narrow row for each.
    """
    if is_small(current, min(joins.BROADCAST_ROWS, KEY_ROWS)):
        return scan_top_k(rows.join(F.broadcast(current), list(keys), "left_semi"), query, k)
    return top_k(scores(rows, query, keys).join(current, list(keys), "left_semi").select(*_ROW, "score"), k)


def fan_out(winners: DataFrame, files: DataFrame, prefix: str | None = None) -> DataFrame:
    """A hit per winner and path below the prefix that holds its blob; k bounds the winners, not the hits."""
    named = files.where(paths.under_prefix(F.col("path"), prefix)).select("path", "blob_sha")
    hits = named.join(F.broadcast(winners), "blob_sha").distinct()  # the winners are k rows at most
    return hits.select(*HIT_COLUMNS).orderBy(F.desc("score"), "blob_sha", "chunk_idx", "path")


def search(vector_rows: DataFrame, files: DataFrame, query: Sequence[float], k: int = 10, prefix: str | None = None, *, scan: str = "arrow") -> DataFrame:
    """Hits of one query vector. ``scan``: ``arrow`` for large tables, ``sql`` for built-in functions only. An empty table gives no hits."""
    if scan == "arrow":
        current = files.where(paths.under_prefix(F.col("path"), prefix)).select("blob_sha").distinct()
        winners = top_of(vector_rows, current, query, k, ["blob_sha"])
    else:
        winners = top_k(scored(candidates(vector_rows, files, prefix), vectors.literal(query)), k)
    return fan_out(winners, files, prefix)


#: Bytes of vectors that a task holds to meet all queries, of queries as well as of their best scores that it keeps instead of making them again, and of the scores that it makes at once.
CHUNK_BYTES, KEPT_QUERY_BYTES, SCORE_BYTES = 32 << 20, 64 << 20, 8 << 20


def search_many(vector_rows: DataFrame, queries: DataFrame, k: int, *, block: int = 1024) -> DataFrame:
    """The k best windows of every query (qid, qvec): qid, rank and the columns of a scored row.

    The queries are written in blocks to the shared folder. One scan reads the vectors; a task holds a chunk of them and multiplies it with one block of
    queries after the other. It hands on what is among the chunk's k best for a query, ties included, and no worse than the k best that it has seen for it before, if
    it kept those. Those few rows are merged for each query. Neither side is held whole anywhere. Null queries are left out; without queries or vectors there are no rows.
    """
    spark = vector_rows.sparkSession
    folder = shared.scratch(spark, "queries")
    queries.select(F.col("qid").cast("bigint").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec")).where("qid IS NOT NULL AND qvec IS NOT NULL").write.option("maxRecordsPerFile", block).parquet(folder)
    schema = "qid bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vector_rows.select(*_ROW).schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _QueryBlocks(folder)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                chunk = pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                yield from blocks.best(chunk, k)
                del chunk
        if held:
            yield from blocks.best(pa.Table.from_batches(held).combine_chunks(), k)

    found = vector_rows.select(*_ROW, "embedding").mapInArrow(run, schema)
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "blob_sha", "chunk_idx")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


class _QueryBlocks:
    """The blocks of queries in a folder, for one task: read one by one for each chunk of vectors, or kept as far as they are few, as are the k best scores of each so far."""

    def __init__(self, folder: str) -> None:
        self.files, self.plain = shared.filesystem(folder)
        self.names = sorted(f.path for f in self.files.get_file_info(fs.FileSelector(self.plain)) if f.base_name.endswith(".parquet"))
        self.read: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.seen: dict[str, np.ndarray] = {}
        self.read_bytes = self.seen_bytes = 0  # as they are held; a file may be much smaller

    def block(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name in self.read:
            return self.read[name]
        table = pq.read_table(name, filesystem=self.files, columns=["qid", "qvec"])
        ids = table.column("qid").to_numpy()
        flat = table.column("qvec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        told = ids, flat.reshape(len(ids), len(flat) // max(1, len(ids))).astype(np.float64)
        size = ids.nbytes + told[1].nbytes
        if self.read_bytes + size <= KEPT_QUERY_BYTES:
            self.read[name] = told
            self.read_bytes += size
        return told

    def best(self, chunk: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
        if not chunk.num_rows or k < 1:
            return
        rows = chunk.select(_ROW)
        column = chunk.column("embedding").combine_chunks()
        # the place of each row among ties
        tie = np.empty(chunk.num_rows, np.int64)
        tie[pc.sort_indices(rows, [("blob_sha", "ascending"), ("chunk_idx", "ascending")]).to_numpy()] = np.arange(chunk.num_rows)
        matrix = None
        for name in self.names:
            ids, queries = self.block(name)
            if not len(ids):
                continue
            if name not in self.seen and self.seen_bytes + 8 * k * len(ids) <= KEPT_QUERY_BYTES:
                self.seen[name] = np.full((len(ids), k), -np.inf)
                self.seen_bytes += self.seen[name].nbytes
            if matrix is None or len(matrix) != queries.shape[1]:
                matrix = _matrix(column, queries.shape[1]).T
            some = max(1, SCORE_BYTES // (8 * chunk.num_rows))
            for at in range(0, len(ids), some):
                score = queries[at : at + some] @ matrix
                score[~np.isfinite(score)] = -np.inf
                which, place = np.nonzero((score >= self._bar(name, at, score, k)[:, None]) & (score > -np.inf))
                if not len(which):
                    continue
                # numbers only until k are left of each query: with many copies, all of a chunk may tie
                order = np.lexsort((tie[place], -score[which, place], which))
                which, place = which[order], place[order]
                firsts = np.flatnonzero(np.diff(which, prepend=-1))
                kept = np.arange(len(which)) - np.repeat(firsts, np.diff(np.append(firsts, len(which)))) < k
                which, place = which[kept], place[kept]
                found = pa.table([pa.array(ids[at + which], pa.int64()), *rows.take(pa.array(place)).columns, pa.array(score[which, place])], names=["qid", *_ROW, "score"])
                yield from found.combine_chunks().to_batches()

    def _bar(self, name: str, at: int, score: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query so far, this chunk included; what is below it can be no winner."""
        top = np.partition(score, score.shape[1] - k, 1)[:, -k:] if score.shape[1] > k else score
        if name in self.seen:
            # chunks differ in size, and so do the stretches of a block; what is kept is copied, as a slice would hold all scores
            seen = self.seen[name][at : at + len(score)]
            top = np.concatenate((top, seen), axis=1)
            seen[:] = top = np.partition(top, top.shape[1] - k, 1)[:, -k:]
        return top.min(1) if top.shape[1] >= k else np.full(len(score), -np.inf)


def show_lines(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with the lines of the file as it is now: the whole window, not the cut text. No lines (null) for a missing or shrunken file."""
    # only the hits' files are split into lines; contents are not shuffled unless the hits are too many to send to every task
    shown = files.where("content IS NOT NULL").join(broadcast_if_small(hits.select("path").distinct()), "path", "left_semi")
    texts = shown.select(F.col("path").alias("__path"), F.split(F.col("content").cast("binary").cast("string"), "\n", -1).alias("__lines"))
    joined = hits.join(texts, F.col("path") == F.col("__path"), "left")
    whole = F.col("start_line") <= F.size("__lines")
    shown = F.when(whole, F.slice("__lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1))
    return joined.select(*hits.columns, shown.alias("lines"))


def search_store(spark: SparkSession, store: Store, files: DataFrame, query: Sequence[float], k: int = 10, prefix: str | None = None) -> DataFrame:
    """Search the current files' vectors; damaged entries are dropped from the store and left out.

    Only entries of files below the prefix are looked at. What is live and sound is told by the entries alone, so the vectors are read once, and no plan shuffles them.
    """
    listed = files.where(paths.is_textual(F.col("path")) & paths.under_prefix(F.col("path"), prefix))
    shas = listed.select("blob_sha").distinct()
    store.heal(shas)
    head = store.head()
    winners = top_of(store.rows(head), store.live(shas, head=head), query, k, ["blob_sha", "seq"])
    return fan_out(winners, listed, prefix)


def render(hits: DataFrame, *, as_json: bool = False, show: DataFrame | None = None) -> str:
    """The hits for people (one line each, with the file's lines if ``show`` has the files) or as a JSON document. All paths of the k winners reach the driver, as all are printed."""
    if as_json:
        return formatting.hits_document(r.asDict() for r in hits.collect())
    out = []
    if show is not None:  # the hits are found once, and then their lines
        local = hits.sparkSession.createDataFrame(hits.collect(), hits.schema)
        hits = show_lines(local, show).orderBy(F.desc("score"), "blob_sha", "chunk_idx", "path")
    for row in hits.collect():
        out.append(f"{row['score']:.4f}  {row['path']}:{row['start_line']}-{row['end_line']}")
        if show is not None and row["lines"] is not None:
            out += [*(f"    {line}" for line in row["lines"]), ""]
    return "\n".join(out)


def lines_of(content: Column) -> Column:
    return chunking.lines(content.cast("binary").cast("string"))
