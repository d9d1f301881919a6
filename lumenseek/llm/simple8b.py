"""Token-id files in a Simple-8b word-aligned coding.

Every 64-bit word holds a 4-bit selector and as many ids as fit its 60 data bits. Ids are coded in
blocks of 1,024, each starting at a word of its own whose index the segment lists, so any block is
decoded alone and all words of one selector at once. Values of 2**60 and more are escapes: a
zero stands in the words and the segment lists position and value.

A file is a run of segments. Each has, in little-endian 64-bit words: magic, number of the part that it belongs to,
in doc_id order, ids of the part before it, documents, ids, blocks, words, escapes; the documents' doc_ids, their token
counts (top bit: doc_id is null), the first word of each block, the escapes' positions and values,
the words, and the CRC-32 of all that; then the end mark. A part is what one task writes, in one or more files. Spark's text
writer puts the segments out, with the end mark as its line separator, so the files can lie in any store that Spark writes to.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, tokens

#: Fixed values of the coding: ids a word and bits an id, by selector (0 and 1 are unused).
SELECTORS = {2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7), 9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
BLOCK = 1024
MAGIC = b"S8BSEG01"
END = b"S8BEND01"
HEADER_WORDS = 8
NULL_ID = 1 << 63
SEGMENT_IDS = 500_000
#: Text that a task writes, about, up to so many tasks; beyond, each takes more. Segments (some 1 MB each) a file.
PART_BYTES = 16 << 20
MOST_PARTS = 100_000
FILE_SEGMENTS = 48
#: Characters of a text that tell ranges of one doc_id apart.
KEY_CHARS = 64
#: Text that is encoded at once: the more, the fewer words are looked up again.
SLICE_BYTES = 4_000_000


#: Bit lengths of 16-bit values, which most ids are.
_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 64-bit values, exact."""
    if len(values) and values.max() < len(_SHORT):
        return _SHORT[values]
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    if not high.any():
        return low.astype(np.uint8)
    return np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and their end), positions of escapes, values of escapes."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    escapes = np.flatnonzero(values >= np.uint64(1 << 60))
    escaped = values[escapes]
    if len(escapes):
        values = values.copy()
        values[escapes] = 0
    need = _bits(values)
    # the widest id among the next 1, 2, 3, ... ids; past the end of a block nothing needs a bit, but no word may reach there
    widest = {1: need}

    def over(count: int) -> np.ndarray:
        if count not in widest:
            half = count // 2 + count % 2
            a, b = over(half), over(count - half)
            shifted = np.zeros(n, np.uint8)
            shifted[: n - half] = b[half:]
            widest[count] = np.maximum(a, shifted)
        return widest[count]

    left = np.resize(np.minimum(np.arange(BLOCK, 0, -1), 60).astype(np.uint8), n)
    left[max(0, n - 60) :] = np.minimum(left[max(0, n - 60) :], np.arange(min(n, 60), 0, -1))
    choice = np.full(n, 15, np.uint8)
    for selector in range(14, 1, -1):
        count, bits = SELECTORS[selector]
        fits = over(count) <= bits if count <= n else np.zeros(0, bool)
        if fits.any():
            np.putmask(choice, fits & (left >= count), selector)
    counts = np.array([SELECTORS.get(s, (0, 0))[0] for s in range(16)])
    # all blocks go from word to word together
    steps = counts[choice]
    at, firsts = np.arange(0, n, BLOCK), []
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        firsts.append(at)
        at = at + steps[at]
        inside = at < ends
        at, ends = at[inside], ends[inside]
    first = np.sort(np.concatenate(firsts)) if n else np.zeros(0, np.int64)
    chosen = choice[first] if n else np.zeros(0, np.uint8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        count, bits = SELECTORS[int(selector)]
        rows = np.flatnonzero(chosen == selector)
        for k in range(count):
            words[rows] |= values[first[rows] + k] << np.uint64(k * bits)
    blocks = np.searchsorted(first, np.arange(0, n + BLOCK, BLOCK)) if n else np.zeros(1, np.int64)
    return words, blocks.astype(np.uint64), escapes.astype(np.uint64), escaped


def decode(words: np.ndarray, escapes: np.ndarray = (), escaped: np.ndarray = ()) -> np.ndarray:
    """The values of the words; vectorised over all words of one selector. ``escapes`` are positions within them."""
    words = np.ascontiguousarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([SELECTORS.get(s, (0, 0))[0] for s in range(16)])[chosen]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(chosen):
        if int(selector) not in SELECTORS:
            raise ValueError("unknown selector")
        count, bits = SELECTORS[int(selector)]
        rows = np.flatnonzero(chosen == selector)
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[first[rows] + k] = (words[rows] >> np.uint64(k * bits)) & mask
    out[np.asarray(escapes, np.int64)] = escaped
    return out


def segment(part: int, before: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment, without the end mark. ``before``: ids of the part in its earlier segments."""
    words, blocks, escapes, escaped = encode(ids)
    lengths = np.asarray(counts, np.uint64) | np.array([NULL_ID if d is None else 0 for d in doc_ids], np.uint64)
    head = np.array([part, before, len(doc_ids), len(ids), len(blocks) - 1, len(words), len(escapes)], np.uint64)
    body = b"".join(np.ascontiguousarray(x).astype("<u8").tobytes() for x in (head, np.array([d or 0 for d in doc_ids], np.int64).view(np.uint64), lengths, blocks, escapes, escaped, words))
    return MAGIC + body + np.array([zlib.crc32(body)], "<u8").tobytes()


class Segment(NamedTuple):
    part: int
    before: int  # ids of the part in earlier segments
    doc_ids: list[int | None]
    counts: np.ndarray
    blocks: np.ndarray  # first word of each block, and their end
    escapes: np.ndarray
    escaped: np.ndarray
    words: np.ndarray

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``end``: only the blocks that hold them are decoded."""
        end = int(self.counts.sum()) if end is None else end
        if start >= end:
            return np.zeros(0, np.uint64)
        first, last = start // BLOCK, -(-end // BLOCK)
        a, b = np.searchsorted(self.escapes, [first * BLOCK, last * BLOCK])
        found = decode(self.words[int(self.blocks[first]) : int(self.blocks[last])], self.escapes[a:b].astype(np.int64) - first * BLOCK, self.escaped[a:b])
        if len(found) < end - first * BLOCK:
            raise ValueError(f"blocks {first} to {last} hold {len(found)} ids only")
        return found[start - first * BLOCK : end - first * BLOCK]


def read_segments(data: bytes | memoryview) -> Iterator[Segment]:
    """The segments of a file, checked but not decoded yet; damage raises ValueError."""
    at, data = 0, memoryview(data)
    while at < len(data):
        if bytes(data[at : at + 8]) != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        part, before, docs, n, blocks, n_words, n_escapes = (int(x) for x in np.frombuffer(data, "<u8", HEADER_WORDS - 1, at + 8))
        size = 8 * (HEADER_WORDS - 1 + 2 * docs + blocks + 1 + 2 * n_escapes + n_words)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(body) != np.frombuffer(data, "<u8", 1, at + 8 + size)[0]:
            raise ValueError(f"damaged segment at byte {at}")
        _, names, lengths, offsets, escapes, escaped, words = np.split(np.frombuffer(body, "<u8"), np.cumsum([HEADER_WORDS - 1, docs, docs, blocks + 1, n_escapes, n_escapes]))
        null = lengths >> np.uint64(63) != 0
        doc_ids = [None if z else d for d, z in zip(names.astype(np.uint64).view(np.int64).tolist(), null.tolist())]
        counts = (lengths & np.uint64(NULL_ID - 1)).astype(np.int64)
        if int(counts.sum()) != n:
            raise ValueError(f"segment at byte {at} counts {int(counts.sum())} ids, not {n}")
        yield Segment(part, before, doc_ids, counts, offsets, escapes, escaped, words)
        at += 8 + size + 8 + len(END)


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = tokens.DOCUMENT_END) -> None:
    """Write the ids of all documents, in ascending doc_id order (nulls first; ties by text), to files below ``path``.

    docs: columns doc_id and text, others are ignored. A null or empty text is the end id alone; repeated rows are written each; an empty
    table gives no segments. The number of range partitions follows the size that Spark knows of the input; a task holds one segment at a time,
    and files hold ``FILE_SEGMENTS`` of them at most, so both stay small however much a task has to write.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = common.input_bytes(rows)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // PART_BYTES), MOST_PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = tokens.encoder(tokenizer)

        def put() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            data = segment(part, before, [d for h in held for d in h[0]], np.concatenate([h[2] for h in held]), ids)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        held, n, before = [], 0, 0
        for batch in batches:
            for piece in common.slices(batch, "text", SLICE_BYTES):
                ids, counts = tokens.with_end(*encoder.ids(common.texts_of(piece.column("text"))), end_id)
                held.append((piece.column("doc_id").to_pylist(), ids, counts))
                n += len(ids)
                if n >= SEGMENT_IDS:
                    yield put()
                    held, n, before = [], 0, before + n
        if held:
            yield put()
        held.clear()
        common.release()

    # rows of one doc_id, nulls among them, may fill several ranges, told apart by how their texts begin
    sorted_ = rows.repartitionByRange(parts, "doc_id", F.substring("text", 1, KEY_CHARS)).sortWithinPartitions("doc_id", "text")
    segments = sorted_.mapInArrow(run, "segment binary")
    # the cast keeps the bytes as they are, and so does the text writer
    segments.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", END.decode("ascii")).option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, n_before (ids before it in its part), n_tokens and ids_crc32 of every document in the files.

    One row per document written, with repeats and null doc_ids; files without segments give no rows; damage fails. A file is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in read_segments(content.as_buffer()):
                    starts = np.cumsum(found.counts) - found.counts
                    data = memoryview(found.ids().astype("<u4").tobytes())
                    crcs = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), found.counts.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array([found.part] * len(crcs), pa.int64()), pa.array(found.doc_ids, pa.int64()), pa.array(starts + found.before, pa.int64()), pa.array(found.counts, pa.int64()), pa.array(crcs, pa.int64())], ["part", "doc_id", "n_before", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "part bigint, doc_id bigint, n_before bigint, n_tokens bigint, ids_crc32 bigint")


def ids_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for, a row for each time that they were written. Only the blocks that hold them are decoded.

    Documents of null or empty texts have the end id alone; ids that were not written, and files without segments, give no rows.
    """
    wanted = frozenset(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for found in read_segments(content.as_buffer()):
                    starts = np.cumsum(found.counts) - found.counts
                    for i, doc_id in enumerate(found.doc_ids):
                        if doc_id in wanted:
                            ids = found.ids(int(starts[i]), int(starts[i] + found.counts[i]))
                            yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files below ``path``.

    One row per document, repeated rows included; no files give no rows. The parts' totals
    are ``MOST_PARTS`` at most and their running sum is taken over those alone.
    """
    rows = common.materialize(read(spark, path), "token-index")
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(totals):
        before.append((part, at))
        at += totals[part]
    starts = spark.createDataFrame(before, "part bigint, base bigint")
    joined = rows.join(starts, "part")
    return joined.select("doc_id", (F.col("base") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32")


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-ids")
    write(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path("byte_bpe_50k.json"))
    return index(spark, path)
