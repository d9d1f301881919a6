"""Cost-balanced packing of tokenized documents into training sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n**2`` (what attention over it takes).
Pieces, longest first, go to the sequence of lowest cost that still has room for them. Each task packs
its own rows in chunks of about ``chunk_tokens`` tokens, so there is no shuffle, memory is bounded, and
a lost task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, tokens

SEQUENCE_TOKENS = 4096
CHUNK_TOKENS = 1_000_000
LINEAR_COST = 1.0
QUADRATIC_COST = 1.0 / 2048
#: Sequence ids: the task's number in the high bits, a running number in the low ones.
TASK_SHIFT = 32

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
SCHEMA_WITH_IDS = SCHEMA + ", ids array<int>"


def assign(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST) -> list[tuple[int, int, int, int, int]]:
    """Place documents of the given token counts into ceil(total / capacity) sequences.

    Returns (document, start, length, sequence, offset) for each piece. A document longer than a sequence
    is first cut into whole sequences and a rest. The pieces, longest first (ties: in input order), go whole to
    the sequence of lowest cost (ties: lowest number) with enough room; if none has enough, as much as fits goes
    to the one with the most room and the remainder waits for its turn by length. So all sequences but one are full.
    """
    out: list[tuple[int, int, int, int, int]] = []
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    n = -(-total // capacity)
    room = np.full(n, capacity, np.int64)
    cost = np.zeros(n)
    full = 0
    rests: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by length
    for d, length in enumerate(lengths.tolist()):
        start = 0
        while length - start >= capacity:
            out.append((d, start, capacity, full, 0))
            room[full], cost[full] = 0, np.inf
            full, start = full + 1, start + capacity
        if length > start:
            rests[length - start].append((d, start))
    # the sequences that whole pieces have filled take no part any more
    free, price = room[full:], cost[full:]
    for length in range(capacity, 0, -1):
        waiting = rests[length]
        for d, start in waiting:  # a remainder is shorter, so it joins a later list
            s = int(np.where(free >= length, price, np.inf).argmin())
            part = length
            if free[s] < length:
                s = int(free.argmax())
                part = int(free[s])
                rests[length - part].append((d, start + part))
            out.append((d, start, part, full + s, capacity - int(free[s])))
            free[s] -= part
            price[s] += linear * part + quadratic * part * part
    return out


def pack(docs: DataFrame, tokenizer: str, *, sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = tokens.DOCUMENT_END, chunk_tokens: int = CHUNK_TOKENS, linear: float = LINEAR_COST, quadratic: float = QUADRATIC_COST, with_ids: bool = False, cached_words: int = tokens.CACHE_PIECES) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; with ``with_ids`` also its ids.

    docs: columns doc_id and text, others are ignored; ``cached_words`` trades a worker's memory (some 150 bytes a word) for time. A null or empty text is one end id. Repeated rows are
    packed as often as they occur, a null doc_id stays null; an empty table gives no rows. Only the last
    sequence of a chunk is not full; a reader pads it to ``sequence_tokens`` (no padding if its length is a power of two).
    """

    def chunk_rows(batch: list[tuple], base: int) -> pa.RecordBatch:
        doc_ids, arrays = [d for ids, _ in batch for d in ids], [a for _, flat in batch for a in flat]
        placed = assign(np.array([len(a) for a in arrays]), sequence_tokens, linear, quadratic)
        cols = list(zip(*placed))
        rows = [
            pa.array([doc_ids[d] for d in cols[0]], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
            pa.array([zlib.crc32(arrays[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in placed], pa.int64()),
            pa.array([len(arrays[d]) for d in cols[0]], pa.int64()),
            pa.array(np.array(cols[3], np.int64) + base), pa.array(cols[4], pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            rows.append(pa.array([arrays[d][s : s + n].astype(np.int32) for d, s, n, _, _ in placed], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << TASK_SHIFT
        encoder = tokens.encoder(tokenizer, cached_words)
        held, size = [], 0
        for batch in batches:
            for part in common.slices(batch, "text", 1_000_000):
                ids, counts = tokens.with_end(*encoder.ids(common.texts_of(part.column("text"))), end_id)
                held.append((part.column("doc_id").to_pylist(), list(tokens.pieces_of(ids, counts))))
                size += len(ids)
                if size >= chunk_tokens:
                    yield chunk_rows(held, base)
                    base += -(-size // sequence_tokens)
                    held, size = [], 0
        if size:
            yield chunk_rows(held, base)
        held.clear()
        common.release()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA_WITH_IDS if with_ids else SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"))
