"""Threshold-scaled sketches of documents.

A document's set is its distinct 5-word shingles (words between white space, A-Z folded; fewer words: the whole sequence as one). Its
sketch keeps the 48-bit hash of every shingle that is below a fixed fraction of all hashes, so a long document has a long sketch, and two sketches
tell how much of the smaller set the larger one contains however unequal they are. Texts of few shingles would often keep none; so the
``LEAST`` least hashes are kept in any case. The sketch of a union is the merge of the sketches.

The query also needs each document's successor in the descending order of ids. Texts are dealt to ranges of ids, once, and sorted
there; a task meets successors side by side and hands on the first and the last document of its range. Only those, one pair a range,
are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenseek.llm import common, words

SHINGLE = 5
HASH_BYTES = 6
#: Hashes below this share of all are kept: 1 / FRACTION.
FRACTION = 16
LEAST = 40
_SHIFT = np.uint64(64 - 8 * HASH_BYTES)
_BELOW = np.uint64((1 << 8 * HASH_BYTES) // FRACTION)
#: Text that a worker turns into shingles at once.
SLICE_BYTES = 400_000
#: Compressed bytes of a range of documents; ranges are MOST_RANGES at most and grow beyond that.
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ROWS = "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, place int, end string, text string"


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The kept ones of a set's distinct shingle hashes (64 bits), ascending."""
    values = words.distinct(hashes >> _SHIFT)
    return values[: max(LEAST, int(np.searchsorted(values, _BELOW)))]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets, from their sketches."""
    values = words.distinct(np.concatenate((a, b)))
    return values[: max(LEAST, int(np.searchsorted(values, _BELOW)))]


def _told(a: np.ndarray) -> int:
    """Below this every hash of the set is in the sketch."""
    return 1 << 64 if len(a) < LEAST else max(int(_BELOW), int(a[-1]) + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller set that the larger one contains, told by the hashes that both sketches must hold.

    1 for equal sketches, empty ones included; 0 if only one is empty. Exact where both sets have fewer than ``LEAST`` shingles.
    """
    if len(a) == len(b) and (a == b).all():
        return 1.0
    bound = min(_told(a), _told(b))
    if bound < 1 << 64:
        a, b = (x[: np.searchsorted(x, np.uint64(bound))] for x in (a, b))
    least = min(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / least if least else 0.0


def sketches(column: pa.Array) -> list[np.ndarray]:
    """The sketch of each text; null is the empty text."""
    found = words.of(column, words.BLACK)
    hashes, _ = words.grams(found, SHINGLE)
    out = []
    for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(sketch(hashes[a : b - SHINGLE + 1]))
        elif b > a:
            short = words.Words(found.hashes[a:b], np.array([0, b - a]))
            out.append(sketch(words.mix(words.grams(short, b - a)[0][:1] + np.uint64(b - a))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pack(a: np.ndarray) -> bytes:
    """The hashes in ascending order, HASH_BYTES each, the high byte first."""
    return a.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def unpack(data: bytes) -> np.ndarray:
    found = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    found[:, 8 - HASH_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return found.view(">u8").ravel().astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last third of the code points, rounded down, replaced by the first as many, or all, of the next document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _finish(firsts: list[tuple], nexts: list[tuple]) -> list[list]:
    """Result columns of documents (doc_id, text, sketch), each with its successor."""
    changed = [edited(a[1], b[1]) for a, b in zip(firsts, nexts)]
    theirs = []
    at = 0
    while at < len(changed):  # bounded bytes at once
        to, size = at, 0
        while to < len(changed) and (to == at or size < SLICE_BYTES):
            size += len(changed[to])
            to += 1
        theirs += sketches(pa.array(changed[at:to], pa.string()))
        at = to
    return [
        [a[0] for a in firsts],
        [len(a[1]) for a in firsts],
        [hashlib.sha256(t.encode()).digest() for t in changed],
        [pack(a[2]) for a in firsts],
        [pack(x) for x in theirs],
        [likeness(a[2], x) for a, x in zip(firsts, theirs)],
        [likeness(a[2], b[2]) for a, b in zip(firsts, nexts)],
    ]


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _batch(done: list[list], ends: list[tuple]) -> pa.RecordBatch:
    """Finished rows, then the ends of a range: (doc_id, sketch, place, end, text)."""
    n, m = len(done[0]) if done else 0, len(ends)
    columns = [*(done or [[]] * 7), [None] * n, [None] * n, [None] * n]
    more = [[e[0] for e in ends], [None] * m, [None] * m, [pack(e[1]) for e in ends], [None] * m, [None] * m, [None] * m, [e[2] for e in ends], [e[3] for e in ends], [e[4] for e in ends]]
    return pa.RecordBatch.from_arrays([pa.array([*a, *b], t) for a, b, t in zip(columns, more, _types())], _NAMES)


def with_next(docs: DataFrame) -> DataFrame:
    """The digest of every document and of its edited text, as ``SCHEMA``, fingerprints in hex.

    docs: doc_id and text, other columns are ignored. Null texts are empty. The order is doc_id descending, null last; rows of one doc_id stand in the order of their
    texts' hashes and texts, so repeated rows follow each other. After the last comes the first; a single document follows itself. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a range may end within the rows of one doc_id, and within copies of one row, which are the same whichever comes first
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("m", F.monotonically_increasing_id())
    order = [F.desc_nulls_last("doc_id"), F.asc("h")]
    ranges = max(1, min(MOST_RANGES, -(-common.input_bytes(docs) // RANGE_BYTES)))
    dealt = rows.repartitionByRange(ranges, *order, F.asc("m")).sortWithinPartitions(*order, F.asc("text")).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() if TaskContext.get() else 0
        held = None
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                texts = common.texts_of(part.column("text"))
                found = list(zip(part.column("doc_id").to_pylist(), texts, sketches(part.column("text"))))
                ends = []
                if held is None:
                    ends.append((found[0][0], found[0][2], place, "first", found[0][1]))
                else:
                    found.insert(0, held)
                held = found[-1]
                yield _batch(_finish(found[:-1], found[1:]) if len(found) > 1 else [], ends)
        if held is not None:
            yield _batch([], [(held[0], held[2], place, "last", held[1])])
        common.release()

    told = common.materialize(dealt.mapInArrow(run, _ROWS), "fingerprints")
    ends = told.where("place IS NOT NULL").select("doc_id", "fingerprint", "place", "end", "text")
    # ranges may be empty: numbers of those that are not, as few as there are tasks
    places = sorted(r["place"] for r in ends.where("end = 'last'").select("place").collect())
    after = dict(zip(places, [*places[1:], *places[:1]]))
    turn = docs.sparkSession.createDataFrame([(p, q) for p, q in after.items()], "place int, following int")
    lasts = ends.where("end = 'last'").join(F.broadcast(turn), "place").select(F.col("following").alias("place"), "doc_id", "text", "fingerprint")
    firsts = ends.where("end = 'first'").select("place", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine, other = (row["doc_id"], row["text"], unpack(row["fingerprint"])), (None, row["next_text"], unpack(row["next_fingerprint"]))
                yield _batch(_finish([mine], [other]), [])

    closed = lasts.join(firsts, "place").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(close, _ROWS)
    every = told.where("place IS NULL").union(closed)
    hexed = [F.lower(F.hex(c)).alias(c) if c.endswith(("fingerprint", "sha256")) else F.col(c) for c in _NAMES[:7]]
    return every.select(*hexed)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and sketch (its hashes, as numbers) of every row of ``docs``; null texts are empty and have empty sketches. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                found = [s.astype(np.int64) for s in sketches(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, sketch array<bigint>")


def merged(sketched: DataFrame, by: str) -> DataFrame:
    """The sketch of each group's union (columns ``by`` and sketch), as rows of ``by`` and x: a sketch grows with its group, so it is not one value.

    The hashes below the fraction all stay; of the others the least few, ranked only as far as ``LEAST`` go. Groups of empty sketches have no rows.
    """
    each = sketched.select(by, F.explode("sketch").alias("x")).distinct()
    below = F.col("x") < int(_BELOW)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("x"))
    rest = each.where(~below).withColumn("rank", rank).where(F.col("rank") <= LEAST)
    short = each.groupBy(by).agg(F.count_if(below).alias("n")).where(F.col("n") < LEAST).withColumnRenamed(by, "__by")
    more = rest.join(short, F.col(by).eqNullSafe(F.col("__by"))).where(F.col("rank") + F.col("n") <= LEAST)
    return each.where(below).union(more.select(by, "x"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(common.table(spark, sf_dir, "documents"))
