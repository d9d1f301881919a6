"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive words, ``WINDOW - GRAM + 1`` word grams begin within; the one of least hash is the
window's fingerprint. Equal windows have equal fingerprints at equal places, so any span of ``WINDOW`` words that a
document shares with a benchmark item is found: its fingerprint lies in both. The documents' fingerprints are
joined with the benchmark's, and each hit is extended to the windows around it, which are compared by two independent 64-bit hashes
of all their words. Items shorter than a window are looked up as one gram of their own length.

A benchmark of up to ``BLOCK_BYTES`` of text is broadcast to the tasks that read the documents. Of a larger one a bitmap of all fingerprints, of
a fixed size, goes along that single scan; only the documents with a fingerprint in it meet the blocks of the benchmark, one after the other.
So what is broadcast at a time is bounded however large the benchmark is, and the documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common, words

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap that stands for a benchmark of several blocks, and bytes of its parts.
FILTER_BITS = 27
FILTER_PART = 4096


class Index(NamedTuple):
    """One block of the benchmark."""

    fingerprints: np.ndarray  # sorted gram hashes
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted window hashes, their second hashes, where their items begin, items' numbers
    names: list[str]


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Places of the least gram (the last of equals) of every ``width`` consecutive grams; ``valid``: they may end here."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        other = grams[j : j + n]
        lower = other <= best
        np.copyto(best, other, where=lower)
        np.copyto(place, np.arange(j, j + n), where=lower)
    chosen = np.zeros(len(grams), bool)
    chosen[place[valid[width - 1 :]]] = True
    return np.flatnonzero(chosen)


def build(names: list[str], texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> Index:
    found = words.of(pa.array([t or "" for t in texts], pa.string()))
    hashes, valid = words.grams(found, gram)
    rows, counts = found.rows, found.counts
    width = window - gram + 1
    places = winnow(hashes, _row_windows(valid, rows, width), width)
    windows = {}
    for length in {window, *counts[(counts > 0) & (counts < window)].tolist()}:
        inside, whole = words.grams(found, length)
        at = np.flatnonzero(whole & ((length == window) | (np.repeat(counts, counts) == length)))
        pairs = np.unique(np.rec.fromarrays([inside[at], _checks(found, at, length), rows[at]], names="hash,check,item"))
        if len(pairs):
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs["hash"][1:] != pairs["hash"][:-1]) | (pairs["check"][1:] != pairs["check"][:-1])
            first = np.flatnonzero(new)
            windows[length] = pairs["hash"][first], pairs["check"][first], np.append(first, len(pairs)), np.ascontiguousarray(pairs["item"])
    return Index(words.distinct(hashes[places]), windows, names)


def _checks(found: words.Words, places: np.ndarray, k: int) -> np.ndarray:
    """Second hashes of the k words from each place on."""
    if not len(places):
        return np.zeros(0, np.uint64)
    wanted, inverse = np.unique(places[:, None] + np.arange(k), return_inverse=True)
    second = words.range_hashes(found.folded, found.starts[wanted], found.ends[wanted], words.CHECK)
    flat = words.Words(second[inverse.ravel()], np.arange(len(places) + 1) * k)
    return words.grams(flat, k)[0][::k]


def _row_windows(valid: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """valid, but False too where the gram ``width - 1`` places before belongs to another row."""
    if len(valid) < width:
        return np.zeros(len(valid), bool)
    out = valid.copy()
    if width > 1:
        out[: width - 1] = False
        out[width - 1 :] &= rows[width - 1 :] == rows[: len(rows) - width + 1]
    return out


def _among(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, values), max(0, len(sorted_values) - 1))
    return sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)


def _equal_windows(index: Index, found: words.Words, places: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a window of the index begins, and that window's number."""
    first, second, *_ = index.windows[length]
    likely = _among(first, hashes)
    places, hashes = places[likely], hashes[likely]
    checks = _checks(found, places, length)
    at, out = np.searchsorted(first, hashes), []
    left = np.arange(len(places))
    while len(left):  # once, but for windows of equal first hashes
        same = second[at[left]] == checks[left]
        out.append((places[left[same]], at[left[same]]))
        at[left] += 1
        left = left[~same & (at[left] < len(first))]
        left = left[first[at[left]] == hashes[left]]
    return (np.concatenate([p for p, _ in out]), np.concatenate([k for _, k in out])) if out else (places, at)


def hits(column: pa.Array, index: Index, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, list[tuple[int, int, int]], dict[int, set[int]]]:
    """Word counts of the rows, hit spans (row, first word, end) and the numbers of the items that each row holds windows of."""
    found = words.of(column)
    n = len(found.hashes)
    marks = np.zeros(n + 1, np.int64)
    rows = found.rows
    items: dict[int, set[int]] = {}

    def mark(places: np.ndarray, at: np.ndarray, length: int) -> None:
        np.add.at(marks, places, 1)
        np.add.at(marks, places + length, -1)
        _, _, first, owners = index.windows[length]
        for row, k in set(zip(rows[places].tolist(), at.tolist())):
            items.setdefault(row, set()).update(owners[first[k] : first[k + 1]].tolist())

    if window in index.windows and n:
        hashes, valid = words.grams(found, gram)
        width = window - gram + 1
        places = winnow(hashes, _row_windows(valid, rows, width), width)
        shared = _among(index.fingerprints, hashes[places])
        around = words.distinct((places[shared][:, None] - np.arange(width)).ravel())
        around = around[around >= 0]
        around = around[around + window <= np.repeat(found.bounds[1:], found.counts)[around]]
        mark(*_equal_windows(index, found, around, _gram_at(found, around, window), window), window)
    for length in index.windows:
        if length < window and n:
            own, valid = words.grams(found, length)
            places = np.flatnonzero(valid)
            mark(*_equal_windows(index, found, places, own[places], length), length)
    spans = []
    if items:
        inside = np.cumsum(marks[:-1]) > 0
        for row in sorted(items):
            a, b = int(found.bounds[row]), int(found.bounds[row + 1])
            edges = np.flatnonzero(np.diff(np.concatenate(([0], inside[a:b].astype(np.int8), [0]))))
            spans += [(row, int(s), int(e)) for s, e in zip(edges[::2], edges[1::2])]
    return found.counts, spans, items


def _gram_at(found: words.Words, places: np.ndarray, k: int) -> np.ndarray:
    """The hashes that ``words.grams`` gives, at some places only."""
    parts = found.hashes[places[:, None] + np.arange(k)] if len(places) else np.zeros((0, k), np.uint64)
    flat = words.Words(parts.ravel(), np.arange(len(places) + 1) * k)
    return words.grams(flat, k)[0][::k]


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return -(-size // block_bytes) or 1


def block(benchmark: DataFrame, number: int, of: int) -> Index:
    """The index over a block of the items: all items are dealt to the blocks by their content. An item without an id is called ``null``."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("string").alias("text"))
    rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(of)) == number).toArrow()
    return build(rows["name"].to_pylist(), rows["text"].to_pylist())


class Filter(NamedTuple):
    """Which fingerprints and short items' grams a whole benchmark has: a bitmap by the top FILTER_BITS of their hashes, and the short items' lengths."""

    bits: np.ndarray
    lengths: tuple[int, ...]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - FILTER_BITS)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def suspects(self, column: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Word counts of the rows, and which rows have a fingerprint or gram that the benchmark may have."""
        found = words.of(column)
        out = np.zeros(len(column), bool)
        if len(found.hashes):
            hashes, valid = words.grams(found, gram)
            width = window - gram + 1
            places = winnow(hashes, _row_windows(valid, found.rows, width), width)
            out[found.rows[places[self.holds(hashes[places])]]] = True
            for length in self.lengths:
                own, valid = words.grams(found, length)
                out[found.rows[valid & self.holds(own)]] = True
        return found.counts, out


def filter_of(benchmark: DataFrame) -> Filter:
    """The bitmap is filled by the tasks in parts of ``FILTER_PART`` bytes, and the driver gets each part once: ``2**FILTER_BITS`` bits in all."""
    parts = (1 << FILTER_BITS) // 8 // FILTER_PART

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = np.zeros((parts, FILTER_PART), np.uint8), set()
        for batch in batches:
            for piece in common.slices(batch, "text"):
                index = build([""] * piece.num_rows, piece.column("text").to_pylist())
                lengths.update(k for k in index.windows if k < WINDOW)
                for hashes in (index.fingerprints, *(index.windows[k][0] for k in index.windows if k < WINDOW)):
                    place = hashes >> np.uint64(64 - FILTER_BITS)
                    np.bitwise_or.at(bits.reshape(-1), (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        full = np.flatnonzero(bits.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([bits[i].tobytes() for i in full], pa.binary()), pa.array([sorted(lengths)] * len(full), pa.list_(pa.int64()))], ["part", "bits", "lengths"])
        common.release()

    def unite(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce(np.array([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")]))
        lengths = sorted({k for found in table.column("lengths").to_pylist() for k in found})
        return pa.table([pa.array([table.column("part")[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary()), pa.array([lengths], pa.list_(pa.int64()))], ["part", "bits", "lengths"])

    schema = "part bigint, bits binary, lengths array<bigint>"
    filled = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(fill, schema)
    bits, lengths = np.zeros((parts, FILTER_PART), np.uint8), set()
    for row in filled.groupBy("part").applyInArrow(unite, schema).toLocalIterator():
        bits[row["part"]] = np.frombuffer(row["bits"], np.uint8)
        lengths.update(row["lengths"])
    return Filter(bits.reshape(-1), tuple(sorted(lengths)))


_FOUND = "doc_id bigint, text_key binary, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _search(docs: DataFrame, index: Index, *, all_rows: bool) -> DataFrame:
    """The hits of one block, for all rows or for those that have any; text_key: digest of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in common.slices(batch, "text", 2_000_000):
                counts, spans, items = hits(part.column("text"), index)
                by_row: dict[int, list] = {}
                for row, a, b in spans:
                    by_row.setdefault(row, []).append({"a": a, "b": b})
                which = list(range(part.num_rows)) if all_rows else sorted(items)
                picked = part.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        picked.column("doc_id"),
                        pa.array([hashlib.sha1((t or "").encode()).digest() for t in picked.column("text").to_pylist()], pa.binary()),
                        pa.array(counts[which], pa.int64()),
                        pa.array([by_row.get(r, []) for r in which], _SPANS),
                        pa.array([sorted({index.names[i] for i in items.get(r, ())}) for r in which], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_key", "n_words", "spans", "items"],
                )

    return docs.mapInArrow(run, _FOUND)


def _counted(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_words and, of rows that the filter does not clear, the text: one scan of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 2_000_000):
                counts, suspect = shared.value.suspects(part.column("text"))
                texts = pc.if_else(pa.array(suspect), part.column("text"), pa.scalar(None, part.column("text").type))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), texts], ["doc_id", "n_words", "text"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, text string")


def _merged(docs: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """The hits of all of n > 1 blocks. Only rows with hits meet, by doc_id and digest; repeated rows are told apart by neither and need not be."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(benchmark))
    counted = common.materialize(_counted(docs, shared), "counted")
    shared.destroy()
    suspects = counted.where("text IS NOT NULL").select("doc_id", "text")
    union = None
    for k in range(n):
        part = common.materialize(_search(suspects, block(benchmark, k, n), all_rows=False), "block-hits")
        union = part if union is None else union.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_set("spans")))
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<a:bigint,b:bigint>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (s["a"] <= F.element_at(out, -1)["b"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(out, F.array(s))),
    )
    hit = union.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(joined.alias("s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("i"))
    told = counted.select("doc_id", "n_words", F.unhex(F.sha1(F.col("text").cast("binary"))).alias("text_key"))
    both = told.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return both.select("doc_id", "n_words", F.coalesce("s", none).alias("spans"), F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit spans (word numbers, end exclusive).

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. Null texts have no words, and items without
    words hit nothing. Repeated rows are answered as often as they occur; an item_id that occurs several times is one
    item with the windows of all its rows. Empty tables give no rows or no hits.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    n = block_count(benchmark, block_bytes)
    found = _search(rows, block(benchmark, 0, 1), all_rows=True) if n == 1 else _merged(rows, benchmark, n)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["b"] - s["a"])
    items = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that share no window with any benchmark item.

    Rows with a null or wordless text stay, repeated rows stay or go together; an empty benchmark keeps all. With several blocks only the rows that the bitmap does
    not clear meet them, each block's survivors are written before the next is broadcast.
    """
    context, n = docs.sparkSession.sparkContext, block_count(benchmark, block_bytes)

    def without(rows: DataFrame, index: Index) -> tuple[DataFrame, object]:
        shared = context.broadcast(index)

        def clean(column: pa.Array) -> list[bool]:
            _, _, items = hits(column, shared.value)
            return [row not in items for row in range(len(column))]

        return common.filter_rows(rows, clean), shared

    if n == 1:
        return without(docs, block(benchmark, 0, 1))[0]
    told = context.broadcast(filter_of(benchmark))
    left = common.materialize(common.filter_rows(docs, lambda column: told.value.suspects(column)[1]), "suspects")
    for k in range(n):
        kept, shared = without(left, block(benchmark, k, n))
        left = common.materialize(kept, "suspects")
        shared.destroy()
    return common.filter_rows(docs, lambda column: ~told.value.suspects(column)[1]).union(left)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
found AS (SELECT r, dw.k, i, item FROM doc_windows dw JOIN item_windows iw ON dw.k = iw.k AND dw.g = iw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
