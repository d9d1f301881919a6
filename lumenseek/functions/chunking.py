"""Cutting contents into overlapping line windows, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window and overlap in lines, cut of a window's text in bytes, and the sizes of files that are cut at all.
WINDOW_LINES = 20
OVERLAP_LINES = 4
STEP_LINES = WINDOW_LINES - OVERLAP_LINES
MOST_CHUNK_BYTES = 1000
LEAST_FILE_BYTES = 16
MOST_FILE_BYTES = 1_000_000
SNIFFED_BYTES = 8192


def looks_binary(content: Column) -> Column:
    """A NUL among the first bytes."""
    return F.contains(F.substring(content.cast("binary"), 1, SNIFFED_BYTES), F.lit(b"\0"))


def is_chunkable(content: Column) -> Column:
    """Text of a size that is cut; the content of others counts as known but has no chunks."""
    content = content.cast("binary")
    fits = F.octet_length(content).between(LEAST_FILE_BYTES, MOST_FILE_BYTES)
    return F.coalesce(fits & ~looks_binary(content) & F.is_valid_utf8(content.cast("string")), F.lit(False))


def lines(text: Column) -> Column:
    """Lines between line feeds; carriage returns stay, and a last line feed begins no line."""
    split = F.split(text, "\n", -1)
    ended = (F.element_at(split, -1) == "") & (F.size(split) > 1)
    return F.when(ended, F.slice(split, F.lit(1), F.size(split) - 1)).otherwise(split)


def cut_bytes(text: Column, most: int = MOST_CHUNK_BYTES) -> Column:
    """The text's first ``most`` bytes or up to three fewer, whichever end with a whole character."""
    content = text.cast("binary")
    return F.coalesce(*(F.try_validate_utf8(F.substring(content, 1, most - k).cast("string")) for k in range(4)))


def last_window(n: Column) -> Column:
    """Number, from 0, of the last window of n lines."""
    return F.greatest(F.lit(0), F.ceil((n - WINDOW_LINES) / STEP_LINES)).cast("int")


def chunk_count(content: Column) -> Column:
    """How many rows ``with_chunks`` makes of a content."""
    n = F.size(lines(content.cast("binary").cast("string")))
    return F.when(is_chunkable(content), last_window(n) + 1).otherwise(0).cast("bigint")


def windows(line_array: Column) -> Column:
    """Array of (start_line, end_line, text) of all windows; lines count from 1, ends are inclusive."""
    n = F.size(line_array)
    count = last_window(n)

    def window(k: Column) -> Column:
        first = k * STEP_LINES
        end = F.least(first + WINDOW_LINES, n)
        body = F.array_join(F.slice(line_array, first + 1, end - first), "\n")
        return F.struct((first + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"), cut_bytes(body).alias("text"))

    return F.transform(F.sequence(F.lit(0), count), window)


def with_chunks(blobs: DataFrame, content: str = "content") -> DataFrame:
    """One row per window of each blob, with all columns but the content, plus chunk_idx, start_line, end_line and text.

    Null contents, contents that are too short or too long, binary or not UTF-8 have no rows.
    """
    kept = [c for c in blobs.columns if c not in (content, "chunk_idx", "start_line", "end_line", "text")]
    text = blobs.where(is_chunkable(F.col(content))).withColumn("__lines", lines(F.col(content).cast("binary").cast("string")))
    cut = text.select(*kept, F.posexplode(windows(F.col("__lines"))).alias("chunk_idx", "chunk"))
    return cut.select(*kept, "chunk_idx", "chunk.start_line", "chunk.end_line", "chunk.text")
