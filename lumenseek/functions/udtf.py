"""Line windows as a table function, for SQL users: SELECT ... FROM blobs, LATERAL chunk_windows(content)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lumenseek.functions import chunking


@udtf(returnType="chunk_idx int, start_line int, end_line int, text string")
class ChunkWindows:
    """The rows that ``chunking.with_chunks`` gives for one content; none for null or what is not cut."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        if not chunking.LEAST_FILE_BYTES <= len(data) <= chunking.MOST_FILE_BYTES or b"\0" in data[: chunking.SNIFFED_BYTES]:
            return
        try:
            found = data.decode("utf-8").split("\n")
        except UnicodeDecodeError:
            return
        if len(found) > 1 and not found[-1]:
            found.pop()
        starts = range(0, max(1, len(found) - chunking.OVERLAP_LINES), chunking.STEP_LINES)
        for k, first in enumerate(starts):
            end = min(first + chunking.WINDOW_LINES, len(found))
            body = "\n".join(found[first:end]).encode()[: chunking.MOST_CHUNK_BYTES].decode("utf-8", "ignore")
            yield k, first + 1, end, body


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_windows", ChunkWindows)
