"""What people and programs read: hits, progress, statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the messages below, which other programs read.
HIT_FIELDS = ("path", "start_line", "end_line", "score", "blob_sha", "chunk_idx")


def hit_text() -> Column:
    """Score with four decimals, path and line range."""
    return F.format_string("%.4f  %s:%d-%d", F.col("score").cast("double"), F.col("path"), F.col("start_line"), F.col("end_line"))


def hit_json() -> Column:
    return F.to_json(F.struct(*HIT_FIELDS))


def hits_document(hits: Iterable[Mapping]) -> str:
    """A pretty JSON array in the order of the hits."""
    return json.dumps([{f: h[f] for f in HIT_FIELDS} for h in hits], indent=2, ensure_ascii=False)


def progress(chunks: int, new_blobs: int, cached: int, total: int) -> str:
    share = min(cached * 100, 2**64 - 1) // total if total else 100
    return f"indexing: cache contains {cached}/{total} blobs ({share}%); embedding {chunks} new chunk{'' if chunks == 1 else 's'} from {new_blobs} blob{'' if new_blobs == 1 else 's'}..."


def backend_line(model: str, batch: int) -> str:
    return f"[embed] {model} \u00b7 batch {batch}"


def groups_line(chunks: int, blobs: int, most: int) -> str:
    return f"[index] embedding {chunks} chunks across {blobs} unique blobs in groups of \u2264{most}..."


def group_line(groups: int, chunks: int) -> str:
    return f"[index] ... group {groups} done ({chunks} chunks total)"


def percent_line(done: int, total: int) -> str:
    return f"indexing: {done}/{total} chunks ({min(100.0, done / total * 100 if total else 100.0):.0f}%)"


def stats_line(s: Mapping) -> str:
    return f"files: {s['files_total']} | blobs: {s['blobs_unique']} unique, {s['blobs_already_cached']} cached, {s['blobs_embedded']} embedded, {s['blobs_skipped']} skipped | chunks embedded: {s['chunks_embedded']} | {s['elapsed_ms']}ms"


def store_report(s: Mapping, backend: str = "auto") -> str:
    return "\n".join(
        [
            f"store:    {s['location']}",
            f"model:    {s['model']} (backend: {backend})",
            f"dim:      {s['dim']}",
            f"files:    {s['files']} tracked (textual)",
            f"chunks:   {s['chunks']} current cached",
            f"blobs:    {s['blobs_cached']}/{s['blobs_current']} current cached ({s['entries']} total cache entries)",
            f"payload:  {s['payload_bytes'] / 1e6:.1f} MB current cached (uncompressed)",
        ]
    )
