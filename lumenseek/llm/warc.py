"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own. Spark's text writer puts the members out with an empty gzip member as its line separator,
so the files are ordinary ``.warc.gz`` data in any store that Spark writes to. The reader checks every
member and record; after a failed check it searches for the next valid member or version line, goes on there,
and logs the bytes between as quarantined. It does so inside members too: a member that is sound loses only those of its records that are not,
and of one that is cut short or fails its checksum the records before the damage count, if their own digests hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common

LEAST_REVISIT_BYTES = 1000
ROW_BYTES = 4 << 20
ROWS_PER_FILE = 12
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the formats.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER_START = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_CHUNK, _STEP = 1 << 16, 64
_NAMESPACE = uuid.UUID("9d7c1f5e-0d0b-4a53-8a1c-5f3a0c1b2e77")


class Record(NamedTuple):
    start: int
    end: int
    headers: dict[str, str]  # names in lower case
    block: bytes


class Gap(NamedTuple):
    """Quarantined bytes of the file, or, with ``inner``, of the content of the member that lies there. Records that were read before a member's damage lie in its gap."""

    start: int
    end: int
    reason: str
    inner: tuple[int, int] | None = None


def _line(value: str) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str = DATE) -> bytes:
    """The bytes of one record. ``digest``: hex SHA-1 of the payload, of which a revisit holds the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    headers = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url) if url else f'urn:page:{page_id}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        headers.append(f"X-Page-ID: {page_id}")
    if is_revisit:
        headers += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            headers.append(f"X-Refers-To-Page-ID: {refers_to}")
    return VERSION + b"\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: The version line, and what ends a header or, before that, shows that it has no end.
_BEGIN = re.compile(rb"WARC/1\.[01](?=\r?\n)")
_STOP = re.compile(rb"(\r\n\r\n)|\nWARC/1\.[01]\r?\n")


def sha1_of(told: str) -> str | None:
    """The hex SHA-1 of a digest header, whose value may be in base 32 or hex of either case; null for other digests and damaged ones."""
    kind, _, value = told.strip().partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def _parse(data: memoryview, at: int) -> tuple[dict[str, str], bytes, int, bool]:
    """Headers, block and end of the record at ``at``, and whether its payload has the digest that it tells; a failed check raises ValueError."""
    version = _BEGIN.match(data, at)
    if not version:
        raise ValueError("no version line")
    stop = _STOP.search(data, version.end())
    if not stop or not stop[1]:
        raise ValueError("header has no end")
    headers: dict[str, str] = {}
    last = None
    for line in bytes(data[at : stop.start()]).split(b"\r\n")[1:]:
        if last is not None and line[:1] in (b" ", b"\t"):  # a folded line goes on
            headers[last] = f"{headers[last]} {line.strip().decode('utf-8', 'replace')}".strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        last = name.strip().decode("utf-8", "replace").lower()
        headers[last] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isdigit() or not length.isascii():
        raise ValueError("bad content length")
    begin = stop.end()
    end = begin + int(length)
    block = bytes(data[begin:end])
    if len(block) < int(length) or bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise ValueError("block cut short or not ended")
    told = sha1_of(headers.get("warc-payload-digest", "")) if headers.get("warc-type") == "response" else None
    if told and hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() != told:
        raise ValueError("payload digest differs")
    return headers, block, end + 4, bool(told)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content and the end of the gzip member at ``at``; or, with the reason, what could be read of a damaged one."""
    unpacker, out, to = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if to >= len(data):
                return b"".join(out), to, "member cut short"
            out.append(unpacker.decompress(data[to : to + _CHUNK]))
            to = min(to + _CHUNK, len(data))
    except zlib.error as e:
        return _readable(data, at, sum(map(len, out))), to, f"bad member: {e}"
    return b"".join(out), to - len(unpacker.unused_data), None


def _readable(data: memoryview, at: int, least: int) -> bytes:
    """What a damaged member's data hold up to the damage, in small steps and without the checksum; ``least`` bytes and more are known to be readable."""
    flags, to = data[at + 3], at + 10
    if flags & 4:
        to += 2 + int.from_bytes(data[to : to + 2], "little")
    for bit in (8, 16):  # name and comment
        if flags & bit:
            while to < len(data) and data[to]:
                to += 1
            to += 1
    to += 2 if flags & 2 else 0
    unpacker, out, n = zlib.decompressobj(-15), [], 0
    try:
        while not unpacker.eof and to < len(data):
            step = _CHUNK if n + 64 * _CHUNK < least else _STEP
            out.append(unpacker.decompress(data[to : to + step]))
            n += len(out[-1])
            to += step
    except zlib.error:
        pass
    return b"".join(out)


_NEXT = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[01]")
_NEXT_INSIDE = re.compile(rb"(?<=\n)WARC/1\.[01](?=\r?\n)")


def _inside(content: bytes, start: int, end: int) -> Iterator[Record | Gap]:
    """The records of a sound member, and a gap for each part of its content that is none."""
    view, at = memoryview(content), 0
    while at < len(content):
        try:
            headers, block, following, _ = _parse(view, at)
        except ValueError as e:
            reason, first = str(e), at
            for m in _NEXT_INSIDE.finditer(view, at + 1):
                try:
                    headers, block, following, _ = _parse(view, m.start())
                except ValueError:
                    continue
                at = m.start()
                break
            else:
                yield Gap(start, end, reason, (first, len(content)))
                return
            yield Gap(start, end, reason, (first, at))
        yield Record(start, end, headers, block)
        at = following


def _before_damage(content: bytes, start: int, end: int) -> Iterator[Record]:
    """The records that a damaged member holds before the damage: those whose digests hold and that another record follows."""
    view = memoryview(content)
    for m in re.finditer(rb"(?:\A|(?<=\n))WARC/1\.[01](?=\r?\n)", view):
        try:
            headers, block, following, proven = _parse(view, m.start())
        except ValueError:
            continue
        if proven and _BEGIN.match(view, following):
            yield Record(start, end, headers, block)


def _valid_at(data: memoryview, at: int) -> tuple[list[Record | Gap], int]:
    """The records of the member or the plain record at ``at``, with the member's inner gaps, and its end.

    ValueError if it is damaged, with the records before the damage as its second argument. What holds no record at all is no member.
    """
    if bytes(data[at : at + 3]) == MEMBER_START:
        content, end, damage = _inflate(data, at)
        if damage:
            raise ValueError(damage, list(_before_damage(content, at, end)))
        found = list(_inside(content, at, end))
        if content and not any(isinstance(x, Record) for x in found):
            raise ValueError(found[0].reason, [])
        return found, end
    headers, block, end, _ = _parse(data, at)
    return [Record(at, end, headers, block)], end


def salvage(data: bytes | memoryview) -> Iterator[Record | Gap]:
    """All valid records in order, and a ``Gap`` for each run of bytes that belongs to none. Offsets are those of the file."""
    data = memoryview(data)
    at = 0
    while at < len(data):
        try:
            records, end = _valid_at(data, at)
        except ValueError as e:
            reason, start = e.args[0], at
            yield from e.args[1] if len(e.args) > 1 else ()
            for m in _NEXT.finditer(data, at + 1):
                try:
                    records, end = _valid_at(data, m.start())
                except ValueError as inner:
                    if len(inner.args) > 1 and inner.args[1]:  # a damaged member, but one: what it lost has a gap of its own
                        records, end = [], m.start()
                    else:
                        continue
                at = m.start()
                break
            else:
                yield Gap(start, len(data), reason)
                return
            yield Gap(start, at, reason)
        yield from records
        at = end


def plan_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, digest and refers_to of the records that are revisits.

    The largest page_id of each digest is found by partial aggregation; only ids and digests are shuffled. Of rows that repeat that
    page_id too, all are responses; a null page_id is never the largest.
    """
    ids = pages.select("page_id", "digest").where(F.col("payload_bytes") >= least_bytes)
    largest = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 AND refers_to IS NOT NULL").drop("copies")
    return ids.join(largest, "digest").where("page_id IS NULL OR page_id < refers_to").distinct().select("page_id", "digest", "refers_to")


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (UTF-8; null html is empty), payload_bytes and digest (hex SHA-1)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha1(payload).alias("digest"))


def write(pages: DataFrame, path: str, *, least_bytes: int = LEAST_REVISIT_BYTES) -> None:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are ignored) to files below ``path``.

    Of equal payloads of ``least_bytes`` or more the one with the largest page_id is a response and the others are revisits
    of it; smaller payloads, null and empty ones included, are all responses. A null page_id is told by no header; an empty table gives no records. Files hold at most ``ROWS_PER_FILE`` rows of about ``ROW_BYTES``.
    """
    rows = with_digests(pages)
    revisits = common.materialize(plan_revisits(rows, least_bytes), "revisits").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to", F.lit(True).alias("is_revisit"))
    planned = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to, is_revisit = (batch.column(k)[i].as_py() for k in range(6))
                held.append(member(record(page_id, url, payload, digest, refers_to, bool(is_revisit))))
                size += len(held[-1])
                if size >= ROW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["members"])

    members = planned.select("page_id", "url", "payload", "digest", "refers_to", "is_revisit").mapInArrow(run, "members binary")
    # the cast keeps the bytes as they are, and so does the text writer
    writer = members.select(F.col("members").cast("string").alias("value")).write
    writer.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _number(told: str | None) -> int | None:
    """A header's whole number of 64 bits; null for anything else."""
    if told is None or not re.fullmatch(r"-?[0-9]{1,19}", told):
        return None
    return n if -(1 << 63) <= (n := int(told)) < 1 << 63 else None


def read(spark: SparkSession, path: str, *, with_payload: bool = False, whole: bool = False) -> DataFrame:
    """One row per valid record of the files below ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, for a revisit as its headers tell them; ids and digests in
    another form than this writer's are null. Damaged parts are skipped, see ``gaps``, or, with ``whole``, end the query.
    Records without a page id have a null one, repeated records are told each, and files without records give no rows. A file is held whole.
    """
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload

    def row(found: Record) -> tuple:
        http, _, payload = found.block.partition(b"\r\n\r\n")
        kind = found.headers.get("warc-type", "")
        if kind == "response":
            n, digest = len(payload), hashlib.sha1(payload).hexdigest()
        else:
            told = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
            n = _number(told[1].decode()) if told else None
            digest = sha1_of(found.headers.get("warc-payload-digest", ""))
        ids = [_number(found.headers.get(x)) for x in ("x-page-id", "x-refers-to-page-id")]
        return (ids[0], found.headers.get("warc-target-uri"), kind, n, digest, ids[1], *([payload] if with_payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
        for batch in batches:
            for content in batch.column(1):
                held, size = [], 0
                for found in salvage(content.as_buffer()):
                    if whole and isinstance(found, Gap):
                        raise ValueError(f"bytes {found.start} to {found.end} of an archive: {found.reason}")
                    if isinstance(found, Record):
                        held.append(row(found))
                        size += len(found.block)
                        if size > ROW_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return _files(spark, path).mapInArrow(run, schema)


def gaps(spark: SparkSession, path: str) -> DataFrame:
    """file, start, end and reason of every quarantined run of bytes in the files below ``path``; no rows if all is sound or there is no file.

    inner_start and inner_end: where in the content of the sound member from start to end the bytes lie; null for bytes of the file itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = [g for g in salvage(content.as_buffer()) if isinstance(g, Gap)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([g.start for g in found], pa.int64()), pa.array([g.end for g in found], pa.int64()), pa.array([g.reason for g in found], pa.string()), *(pa.array([g.inner[k] if g.inner else None for g in found], pa.int64()) for k in (0, 1))], ["file", "start", "end", "reason", "inner_start", "inner_end"])

    return _files(spark, path).mapInArrow(run, "file string, start bigint, end bigint, reason string, inner_start bigint, inner_end bigint")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    return read(spark, path, whole=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS top FROM q WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, q.payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
