"""Binary formats for interchange: vector payloads, text corpora, vector dumps. All numbers are little-endian."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of the formats.
PAYLOAD_MAGIC = b"VGRP"
PAYLOAD_VERSION = 1
CORPUS_MAGIC = b"VGGCORP1"
_HEADER = struct.Struct("<4sHHI")


def payload_size(n, dim: int):
    return _HEADER.size + 8 * n + 4 * n * dim


def pack_payload(dim: int, ranges: list[tuple[int, int]], vectors) -> bytes:
    """Line ranges and vectors of one blob: header, then all ranges as u32, then all vectors as f32."""
    matrix = np.asarray(vectors, "<f4").reshape(len(ranges), dim)
    return _HEADER.pack(PAYLOAD_MAGIC, PAYLOAD_VERSION, dim, len(ranges)) + np.asarray(ranges, "<u4").tobytes() + matrix.tobytes()


def pack_payloads(dim: int, column: pa.ListArray) -> pa.BinaryArray:
    """The payload of each row's list of (chunk_idx, start_line, end_line, embedding); null counts as an empty list. All bytes are laid out by offsets, not row by row.

    An embedding of another length than ``dim`` is an error.
    """
    rows = column.flatten()
    sizes = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), np.float64)).astype(np.int64)
    vectors = rows.field("embedding")
    if len(rows) and (np.asarray(pc.list_value_length(vectors)) != dim).any():
        raise ValueError(f"expected vectors of {dim}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(rows), dim)
    ranges = np.stack((rows.field("start_line").to_numpy(), rows.field("end_line").to_numpy()), axis=1).astype("<u4")
    bounds = np.append(0, np.cumsum(payload_size(sizes, dim))).astype(np.int64)
    data = np.zeros(int(bounds[-1]), np.uint8)
    before = np.append(0, np.cumsum(sizes)).astype(np.int64)
    words = data.view("<u4")  # headers, ranges and vectors are all whole words
    starts = bounds[:-1] // 4
    head = np.frombuffer(_HEADER.pack(PAYLOAD_MAGIC, PAYLOAD_VERSION, dim, 0), "<u4")
    words[starts], words[starts + 1], words[starts + 2] = head[0], head[1], sizes
    place = np.arange(len(rows)) - np.repeat(before[:-1], sizes)
    first = np.repeat(starts + 3, sizes)
    words[(first + 2 * place)[:, None] + np.arange(2)] = ranges
    words[(first + 2 * np.repeat(sizes, sizes) + dim * place)[:, None] + np.arange(dim)] = flat.view("<u4")
    return pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def payload_rows(payload: bytes) -> int | None:
    """How many vectors the header tells; None if there is no header."""
    if len(payload) < _HEADER.size or payload[:4] != PAYLOAD_MAGIC:
        return None
    return _HEADER.unpack_from(payload)[3]


def payload_valid(payload: bytes, dim: int) -> bool:
    n = payload_rows(payload)
    return n is not None and _HEADER.unpack_from(payload)[1:3] == (PAYLOAD_VERSION, dim) and len(payload) == payload_size(n, dim)


def unpack_payload(payload: bytes) -> tuple[int, list[tuple[int, int]], np.ndarray]:
    n = payload_rows(payload)
    if n is None:
        raise ValueError("no payload header")
    _, version, dim, _ = _HEADER.unpack_from(payload)
    if version != PAYLOAD_VERSION:
        raise ValueError(f"payload version {version}, expected {PAYLOAD_VERSION}")
    if len(payload) != payload_size(n, dim):
        raise ValueError("payload has another length than its header tells")
    ranges = np.frombuffer(payload, "<u4", 2 * n, _HEADER.size).reshape(n, 2)
    vectors = np.frombuffer(payload, "<f4", n * dim, _HEADER.size + 8 * n).reshape(n, dim)
    return dim, [tuple(r) for r in ranges.tolist()], vectors


def pack_corpus(texts: list[str]) -> bytes:
    parts = [CORPUS_MAGIC, struct.pack("<Q", len(texts))]
    for text in texts:
        data = text.encode()
        parts += [struct.pack("<I", len(data)), data]
    return b"".join(parts)


def unpack_corpus(data: bytes) -> list[str]:
    if data[:8] != CORPUS_MAGIC:
        raise ValueError("not a corpus file")
    (n,), at, out = struct.unpack_from("<Q", data, 8), 16, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        body = data[at + 4 : at + 4 + size]
        if len(body) != size:
            raise ValueError("corpus file is cut short")
        out.append(body.decode())
        at += 4 + size
    return out


def pack_vectors(vectors, most: int = 256) -> bytes:
    """A dump of the first ``most`` vectors."""
    matrix = np.asarray(vectors, "<f4")[:most]
    return struct.pack("<II", matrix.shape[1], len(matrix)) + matrix.tobytes()


def unpack_vectors(data: bytes) -> np.ndarray:
    dim, n = struct.unpack_from("<II", data)
    return np.frombuffer(data, "<f4", n * dim, 8).reshape(n, dim)
