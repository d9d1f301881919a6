"""Baseline JPEG: lossless storage of bytes as DC-only images, and luminance thumbnails of any baseline image in numpy.

The reader parses the markers, Huffman-decodes the scan and keeps the DC coefficient of each 8x8 luminance block, whose mean it is:
a thumbnail at one eighth of the size. Every restart interval is decoded on its own, so the intervals
of all images of a batch that share their tables advance together, one block a step, as numpy vectors.

The writer stores a byte as a block of that one grey value, 192 blocks a row: with a DC quantiser of 8 and no AC coefficients the
thumbnail is the bytes again, exactly. Each row is a restart interval. What does not fit the largest image goes to further
images that follow in the same media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common

WIDTH = 192
#: Block rows of the largest image: its height has 16 bits.
MOST_ROWS = 65535 // 8
PAD = 32
#: Blocks decoded together, which bounds the memory.
LANE_BLOCKS = 3_000_000
#: Fixed values of the standard: counts of codes by length and their symbols (DC luminance; end of block alone).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = bytes(range(12))
AC_COUNTS = (1, *[0] * 15)
AC_SYMBOLS = b"\x00"


def codes(counts: tuple[int, ...] | bytes, symbols: bytes) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            yield symbols[k], code, length
            code, k = code + 1, k + 1
        code <<= 1


# -- writing --------------------------------------------------------------------------------------


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their count of a whole block by DC difference + 255: Huffman code, extra bits, end of block."""
    table = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
    bits, counts = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = table[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], counts[d + 255] = (code << size | extra) << 1, n + size + 1
    return bits, counts


_BLOCK_BITS, _BLOCK_COUNTS = _difference_codes()


def _header(rows: int, n_bytes: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xFE, b"bytes=%d" % n_bytes),
            segment(0xDB, b"\0" + bytes([8] + [1] * 63)),
            segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\1\x11\0"),
            segment(0xC4, b"\0" + bytes(DC_COUNTS) + DC_SYMBOLS),
            segment(0xC4, b"\x10" + bytes(AC_COUNTS) + AC_SYMBOLS),
            segment(0xDD, struct.pack(">H", WIDTH)),
            segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


def _images(samples: np.ndarray, rows: list[int], n_bytes: list[int]) -> list[bytes]:
    """One image for each count of rows, of the samples in order."""
    grid = samples.reshape(-1, WIDTH).astype(np.int16) - 128
    diff = grid.copy()
    diff[:, 1:] -= grid[:, :-1]
    index = diff + 255
    counts = _BLOCK_COUNTS[index]
    ends = np.cumsum(counts, axis=1)
    n_row = (ends[:, -1] + 7) >> 3
    first = np.cumsum(n_row) - n_row
    begin = (ends - counts) + (first << 3)[:, None]
    # each code of 15 bits or fewer lies within three bytes
    shifted = (_BLOCK_BITS[index].astype(np.int64) << (24 - (begin & 7) - counts)).ravel()
    at = (begin >> 3).ravel()
    total = int(n_row.sum())
    data = np.zeros(total + 2, np.int64)
    for k, part in enumerate((shifted >> 16, (shifted >> 8) & 255, shifted & 255)):
        data += np.bincount(at + k, part, total + 2).astype(np.int64)
    data = data[:total].astype(np.uint8)
    last = first + n_row - 1
    data[last] |= ((1 << (-ends[:, -1] % 8)) - 1).astype(np.uint8)  # rows end in ones
    stuffed = np.flatnonzero(data == 255)
    per_image = np.array(rows)
    which = np.arange(len(grid)) - np.repeat(np.cumsum(per_image) - per_image, per_image)
    is_end = which == np.repeat(per_image, per_image) - 1
    marker = np.where(is_end, 0xD9, 0xD0 + which % 8)
    where = np.concatenate((stuffed + 1, np.repeat(last + 1, 2)))
    put = np.concatenate((np.zeros(len(stuffed), np.uint8), np.stack((np.full(len(marker), 255), marker), 1).ravel().astype(np.uint8)))
    order = np.argsort(where, kind="stable")
    whole = np.insert(data, where[order], put[order]).tobytes()
    per_row = n_row + 2 + np.diff(np.searchsorted(stuffed, np.concatenate((first, [total]))))
    cuts = np.concatenate(([0], np.cumsum(per_row)))[np.concatenate(([0], np.cumsum(per_image)))]
    return [_header(r, n) + whole[a:b] for r, n, a, b in zip(rows, n_bytes, cuts, cuts[1:])]


def padded_size(n: int) -> int:
    return max(1, -(-n // WIDTH)) * WIDTH


def encode(payloads: list[bytes]) -> list[bytes]:
    """The media of each payload, padded with blanks to a positive multiple of ``WIDTH`` bytes."""
    out: list[bytes] = []
    batch: list[tuple[bytes, int, int]] = []  # samples, rows, bytes of the payload
    size = 0

    def flush() -> None:
        nonlocal size
        if batch:
            out.extend(_images(np.frombuffer(b"".join(b[0] for b in batch), np.uint8), [b[1] for b in batch], [b[2] for b in batch]))
            batch.clear()
            size = 0

    for payload in payloads:
        whole = payload.ljust(padded_size(len(payload)), bytes([PAD]))
        if len(whole) > MOST_ROWS * WIDTH:
            flush()
            step = MOST_ROWS * WIDTH
            parts = [whole[a : a + step] for a in range(0, len(whole), step)]
            left = [min(step, max(0, len(payload) - a)) for a in range(0, len(whole), step)]
            out.append(b"".join(_images(np.frombuffer(p, np.uint8), [len(p) // WIDTH], [n])[0] for p, n in zip(parts, left)))
            continue
        batch.append((whole, len(whole) // WIDTH, len(payload)))
        size += len(whole)
        if size >= LANE_BLOCKS // 2:
            flush()
    flush()
    return out


# -- reading --------------------------------------------------------------------------------------


class Image(NamedTuple):
    width: int
    height: int
    components: tuple[tuple[int, int, int, int, int], ...]  # h, v, DC quantiser, DC table, AC table of each, in scan order
    tables: tuple[bytes, ...]  # the Huffman tables' counts and symbols, DC and AC of each component
    restart: int
    scan: int  # where its data begin
    n_bytes: int | None  # of the payload, if the comment tells


def parse(media: bytes, at: int = 0) -> Image:
    """The header of the baseline image at ``at``; ValueError for anything else."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    quantisers, huffman, frame, restart, n_bytes = {}, {}, None, 0, None
    at += 2
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError("no marker")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = media[at + 2] << 8 | media[at + 3]
        body = media[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise ValueError("segment cut short")
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = body[k + 1] << 8 | body[k + 2] if wide else body[k + 1]
                k += 129 if wide else 65
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            height, width, n = body[1] << 8 | body[2], body[3] << 8 | body[4], body[5]
            frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE and body.startswith(b"bytes=") and body[6:].isdigit():
            n_bytes = int(body[6:])
        elif marker == 0xDA:
            if frame is None or not height or not width or body[0] != len(frame):
                raise ValueError("no frame, or components in several scans")
            parts = []
            for i in range(body[0]):
                h, v, q = frame[body[1 + 2 * i]]
                parts.append((h, v, quantisers[q], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
            if len(parts) == 1:
                parts = [(1, 1, *parts[0][2:])]
            tables = tuple(huffman[t] for p in parts for t in (p[3], 0x10 | p[4]))
            return Image(width, height, tuple(parts), tables, restart, at, n_bytes)
    raise ValueError("no scan")


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: length of the code << 8 | symbol; 0 where no code fits."""
    if table not in _LOOKUPS:
        found = np.zeros(1 << 16, np.int64)
        for symbol, code, length in codes(table[:16], table[16:]):
            a = code << (16 - length)
            found[a : a + (1 << (16 - length))] = length << 8 | symbol
        if len(_LOOKUPS) > 64:
            _LOOKUPS.clear()
        _LOOKUPS[table] = found
    return _LOOKUPS[table]


class _Bits:
    """The next 57 or more bits at any place of a byte array."""

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate((data, np.full(16, 255, np.uint8)))
        self.words = np.ndarray((len(self.data) - 7,), ">u8", self.data, strides=(1,))

    def at(self, place: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(place >> 3, len(self.words) - 1)].astype(np.uint64) << (place & 7).astype(np.uint64)


def _extend(bits: np.ndarray, used: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value of the ``size`` bits that follow the first ``used`` bits."""
    value = ((bits << used.astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - size.astype(np.uint64))).astype(np.int64)
    return np.where((size > 0) & (value < np.int64(1) << np.maximum(size - 1, 0)), value - (np.int64(1) << size) + 1, value)


def _decode_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, units: np.ndarray, tables: tuple[bytes, ...], sequence: list[int], wanted: int) -> np.ndarray:
    """DC differences of the wanted component: a row per lane, its blocks in order.

    starts, ends: byte bounds of the lanes; units: MCUs of each; sequence: the component of each block of an MCU.
    """
    bits = _Bits(data)
    per_mcu = sum(c == wanted for c in sequence)
    order = np.argsort(-units, kind="stable")  # lanes that end early are a suffix
    place, left = starts[order] << 3, units[order]
    out = np.zeros((int(left[0]) * per_mcu if len(left) else 0, len(left)), np.int32)
    lookups = [_lookup(t) for t in tables]
    k = 0
    for mcu in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -mcu, "left")) if left[-1] <= mcu else len(left)
        for component in sequence:
            window = bits.at(place[:n])
            found = lookups[2 * component][(window >> np.uint64(48)).astype(np.int64)]
            length, size = found >> 8, found & 255
            if not length.all():
                raise ValueError("bad code")
            value = _extend(window, length, size)
            if component == wanted:
                out[k, :n] = value
                k += 1
            used = length + size
            place[:n] += used
            table = lookups[2 * component + 1]
            # the first AC symbol lies in the same window; most blocks end there
            found = table[((window << used.astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
            index = np.ones(n, np.int64)
            lanes = None
            while True:
                length, symbol = found >> 8, found & 255
                if not length.all():
                    raise ValueError("bad code")
                run, size = symbol >> 4, symbol & 15
                step = length + size
                done = symbol == 0
                if lanes is None:
                    place[:n] += step
                    if done.all():
                        break
                    lanes = np.arange(n)
                else:
                    place[lanes] += step
                index = index + run + 1
                lanes, index = lanes[~done & (index < 64)], index[~done & (index < 64)]
                if not len(lanes):
                    break
                found = table[(bits.at(place[lanes]) >> np.uint64(48)).astype(np.int64)]
    if (place > ends[order] << 3).any():
        raise ValueError("scan cut short")
    back = np.empty_like(out)
    back[:, order] = out
    return back.T


def _scan(media: bytes, image: Image) -> tuple[np.ndarray, np.ndarray, int]:
    """Scan data without stuffing and markers, the bounds of its restart intervals, and where the image ends."""
    data = np.frombuffer(media, np.uint8, len(media) - image.scan, image.scan)
    marks = np.flatnonzero(data[:-1] == 255)
    after = data[marks + 1]
    stop = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255))
    if not len(stop) or after[stop[0]] != 0xD9:
        raise ValueError("no end of image")
    end = int(marks[stop[0]])
    marks, after = marks[: stop[0]], after[: stop[0]]
    drop = np.zeros(end, bool)
    drop[marks[after == 0] + 1] = True
    restarts = marks[after >= 0xD0]
    drop[restarts] = drop[restarts + 1] = True
    kept = np.flatnonzero(~drop)
    return data[kept], np.concatenate(([0], np.searchsorted(kept, restarts), [len(kept)])), image.scan + end + 2


def thumbnails(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each media its images in order, each with its luminance thumbnail (uint8, one pixel a block)."""
    out: list[list[tuple[Image, np.ndarray]]] = [[] for _ in media]
    groups: dict[tuple, list[tuple[int, int, Image, np.ndarray, np.ndarray]]] = {}
    sizes: dict[tuple, int] = {}

    def flush(key: tuple) -> None:
        items = groups.pop(key, [])
        sizes.pop(key, None)
        if items:
            for (m, k, image, _, _), pixels in zip(items, _decode(items)):
                out[m][k] = (image, pixels)

    for m, whole in enumerate(media):
        at, k = 0, 0
        while at < len(whole):
            image = parse(whole, at)
            data, bounds, at = _scan(whole, image)
            key = (image.components, image.tables)
            out[m].append(None)
            groups.setdefault(key, []).append((m, k, image, data, bounds))
            sizes[key] = sizes.get(key, 0) + image.width * image.height // 64
            if sizes[key] >= LANE_BLOCKS:
                flush(key)
            k += 1
    for key in list(groups):
        flush(key)
    return out


def _decode(items: list[tuple[int, int, Image, np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    components, tables = items[0][2].components, items[0][2].tables
    sequence = [i for i, (h, v, *_) in enumerate(components) for _ in range(h * v)]
    high, wide = max(c[1] for c in components), max(c[0] for c in components)
    starts, ends, units, base, lanes = [], [], [], 0, []
    for _, _, image, data, bounds in items:
        mcus = -(-image.width // (8 * wide)) * -(-image.height // (8 * high))
        n = len(bounds) - 1
        step = image.restart or mcus
        if n != -(-mcus // step):
            raise ValueError("restart markers are missing")
        starts.append(bounds[:-1] + base)
        ends.append(bounds[1:] + base)
        units.append(np.minimum(step, mcus - step * np.arange(n)))
        lanes.append(n)
        base += len(data)
    units = np.concatenate(units)
    differences = _decode_lanes(np.concatenate([i[3] for i in items]), np.concatenate(starts), np.concatenate(ends), units, tables, sequence, 0)
    h, v, quantiser, *_ = components[0]
    levels = np.clip(np.round(np.cumsum(differences, axis=1) * quantiser / 8) + 128, 0, 255).astype(np.uint8)
    at = 0
    for (_, _, image, _, _), n in zip(items, lanes):
        own, count = levels[at : at + n], units[at : at + n] * h * v
        at += n
        blocks = own.ravel() if n and (count == own.shape[1]).all() else np.concatenate([row[:c] for row, c in zip(own, count)])
        rows, columns = -(-image.height // (8 * high)), -(-image.width // (8 * wide))
        grid = blocks.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
        yield grid[: -(-image.height * v // (8 * high)), : -(-image.width * h // (8 * wide))]


def difference_hash(*images: np.ndarray) -> str:
    """64 bits in hex: which of 8 x 9 mean tones is brighter than its left neighbour. Several images stand below each other, left-aligned on black."""
    rows, columns = sum(len(p) for p in images), max(p.shape[1] for p in images)
    edges = [np.minimum(np.arange(n) * size // n, size - 1) for n, size in ((8, rows), (9, columns))]
    to = [np.maximum(np.append(e[1:], size), e + 1) for e, size in zip(edges, (rows, columns))]
    sums = np.zeros((8, columns + 1), np.int64)
    top = 0
    for pixels in images:
        for band, a, b in zip(sums, edges[0] - top, to[0] - top):
            if a < len(pixels) and b > 0:
                band[1 : pixels.shape[1] + 1] += pixels[max(a, 0) : b].sum(axis=0, dtype=np.int64)
        top += len(pixels)
    np.cumsum(sums, axis=1, out=sums)
    total = sums[:, to[1]] - sums[:, edges[1]]
    mean = total / np.outer(to[0] - edges[0], to[1] - edges[1])
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def add_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text (null: empty) as UTF-8, stored losslessly in baseline JPEG images. Other columns are ignored; repeated rows are answered each, and an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", LANE_BLOCKS // 2):
                media = encode([t.encode() for t in common.texts_of(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, media binary")


def features(rows: DataFrame) -> DataFrame:
    """Dimensions, thumbnail hash and stored bytes of media columns (doc_id and media; others are ignored), from the media alone.

    One row per row. The images of a media count as one, below each other: the width is that of the widest, the height that of all together,
    and the hash is over all their pixels. A null media, or one that is not a run of baseline images, has null features and an error that says why. ``n_bytes`` is null if the media
    was not written by ``add_media``; then the payload is the thumbnails' pixels.
    """
    schema = "doc_id bigint, width bigint, height bigint, n_images bigint, thumbnail_hash string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, error string"

    def row(media: bytes | None, found) -> tuple:
        if media is None:
            return (None,) * 10 + ("no media",)
        digest = hashlib.sha256(media).hexdigest()
        if isinstance(found, str):
            return (None,) * 8 + (len(media), digest, found)
        payload = b"".join(p.tobytes() for _, p in found)
        sizes = [i.n_bytes for i, _ in found]
        n = None if None in sizes else sum(sizes)
        width, height = max(i.width for i, _ in found), sum(i.height for i, _ in found)
        return (width, height, len(found), difference_hash(*(p for _, p in found)), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), digest, None)

    def read(media: list[bytes]) -> list:
        try:
            return thumbnails(media)
        except (ValueError, KeyError, IndexError, struct.error) as e:
            if len(media) == 1:
                return [f"{type(e).__name__}: {e}"]
        return [read([m])[0] for m in media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
        for batch in batches:
            for part in common.slices(batch, "media", LANE_BLOCKS):
                media = part.column("media").to_pylist()
                present = [m if m else b"\xff" for m in media if m is not None]
                found = iter(read(present) if present else [])
                rows = [row(m, None if m is None else next(found)) for m in media]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], [f.split()[0] for f in schema.split(", ")])

    return rows.select("doc_id", "media").mapInArrow(run, schema)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(add_media(common.table(spark, sf_dir, "documents")))
    feature = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(":"), F.col("thumbnail_hash"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
