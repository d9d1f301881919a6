import hashlib
import struct
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenseek.llm import jpeg


def pixels(media):
    return b"".join(p.tobytes() for _, p in jpeg.thumbnails([media])[0])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6))
def test_bytes_come_back(payloads):
    for payload, media, images in zip(payloads, encoded := jpeg.encode(payloads), jpeg.thumbnails(encoded)):
        assert b"".join(p.tobytes() for _, p in images) == payload.ljust(jpeg.padded_size(len(payload)), b" ")
        assert images[0][0].n_bytes == len(payload) and jpeg.encode([payload]) == [media]


def test_sizes_and_markers():
    (media,) = jpeg.encode([b"\xff\0" * 500])
    image = jpeg.parse(media)
    assert (image.width, image.height, image.restart) == (1536, 48, 192) and media.endswith(b"\xff\xd9")
    assert [jpeg.padded_size(n) for n in (0, 1, 192, 193)] == [192, 192, 192, 384]


def test_payload_of_several_images():
    data = np.random.default_rng(1).integers(0, 256, jpeg.MOST_ROWS * jpeg.WIDTH + 5000, dtype=np.uint8).tobytes()
    media = jpeg.encode([data, b"z"])
    found = jpeg.thumbnails(media)
    assert [len(f) for f in found] == [2, 1] and b"".join(p.tobytes() for _, p in found[0])[: len(data)] == data
    assert sum(i.n_bytes for i, _ in found[0]) == len(data)


def test_feature_covers_all_images(spark):
    start = "some text of the document " * (jpeg.MOST_ROWS * jpeg.WIDTH // 26 + 1)
    line = "".join(chr(33 + i // 3) for i in range(jpeg.WIDTH))
    docs = [(1, start + line * 4000), (2, start + line[::-1] * 4000), (3, start + line * 4000), (4, start + line * 12000), (5, "short")]
    rows = {r["doc_id"]: r for r in jpeg.features(jpeg.add_media(spark.createDataFrame(docs, "doc_id bigint, text string"))).collect()}
    for doc_id, text in docs:
        assert (rows[doc_id]["width"], rows[doc_id]["height"]) == (8 * jpeg.WIDTH, jpeg.padded_size(len(text)) // jpeg.WIDTH * 8)
        whole = np.frombuffer(text.ljust(jpeg.padded_size(len(text))).encode(), np.uint8).reshape(-1, jpeg.WIDTH)
        assert rows[doc_id]["thumbnail_hash"] == jpeg.difference_hash(whole)
    assert [rows[i]["n_images"] for i in (1, 4, 5)] == [2, 3, 1]
    assert rows[1]["thumbnail_hash"] == rows[3]["thumbnail_hash"] != rows[2]["thumbnail_hash"] and rows[1]["thumbnail_hash"] != rows[4]["thumbnail_hash"]


def test_hash_of_images_equals_that_of_their_stack():
    rng = np.random.default_rng(3)
    for heights, widths in (((1, 2), (9, 9)), ((5, 1, 30), (40, 40, 40)), ((7, 20), (12, 31))):
        images = [rng.integers(0, 256, s, dtype=np.uint8) for s in zip(heights, widths)]
        stack = np.concatenate([np.pad(p, ((0, 0), (0, max(widths) - p.shape[1]))) for p in images])
        assert jpeg.difference_hash(*images) == jpeg.difference_hash(stack)


def colour_image(levels, quantiser, restart=0):
    """A 4:2:0 colour image with AC coefficients, coded bit by bit: one luminance DC level for each block of the MCUs in scan order."""
    counts, symbols = (0, 0, 0, 0, 12, *[0] * 11), bytes(range(12))
    ac_counts, ac_symbols = (0, 0, 0, 5, *[0] * 12), bytes([0x00, 0x01, 0xF0, 0x32, 0x1A])
    dc = {s: (c, n) for s, c, n in jpeg.codes(counts, symbols)}
    ac = {s: (c, n) for s, c, n in jpeg.codes(ac_counts, ac_symbols)}
    scan, bits, predicted, number = bytearray(), "", [0, 0, 0], 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for a in range(0, len(bits), 8):
            scan.append(int(bits[a : a + 8], 2))
            if scan[-1] == 255:
                scan.append(0)
        bits = ""

    def put(code, n):
        nonlocal bits
        bits += f"{code:0{n}b}" if n else ""

    def value(v, size):
        put(v if v >= 0 else v + (1 << size) - 1, size)

    def block(component, level, extra):
        diff = level - predicted[component]
        predicted[component] = level
        put(*dc[diff.bit_length() if diff >= 0 else (-diff).bit_length()])
        value(diff, abs(diff).bit_length())
        if extra == 1:
            put(*ac[0x01])
            put(1, 1)
        elif extra == 2:
            put(*ac[0xF0])
            put(*ac[0x32])
            value(-3, 2)
            put(*ac[0x1A])
            value(700, 10)
        elif extra == 3:  # runs to the last coefficient: no end of block
            for _ in range(3):
                put(*ac[0xF0])
            for _ in range(3):
                put(*ac[0x32])
                value(2, 2)
            for _ in range(3):
                put(*ac[0x01])
                put(1, 1)
            return
        put(*ac[0])

    for mcu in range(0, len(levels), 4):
        if restart and mcu // 4 and mcu // 4 % restart == 0:
            flush()
            scan.extend([0xFF, 0xD0 + number % 8])
            number += 1
            predicted[:] = [0, 0, 0]
        for i, level in enumerate(levels[mcu : mcu + 4]):
            block(0, level, (mcu + i) % 4)
        block(1, (mcu * 7) % 50 - 25, 1)
        block(2, -(mcu % 30), 0)
    flush()
    segment = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    table = lambda i, c, s: segment(0xC4, bytes([i]) + bytes(c) + s)
    return b"".join([b"\xff\xd8", segment(0xDB, b"\0" + bytes([quantiser] + [3] * 63)), segment(0xC0, struct.pack(">BHHB", 8, 30, 44, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), table(0, counts, symbols), table(0x10, ac_counts, ac_symbols), *([segment(0xDD, struct.pack(">H", restart))] if restart else []), segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0"), bytes(scan), b"\xff\xd9"])


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_colour_images_with_ac(restart):
    rng = np.random.default_rng(8)
    levels = rng.integers(-60, 60, 24)  # 3 x 2 MCUs of four luminance blocks
    image, found = jpeg.thumbnails([colour_image(levels.tolist(), 16, restart)])[0][0]
    grid = levels.reshape(2, 3, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (image.width, image.height) == (44, 30) and found.shape == (4, 6)
    assert (found == np.clip(grid * 2 + 128, 0, 255)).all()


@pytest.mark.parametrize("damage", [lambda m: m[:200], lambda m: b"nothing", lambda m: m[:-2], lambda m: m.replace(b"\xff\xc0", b"\xff\xc2"), lambda m: m[:700] + m[900:], lambda m: b""])
def test_damage_is_told(spark, damage):
    (good,) = jpeg.encode([b"some text " * 200])
    rows = jpeg.features(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(damage(good))), (3, None)], "doc_id bigint, media binary")).collect()
    assert rows[0]["n_bytes"] == 2000 and rows[0]["error"] is None and rows[1]["error"] and rows[2]["error"] == "no media"


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD * 2)
    rows = jpeg.features(jpeg.add_media(docs)).collect()
    for r, t in zip(rows, AWKWARD * 2):
        data = (t or "").encode()
        whole = data.ljust(jpeg.padded_size(len(data)), b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), None)
    assert len({r["media_sha256"] for r in rows}) == len({t or "" for t in AWKWARD})
    assert jpeg.features(jpeg.add_media(empty(spark))).count() == 0


def test_query_reads_every_document(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = jpeg.op7_jpeg(spark, sf_dir).collect()
    assert len(rows) == len(texts) and len({r["feature"] for r in rows}) > 100
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert r["payload_sha256"] == hashlib.sha256(data.ljust(jpeg.padded_size(len(data)), b" ")).hexdigest()


def test_difference_hash():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert jpeg.difference_hash(ramp) == "f" * 16 and jpeg.difference_hash(ramp[:, ::-1]) == "0" * 16 and len(jpeg.difference_hash(ramp[:1, :1])) == 16
