import hashlib
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenseek.functions import chunking, codec, formatting, hashing, paths, vectors


def windows_of(data):
    """Plain-Python model of the cutting."""
    if not 16 <= len(data) <= 1_000_000 or b"\0" in data[:8192]:
        return []
    try:
        lines = data.decode("utf-8").split("\n")
    except UnicodeDecodeError:
        return []
    if lines[-1] == "" and len(lines) > 1:
        lines.pop()
    out, first = [], 0
    while True:
        end = min(first + 20, len(lines))
        body = "\n".join(lines[first:end]).encode()[:1000].decode("utf-8", "ignore")
        out.append((first + 1, end, body))
        if end == len(lines):
            return out
        first += 16


def chunks(spark, contents):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    found = {i: [] for i in range(len(contents))}
    for r in chunking.with_chunks(df).orderBy("id", "chunk_idx").collect():
        assert r["chunk_idx"] == len(found[r["id"]])
        found[r["id"]].append((r["start_line"], r["end_line"], r["text"]))
    return [found[i] for i in range(len(contents))]


def test_chunk_edges(spark):
    line = b"some words here"
    contents = [b"", b"x" * 15, b"x" * 16, b"y" * 1_000_000, b"y" * 1_000_001]
    contents += [b"x" * 8191 + b"\0" + b"tail", b"x" * 8192 + b"\0" + b"tail", b"\xff\xfe" * 20, b"caf\xc3" * 10]
    for n in (1, 19, 20, 21, 36, 37, 52, 53, 100):
        contents += [b"\n".join([line] * n), b"\n".join([line] * n) + b"\n", b"\r\n".join([line] * n)]
    contents += [b"\n" * 30, b"a" * 999 + "é".encode(), "€".encode() * 400, "😀".encode() * 300, b"b" + "😀".encode() * 300]
    assert chunks(spark, contents) == [windows_of(c) for c in contents]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab\né€😀\r ."), max_size=600), min_size=1, max_size=8))
def test_chunks_equal_model(spark, texts):
    contents = [t.encode() for t in texts]
    assert chunks(spark, contents) == [windows_of(c) for c in contents]


PATHS = {
    "node_modules/a.js": True, "x/node_modules/a.js": False, "foo.map.js": False, "Cargo.lock": False, "README": True, "README.md": True,
    ".gitattributes": False, "Dockerfile": True, "Dockerfile.dev": False, "a.PY": True, "x.dockerfile": True, "noext": False, "py": False, "src/py": False,
    "a.mapper.js": False, "lib/x.min.js": False, "a/build/b.py": False, "build/b.py": True, "deep/Makefile": True, "x.": False, "": False, "a.KT": False, "d.d/file": False,
}


def test_textual_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS] + [(None,)], "path string")
    found = {r[0]: r[1] for r in df.select("path", paths.is_textual(F.col("path"))).collect()}
    assert found == PATHS | {None: False}
    assert {p: paths.textual_path(p) for p in PATHS} == PATHS


def test_fixed_value_counts():
    assert (len(paths.EXCLUDED_SUBSTRINGS), len(paths.TEXT_NAMES), len(paths.TEXT_EXTENSIONS)) == (21, 10, len(set(paths.TEXT_EXTENSIONS)))


def test_prefix_is_plain(spark):
    df = spark.createDataFrame([("src/ab.rs",), ("src/b.rs",)], "path string")
    assert [r[0] for r in df.where(paths.under_prefix(F.col("path"), "src/a")).collect()] == ["src/ab.rs"]
    assert df.where(paths.under_prefix(F.col("path"), "")).count() == 2


@pytest.mark.parametrize("data", [b"", b"abc", "é\0x".encode(), b"\xff" * 300])
def test_blob_sha(spark, data):
    row = spark.createDataFrame([(bytearray(data),)], "c binary").select(hashing.git_blob_sha(F.col("c")).alias("s"), hashing.hex_lower(F.col("c"))).first()
    assert row["s"] == hashlib.sha1(b"blob %d\0" % len(data) + data).hexdigest() and row[1] == data.hex()


def test_entry_paths(spark):
    sha = "ab" * 20
    df = spark.createDataFrame([(sha, "ab/" + sha[2:]), ("x", "meta.json")], "sha string, entry string")
    rows = df.select(hashing.entry_path(F.col("sha")), hashing.sha_of_entry(F.col("entry")), hashing.is_blob_sha(F.col("sha"))).collect()
    assert tuple(rows[0]) == ("ab/" + sha[2:], sha, True) and tuple(rows[1])[1:] == (None, False)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 64)).astype(np.float32)
    df = spark.createDataFrame([(a.tolist(), b.tolist()), ([0.0] * 64, b.tolist())], "a array<float>, b array<float>")
    rows = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.l2_norm(F.col("a")), vectors.l2_normalize(F.col("a"))).collect()
    assert math.isclose(rows[0][0], float(a.astype(float) @ b.astype(float)), rel_tol=1e-9)
    assert math.isclose(rows[0][1], float(np.linalg.norm(a.astype(float))), rel_tol=1e-9)
    assert np.allclose(rows[0][2], a / np.linalg.norm(a)) and rows[1][2] == [0.0] * 64
    with pytest.raises(Exception, match="expected a vector of 3"):
        df.select(vectors.checked(F.col("a"), 3)).collect()


def test_payload_codec():
    ranges, matrix = [(1, 20), (17, 30)], np.arange(6, dtype=np.float32).reshape(2, 3)
    data = codec.pack_payload(3, ranges, matrix)
    dim, found, back = codec.unpack_payload(data)
    assert (dim, found) == (3, ranges) and (back == matrix).all()
    assert codec.payload_valid(data, 3) and codec.payload_rows(data) == 2 and len(data) == codec.payload_size(2, 3)
    for bad in (b"", b"not a vector payload", data[:-1], data + b"x", b"XXXX" + data[4:], data[:4] + b"\2\0" + data[6:]):
        assert not codec.payload_valid(bad, 3)
    assert not codec.payload_valid(data, 4)
    assert codec.payload_valid(codec.pack_payload(3, [], []), 3)
    with pytest.raises(ValueError):
        codec.unpack_payload(data[:-1])


def test_corpus_and_dump():
    texts = ["", "é€", "x" * 1000]
    assert codec.unpack_corpus(codec.pack_corpus(texts)) == texts
    with pytest.raises(ValueError):
        codec.unpack_corpus(b"nothing at all..")
    matrix = np.arange(600 * 2, dtype=np.float32).reshape(600, 2)
    assert (codec.unpack_vectors(codec.pack_vectors(matrix)) == matrix[:256]).all()


def test_progress_messages():
    assert formatting.progress(7, 2, 1, 3) == "indexing: cache contains 1/3 blobs (33%); embedding 7 new chunks from 2 blobs..."
    assert formatting.progress(1, 1, 199, 200) == "indexing: cache contains 199/200 blobs (99%); embedding 1 new chunk from 1 blob..."
    assert formatting.progress(0, 0, 0, 0) == "indexing: cache contains 0/0 blobs (100%); embedding 0 new chunks from 0 blobs..."
    assert formatting.groups_line(70, 9, 32) == "[index] embedding 70 chunks across 9 unique blobs in groups of ≤32..." and formatting.group_line(3, 70) == "[index] ... group 3 done (70 chunks total)"
    assert formatting.percent_line(1, 3) == "indexing: 1/3 chunks (33%)" and formatting.percent_line(0, 0).endswith("(100%)") and formatting.backend_line("tiny", 4) == "[embed] tiny · batch 4"
    assert "(0%)" in formatting.progress(5, 1000, 0, 1000) and "(100%)" in formatting.progress(0, 0, 4, 4)
