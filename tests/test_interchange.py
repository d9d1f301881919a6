import time

import numpy as np
import pyarrow as pa
import pytest

from lumenseek.functions import chunking, codec, udtf
from lumenseek.operators import stats
from lumenseek.operators.watchdog import Watchdog, resident_bytes
from lumenseek.sources import corpus, interchange, tables


def test_corpus_files(spark, tmp_path, sf_dir):
    files = tables.documents_as_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    numbered = interchange.with_seq(stats.corpus(files))
    expected = [r["text"] for r in numbered.orderBy("seq").collect()]
    path = str(tmp_path / "c")
    corpus.write(numbered, path)
    back = corpus.read(spark, path, splitbytes="1").orderBy("file", "seq").collect()
    assert [r["text"] for r in back] == expected
    parts = sorted((tmp_path / "c").glob("part-*.corpus"))
    assert [t for p in parts for t in codec.unpack_corpus(p.read_bytes())] == expected and not list((tmp_path / "c").glob(".*-*"))
    with pytest.raises(Exception, match="exists already"):
        corpus.write(numbered, path)
    corpus.write(numbered.where("seq < 3"), path, mode="overwrite")
    assert sorted(r["text"] for r in corpus.read(spark, path).collect()) == sorted(expected[:3])


def test_large_corpus_files_are_split_and_foreign_ones_read_whole(spark, tmp_path):
    texts = [f"text {i} " + "é" * (i % 50) for i in range(5500)]
    path = str(tmp_path / "c")
    corpus.write(spark.createDataFrame(list(enumerate(texts)), "seq bigint, text string").coalesce(1), path)
    split = corpus.read(spark, path, splitbytes="20000")
    assert split.rdd.getNumPartitions() >= 5 and [r["text"] for r in split.orderBy("file", "seq").collect()] == texts
    (tmp_path / "one.bin").write_bytes(codec.pack_corpus(texts[:20]))
    found = corpus.read(spark, str(tmp_path / "one.bin")).orderBy("seq").collect()
    assert [(r["seq"], r["text"]) for r in found] == list(enumerate(texts[:20]))
    (tmp_path / "none.bin").write_bytes(codec.pack_corpus([]))
    assert corpus.read(spark, str(tmp_path / "none.bin")).count() == 0
    (tmp_path / "bad.bin").write_bytes(b"something else than a corpus")
    with pytest.raises(Exception, match="not a corpus"):
        corpus.read(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "cut.bin").write_bytes(codec.pack_corpus(texts[:20])[:-3])
    with pytest.raises(Exception, match="cut short"):
        corpus.read(spark, str(tmp_path / "cut.bin")).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(2000).selectExpr("id AS seq", "CASE WHEN id = 1500 THEN raise_error('as asked') ELSE 'text' END AS text")
    with pytest.raises(Exception, match="as asked"):
        corpus.write(rows, path)
    assert not list((tmp_path / "c").glob("*.corpus")) and not list((tmp_path / "c").glob(".*-*"))


def test_payloads_of_a_batch_equal_those_row_by_row():
    rng = np.random.default_rng(5)
    rows = [None, []] + [[{"chunk_idx": i, "start_line": 16 * i + 1, "end_line": 16 * i + 20, "embedding": rng.normal(size=3).astype(np.float32).tolist()} for i in range(n)] for n in (1, 4, 0, 2)]
    kind = pa.list_(pa.struct([("chunk_idx", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("embedding", pa.list_(pa.float32()))]))
    for column in (pa.array(rows, kind), pa.array([rows[3]] + rows + rows, kind).slice(1, len(rows)), pa.array([], kind), pa.array([None, []], kind)):
        plain = [codec.pack_payload(3, [(r["start_line"], r["end_line"]) for r in found or []], [r["embedding"] for r in found or []]) for found in column.to_pylist()]
        assert codec.pack_payloads(3, column).to_pylist() == plain
    with pytest.raises(ValueError, match="expected vectors"):
        codec.pack_payloads(4, pa.array(rows, kind))


def test_vector_dumps(spark, tmp_path):
    matrix = np.random.default_rng(1).normal(size=(300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "seq bigint, embedding array<float>").repartition(4)
    assert interchange.dump_vectors(df, str(tmp_path / "v.bin")) == 256
    back = interchange.read_vectors(spark, str(tmp_path / "v.bin")).orderBy("seq").collect()
    assert np.array_equal([r["embedding"] for r in back], matrix[:256])
    found = stats.compare_runs(df, interchange.read_vectors(spark, str(tmp_path / "v.bin"))).first()
    dots = (matrix[:256].astype(float) ** 2).sum(axis=1)
    assert found["n"] == 256 and np.isclose(found["mean"], dots.mean()) and np.isclose(found["worst"], dots.min())


def test_table_function_equals_columns(spark):
    udtf.register(spark)
    contents = [b"", b"x" * 15, "é€\n".encode() * 400, b"a line of words\n" * 53, b"a\0b" * 20, b"\xff" * 40, "\n".join(["w" * 60] * 20).encode(), b"\n" * 37]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)] + [(99, None)], "id int, content binary")
    df.createOrReplaceTempView("blobs_to_cut")
    rows = spark.sql("SELECT id, w.* FROM blobs_to_cut, LATERAL chunk_windows(content) AS w")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, chunking.with_chunks(df).collect()))


def test_watchdog():
    told, sizes = [], iter([1, 5, 20, 30] + [2] * 1000)
    with Watchdog(10, 0.001, told.append, lambda: next(sizes)) as dog:
        while dog.peak < 30:
            time.sleep(0.001)
    assert told == [20] and dog.peak == 30 and resident_bytes() > 1 << 20
