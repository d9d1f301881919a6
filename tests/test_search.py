import math

import numpy as np
import pyarrow as pa
import pytest

from lumenseek.operators import search

SCHEMA = "blob_sha string, chunk_idx int, start_line int, end_line int, embedding array<float>"


@pytest.fixture(scope="module")
def rows(spark):
    data = [("b", 0, 1, 20, [1.0, 0.0]), ("a", 1, 17, 30, [1.0, 0.0]), ("a", 0, 1, 20, [0.5, 0.5]), ("c", 0, 1, 5, [math.nan, 0.0]), ("d", 0, 1, 5, [math.inf, 0.0]), ("e", 0, 1, 5, [0.0, 0.0]), ("f", 0, 1, 5, [0.9, 0.0])]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("src/a.py", "a"), ("lib/a.py", "a"), ("src/ab.py", "b"), ("src/c.py", "c"), ("src/d.py", "d"), ("src/e.py", "e")], "path string, blob_sha string")


@pytest.mark.parametrize("scan", ["sql", "arrow"])
def test_ties_nan_and_fan_out(rows, files, scan):
    hits = [(r["path"], r["chunk_idx"]) for r in search.search(rows, files, [1.0, 0.0], 2, scan=scan).collect()]
    assert hits == [("lib/a.py", 1), ("src/a.py", 1), ("src/ab.py", 0)]  # two windows, three paths; f has no path


@pytest.mark.parametrize("scan", ["sql", "arrow"])
def test_prefix_limits_who_competes(rows, files, scan):
    hits = search.search(rows, files, [1.0, 0.0], 1, "src/ab", scan=scan).collect()
    assert [r["path"] for r in hits] == ["src/ab.py"]
    assert search.search(rows, files, [1.0, 0.0], 5, "nowhere/", scan=scan).count() == 0


@pytest.mark.parametrize("scan", ["sql", "arrow"])
@pytest.mark.parametrize(("k", "n"), [(0, 0), (1, 2), (100, 6)])
def test_k(rows, files, scan, k, n):
    assert search.search(rows, files, [1.0, 0.0], k, scan=scan).count() == n


def test_empty_index(spark, files):
    empty = spark.createDataFrame([], SCHEMA)
    assert search.search(empty, files, [1.0, 0.0]).count() == 0


def test_wrong_dimension_fails(rows, files):
    with pytest.raises(Exception, match="expected vectors of 3"):
        search.search(rows, files, [1.0, 0.0, 0.0]).collect()


def test_scan_equals_numpy(spark):
    rng = np.random.default_rng(5)
    matrix = rng.integers(-2, 3, size=(500, 8)).astype(np.float32)  # many ties
    data = [(f"{i:03d}", 0, 1, 1, v.tolist()) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    q = rng.integers(-2, 3, size=8).astype(float)
    expected = sorted(((-float(v @ q), f"{i:03d}") for i, v in enumerate(matrix)))[:20]
    for found in (search.scan_top_k(df, q, 20), search.top_k(search.scored(df, search.vectors.literal(q)), 20)):
        assert [(-r["score"], r["blob_sha"]) for r in found.collect()] == expected
    queries = spark.createDataFrame([(i, matrix[i].tolist()) for i in range(30)], "qid bigint, qvec array<float>")
    many = search.search_many(df, queries, 4, block=7).collect()
    for i in range(30):
        mine = [(-r["score"], r["blob_sha"]) for r in sorted((r for r in many if r["qid"] == i), key=lambda r: r["rank"])]
        assert mine == sorted((-float(v @ matrix[i]), f"{j:03d}") for j, v in enumerate(matrix))[:4]


def test_show_lines_of_the_file_as_it_is(spark):
    hits = spark.createDataFrame([("a", 2, 3, 0.5, "s", 0), ("short", 9, 12, 0.5, "s", 0), ("gone", 1, 1, 0.5, "s", 0)], "path string, start_line int, end_line int, score double, blob_sha string, chunk_idx int")
    files = spark.createDataFrame([("a", bytearray(b"l1\nl2\nl3\nl4")), ("short", bytearray(b"x")), ("gone", None)], "path string, content binary")
    found = {r["path"]: r["lines"] for r in search.show_lines(hits, files).collect()}
    assert found == {"a": ["l2", "l3"], "short": None, "gone": None}
    text = search.render(hits, show=files)
    assert "0.5000  a:2-3\n    l2\n    l3\n" in text


def test_query_text():
    assert search.query_text(["two", "words"]) == "two words"
    with pytest.raises(ValueError, match="empty"):
        search.query_text([])


def test_many_queries_in_one_scan(spark, monkeypatch):
    """Blocks, chunks and thresholds change nothing; equal scores are broken by id and window."""
    rng = np.random.default_rng(2)
    rows = [(f"{i % 70:040x}", i // 70, 1, 1, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(400)] + [("f" * 40, 0, 1, 1, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, "blob_sha string, chunk_idx int, start_line int, end_line int, embedding array<float>").repartition(3)
    queries = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]
    asked = spark.createDataFrame([*queries, (None, [1.0] * 4), (99, None)], "qid int, qvec array<double>")
    monkeypatch.setattr(search, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(search, "SCORE_BYTES", 4000)
    expected = []
    for qid, q in queries:
        order = sorted((-sum(a * b for a, b in zip(q, v)), sha, c) for sha, c, _, _, v in rows if v[0] == v[0])[:6]
        expected += [(qid, rank, sha, c, -s) for rank, (s, sha, c) in enumerate(order, 1)]
    for few in (search.KEPT_QUERY_BYTES, 0):
        monkeypatch.setattr(search, "KEPT_QUERY_BYTES", few)
        found = search.search_many(df, asked, 6, block=20)
        assert sorted((r["qid"], r["rank"], r["blob_sha"], r["chunk_idx"], r["score"]) for r in found.collect()) == expected
    assert search.search_many(df, asked.limit(0), 6).count() == 0 and search.search_many(df.limit(0), asked, 6).count() == 0 and search.search_many(df, asked, 0).count() == 0


def _blocks(spark, tmp_path, queries):
    spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "qid bigint, qvec array<float>").coalesce(1).write.parquet(str(tmp_path / "queries"))
    return search._QueryBlocks(str(tmp_path / "queries"))


def _chunk(embeddings, first=0):
    n = len(embeddings)
    ids = [f"{first + n - i:040x}" for i in range(n)]
    ones = pa.array([1] * n, pa.int32())
    return pa.table([pa.array(ids), ones, ones, ones, pa.array([list(map(float, v)) for v in embeddings], pa.list_(pa.float32()))], names=["blob_sha", "chunk_idx", "start_line", "end_line", "embedding"])


def test_what_is_kept_of_a_chunk_is_the_best_scores_only(spark, tmp_path, monkeypatch):
    """All scores of a chunk, as numbers of 8 bytes, are 40 times what may stay: k = 5 of 200 for each query."""
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 200 * 7)
    rng = np.random.default_rng(3)
    blocks = _blocks(spark, tmp_path, rng.normal(size=(60, 4)).tolist())
    for _ in blocks.best(_chunk(rng.normal(size=(200, 4))), 5):
        pass
    held = sum((x if x.base is None else x.base).nbytes for x in blocks.seen.values())
    assert 0 < held <= 8 * 60 * 5


def test_chunks_of_other_sizes_go_on_with_the_best_so_far(spark, tmp_path, monkeypatch):
    """The last chunk is smaller, so more queries meet it at once."""
    monkeypatch.setattr(search, "SCORE_BYTES", 8 * 200 * 7)
    rng = np.random.default_rng(4)
    queries, parts = rng.integers(-3, 4, (60, 4)), [rng.integers(-3, 4, (n, 4)) for n in (200, 90, 3, 200)]
    blocks, found, rows = _blocks(spark, tmp_path, queries.astype(float).tolist()), {}, []
    for first, part in zip((0, 1000, 2000, 3000), parts):
        chunk = _chunk(part, first)
        rows += zip(chunk.column("blob_sha").to_pylist(), part)
        for batch in blocks.best(chunk, 5):
            for r in batch.to_pylist():
                found.setdefault(r["qid"], []).append((-r["score"], r["blob_sha"]))
    for i, q in enumerate(queries):
        assert sorted(found[i])[:5] == sorted((-float(v @ q), sha) for sha, v in rows)[:5]


def test_ties_stay_numbers_until_k_are_left(spark, tmp_path, monkeypatch):
    """Of a chunk of copies, which tie all, no more than k rows of a query are ever made, and those are the first by id."""
    blocks, chunk, made, table = _blocks(spark, tmp_path, [[1.0, 2.0]] * 10), _chunk([[0.5, 0.5]] * 300), [], pa.table
    monkeypatch.setattr(search.pa, "table", lambda *a, **b: made.append(table(*a, **b)) or made[-1])
    found = [r for batch in blocks.best(chunk, 4) for r in batch.to_pylist()]
    assert sum(t.num_rows for t in made) == len(found) == 40
    assert {r["blob_sha"] for r in found} == {f"{i:040x}" for i in range(1, 5)}


def test_queries_are_kept_by_what_they_take_in_memory(spark, tmp_path, monkeypatch):
    """Equal vectors take little in a file."""
    monkeypatch.setattr(search, "KEPT_QUERY_BYTES", 100_000)
    blocks = _blocks(spark, tmp_path, [[1.0] * 64] * 1000)
    assert blocks.files.get_file_info(blocks.names[0]).size < 100_000
    assert sum(len(list(blocks.best(_chunk([[1.0] * 64] * 3), 2))) for _ in range(2)) >= 2
    assert not blocks.read and blocks.seen_bytes == 1000 * 2 * 8


def test_shown_files_are_chosen_before_they_are_split(spark):
    files = spark.createDataFrame([(f"f{i}.txt", f"a\nb{i}\nc".encode()) for i in range(20)] + [("none.txt", None)], "path string, content binary")
    hits = spark.createDataFrame([("f3.txt", 2, 3, 0.5, "x", 0), ("gone.txt", 1, 1, 0.4, "y", 0), ("f4.txt", 2, 9, 0.3, "z", 0)], "path string, start_line int, end_line int, score double, blob_sha string, chunk_idx int")
    shown = search.show_lines(hits, files)
    assert {r["path"]: r["lines"] for r in shown.collect()} == {"f3.txt": ["b3", "c"], "gone.txt": None, "f4.txt": ["b4", "c"]}
    plan = shown._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not [n for n in plan.split("\n\n") if "Exchange" in n.split("\n")[0] and "content" in n]
