import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect

from lumenseek.llm import ballkmeans


def plain(rows, k, rounds, scale, seed, dim):
    """Lloyd's algorithm over all centroids in Python's integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    centroids = [q for _, q in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [q for (_, q), (_, c) in zip(kept, found) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr), centroids


def test_query_equals_sql(spark, sf_dir):
    assert_same(spark, connect(sf_dir), ballkmeans.op13_ball_kmeans, ballkmeans.ORACLE_SQL, sf_dir)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_plain_version_with_ties_and_awkward_rows(spark, seed):
    rng = np.random.default_rng(seed)
    # few values: many ties, repeated vectors, clusters that lose all their members
    rows = [(int(i % 90), [float(x) for x in rng.integers(-3, 4, 2)]) for i in range(150)] + [(None, [1.0, 1.0]), (None, [2.0, 0.5])]
    rows += [(500, None), (501, []), (502, [1.0]), (503, [1.0, None]), (504, [float("nan"), 0.0]), (505, [0.0, float("inf")]), (506, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, q string").repartition(3)
    found, centroids = ballkmeans.cluster(df, dim=2, k=12, rounds=4, scale=2, seed=7)
    expected, final = plain(rows, 12, 4, 2, 7, 2)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == expected
    assert centroids.tolist() == final


def test_fewer_vectors_than_clusters_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    found, centroids = ballkmeans.cluster(df, dim=2)
    assert len(centroids) == 2 and [r["distance"] for r in found.collect()] == [0, 0]
    found, centroids = ballkmeans.cluster(df.where("vec_id > 5"), dim=2)
    assert found.count() == 0 and len(centroids) == 0


def test_components_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="must be below"):
        ballkmeans.cluster(df, dim=2)


def test_empty_embeddings_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = ballkmeans.op13_ball_kmeans(spark, str(tmp_path))
    assert found.count() == 0 and found.columns == [c.split()[0] for c in ballkmeans.SCHEMA.split(", ")]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 3), st.sampled_from([3, 40, 1 << 25]))
def test_annuli_lose_no_nearer_centroid(seed, k, dim, size):
    rng = np.random.default_rng(seed)
    x, before = rng.integers(-size, size + 1, (60, dim)), rng.integers(-size, size + 1, (k, dim))
    own, distance = ballkmeans.nearest(x, before)
    radii = np.array([distance[own == i].max(initial=-1) for i in range(k)])
    after = before + rng.integers(-size // 3, size // 3 + 1, (k, dim)) * (rng.random((k, 1)) < 0.5)
    found = ballkmeans.moved(x, own, distance, ballkmeans.balls(after, before, radii))
    every = np.stack([ballkmeans.squared(x, c) for c in after])
    assert found[0].tolist() == every.argmin(0).tolist() and found[1].tolist() == every.min(0).tolist()


def test_neighbours_are_fewer_than_clusters():
    """On separated groups most pairs of clusters are never compared."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (30, 8))
    x = (centres[rng.integers(0, 30, 3000)] + rng.integers(-20, 21, (3000, 8))).astype(np.int64)
    own, distance = ballkmeans.nearest(x, centres)
    state = ballkmeans.balls(centres + 1, centres, np.array([distance[own == i].max(initial=-1) for i in range(30)]))
    assert state.relevant.sum() < 30 * 29 / 10
