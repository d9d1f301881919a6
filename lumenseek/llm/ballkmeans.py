"""Ball k-means on integer vectors, exact in every step.

A cluster is a ball: its centroid and a radius that covers its members. Another cluster can only take members of a ball if its
centroid is nearer than twice the radius; those are the ball's neighbours. Of a vector at distance d from its centroid only
neighbours within 2 d matter, so a ball falls into a stable core, whose vectors are nearer to the centroid than half the way to the next neighbour
and stay, and annuli between the half distances of one neighbour and the next, whose vectors are compared with the neighbours of
their annulus and those inside it. Balls that did not move, and whose neighbours did not, keep all their members unseen.

All comparisons are of squared distances in whole numbers, so every assignment, ties included, is the one that comparing all
centroids would give. A round is one pass over the vectors, which lie as a table with their present cluster, and one small
aggregation; the driver holds the k centroids and nothing that grows with the input. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenseek.llm import common

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors that a worker looks at together.
ROWS = 4096

SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
_STATE = "vec_id bigint, q array<int>, cluster int, distance bigint"


def largest(dim: int) -> int:
    """Components are less than this, so that four times a squared distance fits into 64 bits."""
    return min(isqrt((1 << 62) // (16 * dim)), (1 << 31) - 1)


class Balls(NamedTuple):
    """k clusters as balls. Row i of ``near`` names the other clusters by their distance from i, ``gaps`` has those distances squared,
    ``relevant`` tells how many of them are neighbours, and ``still`` whether neither i nor one of its neighbours has moved."""

    centroids: np.ndarray
    near: np.ndarray
    gaps: np.ndarray
    relevant: np.ndarray
    still: np.ndarray


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    apart = x - y
    return np.einsum("...i,...i->...", apart, apart)


def balls(centroids: np.ndarray, before: np.ndarray | None = None, radii: np.ndarray | None = None) -> Balls:
    """``radii``: the largest squared distance of a member of each cluster from the centroid ``before``; -1 for clusters without members.

    A centroid that moved by m has its members within the old radius plus m; square roots are rounded up, so a ball is never too small.
    """
    k = len(centroids)
    gaps = squared(centroids[:, None], centroids[None])
    near = np.argsort(gaps + np.where(np.eye(k, dtype=bool), -1, 0), axis=1, kind="stable")[:, 1:]
    gaps = np.take_along_axis(gaps, near, 1)
    relevant, still = np.full(k, k - 1), np.zeros(k, bool)
    if before is not None:
        moves = squared(centroids, before)
        for i in range(k):
            radius = (isqrt(int(radii[i])) + 1 if radii[i] > 0 else 0) + (isqrt(int(moves[i])) + 1 if moves[i] else 0)
            relevant[i] = sum(gap <= 4 * radius * radius for gap in gaps[i].tolist())
        for i in range(k):
            still[i] = not moves[i] and not moves[near[i, : relevant[i]]].any()
    return Balls(centroids, near, gaps, relevant, still)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector, by comparing all centroids; ties go to the smaller number."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if x.shape[1] * 4 * top * top < 1 << 52:  # doubles hold all sums exactly
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        own = ((b * b).sum(1) - 2 * (a @ b.T)).argmin(1)
        return own, squared(x, centroids[own])
    best, own = squared(x, centroids[0]), np.zeros(len(x), np.int64)
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        own[d < best] = j
        np.minimum(best, d, out=best)
    return own, best


def moved(x: np.ndarray, own: np.ndarray, distance: np.ndarray, state: Balls) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each vector after the centroids changed; ``own`` and ``distance`` are those before."""
    own, distance = own.copy(), distance.copy()
    open_ = np.flatnonzero(~state.still[own])
    distance[open_] = squared(x[open_], state.centroids[own[open_]])
    home = own[open_]
    for i in np.unique(home):
        m = int(state.relevant[i])
        rows = open_[home == i]
        # how many neighbours are within twice each vector's distance: 0 in the stable core, its annulus otherwise
        annulus = np.searchsorted(state.gaps[i, :m], 4 * distance[rows], "right")
        rows, annulus = rows[annulus > 0], annulus[annulus > 0]
        at = distance[rows]
        for step in range(int(annulus.max(initial=0))):
            part = annulus > step
            j = int(state.near[i, step])
            d = squared(x[rows[part]], state.centroids[j])
            better = (d < at[part]) | ((d == at[part]) & (j < own[rows[part]]))
            which = np.flatnonzero(part)[better]
            own[rows[which]], at[which] = j, d[better]
        distance[rows] = at
    return own, distance


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def whole_numbers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components times ``scale`` rounded down, of the vectors with ``dim`` components, none of them null or not finite."""
    v = F.col("embedding")

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    def whole(x: Column) -> Column:
        y = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) < largest(dim), y.cast("int")).otherwise(F.raise_error(F.lit(f"components times {scale} must be below {largest(dim)}")).cast("int"))

    usable = F.coalesce((F.size(v) == dim) & F.forall(v, finite), F.lit(False))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, whole).alias("q"))


def starting_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k least hashes of seed and vec_id (null: empty), ties by their components; fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["q"] for r in kept.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()], np.int64)


def _assigned(rows: DataFrame, state: Balls, first: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(state)
    dim = state.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column("q"), dim)
                if first:
                    own, distance = nearest(x, state.centroids)
                else:
                    own, distance = moved(x, part.column("cluster").to_numpy().astype(np.int64), part.column("distance").to_numpy(), state)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("q"), pa.array(own, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "q", "cluster", "distance"])

    return rows.mapInArrow(run, _STATE)


def _members(table: DataFrame, k: int, dim: int) -> list:
    """One row for each cluster with members: cluster, n, radius (the largest distance), and the sums of all components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, sums = np.zeros(k, np.int64), np.full(k, -1), np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, own = _matrix(part.column("q"), dim), part.column("cluster").to_numpy()
                n += np.bincount(own, minlength=k)
                np.maximum.at(radius, own, part.column("distance").to_numpy())
                order = np.argsort(own, kind="stable")
                firsts = np.flatnonzero(np.diff(own[order], prepend=-1))
                sums[own[order][firsts]] += np.add.reduceat(x[order], firsts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(radius[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "radius", "sums"])

    told = table.select("q", "cluster", "distance").mapInArrow(run, "cluster int, n bigint, radius bigint, sums array<bigint>")
    added = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
    return told.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), *added).collect()


class Clustering(NamedTuple):
    vectors: DataFrame  # vec_id, q, cluster, distance
    centroids: np.ndarray


def cluster(vectors: DataFrame, *, dim: int = DIM, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> Clustering:
    """Clusters of ``vectors`` (vec_id and embedding; other columns are ignored) after ``rounds`` moves of the centroids, which are whole numbers, rounded down.

    Vectors of another length, null ones, and those with null or infinite components or NaN are left out. Repeated rows count each. A null vec_id stays null.
    Without vectors there are no clusters and no rows. Components of 2**31 or so after scaling end the query with an error.
    """
    kept = whole_numbers(vectors, dim, scale)
    centroids = starting_centroids(kept, k, seed)
    if not len(centroids):
        return Clustering(vectors.sparkSession.createDataFrame([], _STATE), np.zeros((0, dim), np.int64))
    table = common.materialize(_assigned(kept, balls(centroids), first=True), "balls")
    for _ in range(rounds):
        after, radii = centroids.copy(), np.full(len(centroids), -1)
        for row in _members(table, len(centroids), dim):
            after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
            radii[row["cluster"]] = row["radius"]
        following = common.materialize(_assigned(table, balls(after, centroids, radii), first=False), "balls")
        common.discard(table)
        table, centroids = following, after
    return Clustering(table, centroids)


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kept vector's cluster and distance, with its cluster's and the whole inertia and the cluster's final centroid as a hash."""
    found, centroids = cluster(common.table(spark, sf_dir, "embeddings"))
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(wide.alias("s")).collect()}  # k rows at most
    total = sum(sums.values())
    rows = [(i, s, total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, s in sorted(sums.items())]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS) -> str:
    parts = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND list_aggregate(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), 'bool_and')),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS m FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM k ORDER BY h, q LIMIT {K}))"""
    ]
    distance = f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: (q[i] - m[i]) * (q[i] - m[i])))"
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, q, c, m, {distance} AS d FROM k, c{t}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if t < rounds:
            parts.append(f"""s{t} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({DIM})) AS i FROM a{t}) GROUP BY c, i),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{t} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{t} GROUP BY c) n USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds}"""


ORACLE_SQL = _oracle()
