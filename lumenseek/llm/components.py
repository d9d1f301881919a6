"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is one aggregation and one join on the edges, whose result is written to the shared folder; no edge is
collected. Nodes with many edges are told first and their least neighbours are broadcast, so that a hub's edges stay spread over all tasks;
as their degrees add up to the edges' ends, they are ``MOST_HUBS`` at most at any size. The steps end when a round changes no edge,
after a number of rounds that grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenseek.llm import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Nodes of so many edges are hubs, or of more if there could be more than MOST_HUBS of those.
HUB_EDGES = 100
MOST_HUBS = 50_000
#: So few rows are no burden to one task.
FEW_EDGES = 2_000


def _with_least(rows: DataFrame, ends: int, files: int | None) -> DataFrame:
    """u, v and m of the rows (u, v): the least v of all rows with that u. ``ends``: as many rows as there are at most."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if ends <= FEW_EDGES:
        return rows.join(least, "u").select("u", "v", "m")
    hubs = common.materialize(least.where(F.col("n") > max(HUB_EDGES, ends // MOST_HUBS)).select("u", "m"), "hubs", files)
    others = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return rows.join(F.broadcast(hubs), "u").select("u", "v", "m").union(others.join(others.groupBy("u").agg(F.min("v").alias("m")), "u").select("u", "v", "m"))


def _large_star(edges: DataFrame, n: int, files: int | None) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n, files).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int, files: int | None) -> DataFrame:
    told = _with_least(edges, n, files)
    return told.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(told.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """node and component (the least node reachable) for every node of the edges (columns a and b; any order, repeats and loops allowed).

    Null nodes are ignored; no edges give no rows. ``files``: of each step's table, at most.
    """
    current = common.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", files)
    state = _state(current)
    while state[0]:
        large = common.materialize(_large_star(current, state[0], files), "edges", files)
        common.discard(current)
        current = common.materialize(_small_star(large, state[0], files), "edges", files)
        common.discard(large)
        following = _state(current)
        if following == state:
            break
        state = following
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
