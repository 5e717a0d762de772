"""Connected components in few rounds: alternating large-star and small-star steps.

Each round points every vertex at the least id it can see: a large star joins a vertex's larger neighbours to the least
of its neighbourhood, a small star does so for the smaller ones. The number of rounds grows with the logarithm of the
number of vertices, not with the diameter. State is an edge table; every round is two aggregations that combine before
the shuffle, and a vertex with very many neighbours is only ever an aggregation key or the skewed side of an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_path, spread, written


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(spread(least, 2 * rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """edges: a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(spread(least, rows), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def star_components(edges: DataFrame, folder: str, max_rounds: int = 100) -> DataFrame:
    """(id, component): the least id of its component for every id of edges (a, b); the least ids themselves included.

    Self-loops and repeated edges are allowed; rows with a null end are dropped. folder: a shared working folder. Labels
    that still move after max_rounds rounds are an error.
    """
    ids = edges.where("a is not null and b is not null")
    state = written(ids.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/stars0")
    loops = ids.select(F.col("a").alias("id")).where("a = b")
    before, k = (state.count(), None), 0
    while k < max_rounds:
        k += 1
        state = written(_small_star(_large_star(state, before[0]), 2 * before[0]), f"{folder}/stars{k}")
        drop_path(state.sparkSession, f"{folder}/stars{k - 2}")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    members = state.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("id"), F.col("b").alias("component")).unionByName(loops.select("id", F.col("id").alias("component"))).distinct()
    alone = roots.join(spread(members.select("id"), before[0]), "id", "left_anti")
    return members.unionByName(alone)
