"""Preprocessing of edge tables: filters, symmetry, encoding, degrees, adjacency, connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedup(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst); with other columns, the row with the least values stays."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    if not extra:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(F.min(F.struct(*extra)).alias("x")).select("src", "dst", "x.*")


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra)
    return dedup(edges.select("src", "dst", *extra).unionByName(back))


def dense_rank_ids(rows: DataFrame, order: list[str], folder: str, start: int = 0) -> DataFrame:
    """rows with a column rank: 0, 1, ... in a total order, without one task for all rows.

    Rows are range-partitioned and written with their place in their partition; a running sum over the partitions'
    counts (one short row each) gives the offsets.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("__id", F.monotonically_increasing_id()), folder)
    part, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__offset") + at + F.lit(start)).drop("__part", "__offset", "__id")


def encode_labels(lines: DataFrame, folder: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices (id, origin), edges (src, dst)) of lines (line_no, a, b): labels numbered in the order they first occur.

    folder: a shared working folder. start: 0, or 1 as the older reader counts.
    """
    seen = lines.select((F.col("line_no") * 2).alias("at"), F.col("a").alias("origin")).unionByName(lines.select((F.col("line_no") * 2 + 1).alias("at"), F.col("b").alias("origin")))
    firsts = seen.groupBy("origin").agg(F.min("at").alias("at"))
    vertices = dense_rank_ids(firsts, ["at", "origin"], f"{folder}/labels", start).select(F.col("rank").alias("id"), "origin")
    a, b = (vertices.select(F.col("id").alias(i), F.col("origin").alias(o)) for i, o in (("src", "a"), ("dst", "b")))
    return vertices, lines.join(a, "a").join(b, "b").select("src", "dst")


def max_id_vertices(edges: DataFrame) -> DataFrame:
    """All ids from 0 to the largest in use: ids without edges count as vertices."""
    spark = edges.sparkSession
    top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return spark.range(0, 0 if top is None else top + 1)


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbors): sorted neighbour lists. A row holds all of one vertex, so use it for lookups, not for loops."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))


def neighbor_at(edges: DataFrame, index: int) -> DataFrame:
    """(id, neighbor): the neighbour at an index (from 0) of each vertex's sorted list, null past its end."""
    place = Window.partitionBy("src").orderBy("dst")
    ranked = edges.select("src", "dst").distinct().withColumn("r", F.row_number().over(place) - 1)
    return ranked.groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("r") == index, F.col("dst"))).alias("neighbor"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def with_endpoint_degree(edges: DataFrame, end: str = "dst") -> DataFrame:
    """Edges with the degree of one end."""
    d = degrees(edges).select(F.col("id").alias(end), "degree")
    return edges.join(d, end, "left").select(*edges.columns, F.coalesce("degree", F.lit(0)).alias("degree"))


def clique_connections(components: DataFrame) -> DataFrame:
    """Edges that connect all components pairwise through their least vertices (id, component).

    The result is every pair of components, so it suits graphs of few; star_connections needs one edge for each.
    """
    reps = components.groupBy("component").agg(F.min("id").alias("rep"))
    a, b = (reps.select(F.col("rep").alias(c)) for c in ("src", "dst"))
    return a.join(b, F.col("src") != F.col("dst"))


def star_connections(vertices: DataFrame, reached: DataFrame, root) -> DataFrame:
    """Edges (both directions) from a root to every vertex (id) that is not reached (id)."""
    lost = vertices.select("id").join(reached.select("id"), "id", "left_anti")
    out = lost.select(F.lit(root).cast("long").alias("src"), F.col("id").alias("dst"))
    return out.unionByName(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def unreachable(vertices: DataFrame, reached: DataFrame) -> DataFrame:
    return vertices.select("id").join(reached.select("id"), "id", "left_anti")
