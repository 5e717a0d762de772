"""The graph value: two DataFrames, vertices (id, ...) and edges (src, dst, ...).

An undirected graph stores both directions of every edge. Ids are logical; placement on partitions is derived by the
partitioners and never part of an id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    name: str = "graph"
    directed: bool = False

    @classmethod
    def of(cls, edges: DataFrame, name: str = "graph", directed: bool = False, vertices: DataFrame | None = None) -> Graph:
        """A graph from raw edges (src, dst, ...): self-loops and repeats go; undirected ones get both directions.

        Other edge columns stay if the edges are directed; for undirected graphs they must be symmetric.
        """
        from .operators.preprocess import dedup, drop_self_loops, symmetrize

        e = drop_self_loops(edges)
        e = dedup(e) if directed else symmetrize(e)
        if vertices is None:
            vertices = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
        return cls(vertices, e, name, directed)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.vertices, edges, self.name, self.directed)

    def out_degrees(self) -> DataFrame:
        """(id, degree) of all vertices, 0 for those without edges."""
        d = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def co_located(self, by: str = "src", partitions: int | None = None) -> Graph:
        """Edges dealt by one end and kept, so that every superstep only moves updates or messages.

        A lost executor's share is read and dealt again from the edges' source.
        """
        n = partitions or int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.with_edges(self.edges.repartition(n, by).persist())

    def release(self) -> None:
        self.edges.unpersist()
