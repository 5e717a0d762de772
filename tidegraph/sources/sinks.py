"""Sinks: edge lists as text, DOT, GML and binary, and final states."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import drop_others, open_new


def text_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws(" ", "src", "dst").alias("line"))


def one_based_lines(edges: DataFrame) -> DataFrame:
    """Edges as text with ids from 1, without loops."""
    return edges.where("src <> dst").select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1).alias("line"))


def dot_lines(graph: Graph, name: str = "last_graph") -> DataFrame:
    """(at, line) of a DOT file: a line for each undirected edge, one for each vertex without edges; order by at, line."""
    e = graph.edges.where("src < dst").select(F.lit(1).alias("at"), F.concat_ws(" -- ", "src", "dst").alias("line"))
    alone = graph.vertices.select("id").join(graph.edges.select(F.col("src").alias("id")), "id", "left_anti")
    frame = graph.vertices.sparkSession.createDataFrame([(0, f"graph {name} {{"), (2, "}")], "at int, line string")
    return frame.unionByName(e).unionByName(alone.select(F.lit(1).alias("at"), F.col("id").cast("string").alias("line")))


def gml_lines(graph: Graph) -> DataFrame:
    """(at, key, line) of a GML file: a block for each vertex, then one for each edge (each undirected edge once)."""
    pad = "    "
    block = lambda kind, rows: F.concat_ws("\n", F.lit(f"{pad}{kind} ["), *rows, F.lit(f"{pad}]"))
    field = lambda name, c: F.concat(F.lit(f"{pad * 2}{name} "), c.cast("string"))
    label = F.col("origin") if "origin" in graph.vertices.columns else F.col("id")
    quoted = F.concat(F.lit('"'), label.cast("string"), F.lit('"'))
    nodes = graph.vertices.select(F.lit(1).alias("at"), F.struct(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("key"), block("node", [field("id", F.col("id")), field("label", quoted)]).alias("line"))
    e = graph.edges if graph.directed else graph.edges.where("src <= dst")
    edges = e.select(F.lit(2).alias("at"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b")).alias("key"), block("edge", [field("source", F.col("src")), field("target", F.col("dst"))]).alias("line"))
    head = "graph [" + (f"\n{pad}directed 1" if graph.directed else "")
    frame = graph.vertices.sparkSession.createDataFrame([(0, (0, 0), head), (3, (0, 0), "]")], "at int, key struct<a:long,b:long>, line string")
    return frame.unionByName(nodes).unionByName(edges)


def write_text(lines: DataFrame, path: str, ordered_by: list[str] | None = None) -> None:
    """Lines as a folder of text files; ordered ones keep their order from file to file."""
    out = lines.orderBy(*ordered_by) if ordered_by else lines
    out.select("line").write.mode("overwrite").text(path)


def write_binary_edges(edges: DataFrame, folder: str) -> list[str]:
    """Raw little-endian 64-bit pairs, one file a partition; returns the files that the finished job stands by.

    A task that is run again writes a file of its own, and only one of them is named here: read these, not the folder.
    Files that the job doesn't stand by are removed.
    """
    run = uuid.uuid4().hex[:8]

    def write(batches):
        import numpy as np
        import pandas as pd

        name, out, n = f"{folder}/{run}-{TaskContext.get().partitionId():07d}-{TaskContext.get().taskAttemptId()}.bin", None, 0
        for batch in batches:
            if len(batch):
                out = out or open_new(name)
                out.write(np.ascontiguousarray(batch[["src", "dst"]].to_numpy(), dtype="<i8").tobytes())
                n += len(batch)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "n": [n]})

    done = sorted(r["path"] for r in edges.select("src", "dst").mapInPandas(write, "path string, n long").collect())
    drop_others(edges.sparkSession, folder, f"{run}-", done)
    return done


def write_state(state: DataFrame, vertices: DataFrame, path: str) -> None:
    """The final state with each vertex's label, as Parquet."""
    origin = vertices.select("id", "origin") if "origin" in vertices.columns else vertices.select("id", F.col("id").cast("string").alias("origin"))
    state.join(origin, "id").write.mode("overwrite").parquet(path)
