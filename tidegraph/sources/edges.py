"""Edge sources: text and binary edge lists, root lists, and graphs derived from tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import tokens
from ..graph import Graph
from ..operators.algorithms import bfs, connected_components
from ..operators.preprocess import clique_connections, dedup, drop_self_loops, encode_labels, star_connections, symmetrize
from ..storage import work_folder, written


def _numbered(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(line_no, line): lines in the order of the files' names, then of their places; numbers rise with gaps.

    Spark reads the pieces of files in an order of its own, so a line's number is its piece's rank (one short row a
    piece is ranked) and its place in the piece.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), at.alias("at"), F.col("value").alias("line"))
    lines = written(lines, f"{folder}/raw")
    pieces = written(lines.select("file", "start").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file", "start")) - 1), f"{folder}/pieces")
    return written(lines.join(pieces, ["file", "start"]).select((F.shiftleft(F.col("rank").cast("long"), 33) + F.col("at")).alias("line_no"), "line"), f"{folder}/numbered")


def read_text_edges(spark: SparkSession, path: str, digraph: bool = False, connect: str = "none", legacy: bool = False) -> Graph:
    """A graph from a text edge list; vertices keep their labels as origin.

    The usual form: two labels a line divided by white space, # starts a comment; ids from 0. legacy: lines that don't
    start with two words divided by one white-space character are skipped; ids from 1. connect: "none", "star" (from
    the first vertex to all it doesn't reach) or "clique" (between representatives of all components).
    """
    folder = work_folder(spark, "text")
    lines = _numbered(spark, path, f"{folder}/lines")
    if legacy:
        pair = tokens(F.regexp_extract("line", r"^(\w+\s\w+)", 1))
        parsed = lines.select("line_no", pair.alias("p")).where("p is not null").select("line_no", F.col("p.first").alias("a"), F.col("p.second").alias("b"))
    else:
        words = F.split(F.trim(F.regexp_replace(F.regexp_replace("line", "#.*", ""), r"\s+", " ")), " ")
        parsed = lines.select("line_no", words.alias("w")).where("size(w) >= 2").select("line_no", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))
    vertices, edges = encode_labels(parsed, folder, start=1 if legacy else 0)
    edges = drop_self_loops(edges)
    edges = dedup(edges) if digraph else symmetrize(edges)
    graph = Graph(vertices, written(edges, f"{folder}/edges"), os.path.basename(path.rstrip("/")), digraph)
    return connected(graph, connect)


def connected(graph: Graph, connect: str = "star") -> Graph:
    """graph with edges that connect it, if it isn't: see read_text_edges. New edges lead both ways."""
    if connect == "none":
        return graph
    if connect == "star":
        first = graph.vertices.agg(F.min("id")).first()[0]
        reached = bfs(graph, first).state.where("parent is not null")
        new = star_connections(graph.vertices, reached, first)
    elif connect == "clique":
        new = clique_connections(connected_components(graph).withColumnRenamed("color", "component"))
    else:
        raise ValueError(f"unknown way to connect {connect!r}")
    extra = [F.lit(None).cast(t).alias(c) for c, t in graph.edges.dtypes if c not in ("src", "dst")]
    return graph.with_edges(dedup(graph.edges.unionByName(new.select("src", "dst", *extra))))


def count_nodes_and_edges(lines: DataFrame, digraph: bool = False) -> DataFrame:
    """One row (nodes, edges) of raw lines (line), without reading a graph: every line that is no loop counts, twice if
    the graph is undirected; repeats aren't looked for."""
    pairs = lines.select(tokens(F.regexp_extract("line", r"^(\w+\s\w+)", 1)).alias("p")).where("p is not null")
    ends = pairs.select(F.explode(F.array("p.first", "p.second")).alias("label"))
    nodes = ends.agg(F.count_distinct("label").alias("nodes"))
    edges = pairs.agg((F.coalesce(F.sum((F.col("p.first") != F.col("p.second")).cast("long")), F.lit(0)) * (1 if digraph else 2)).alias("edges"))
    return nodes.crossJoin(edges)  # two single rows


def read_balanced(spark: SparkSession, path: str, parts: int, places: int, digraph: bool = False) -> tuple[Graph, DataFrame]:
    """A legacy text graph and its round-robin placement; an error if a part has fewer places than vertices."""
    from ..operators.partition import robin

    graph = read_text_edges(spark, path, digraph, legacy=True)
    placed = robin(graph.vertices, parts, work_folder(spark, "robin"))
    most = placed.agg(F.max("local")).first()[0]
    if most is not None and most >= places:
        raise ValueError(f"a part needs {most + 1} places and has {places}")
    return graph, placed


def _records(spark: SparkSession, path: str | list[str], size: int) -> DataFrame:
    """(b) of the records of so many bytes of files or folders. Spark's record reader splits files of any size, and the
    records stay in the JVM."""
    paths = path if isinstance(path, str) else ",".join(path)
    if not paths:
        return spark.createDataFrame([], "b binary")
    raw = spark.sparkContext._jsc.binaryRecords(paths, size)
    frame = spark._jsparkSession.createDataset(raw.rdd(), spark._jvm.org.apache.spark.sql.Encoders.BINARY())
    return DataFrame(frame.toDF(), spark).withColumnRenamed("value", "b")


def read_binary_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(v0, v1) of raw little-endian 64-bit pairs of a file, a folder or a list of files, loops and repeats and all."""
    return _records(spark, path, 16).select(_little_long("b", 1).alias("v0"), _little_long("b", 9).alias("v1"))


def read_binary_roots(spark: SparkSession, path: str, most: int = 64) -> DataFrame:
    """(root) of raw little-endian 64-bit numbers, the first ones of the file."""
    return _records(spark, path, 8).limit(most).select(_little_long("b", 1).alias("root"))


def _little_long(column: str, at: int):
    """Eight bytes from a place (from 1) as a number, least significant first."""
    text = F.hex(F.substring(F.col(column), at, 8))
    turned = F.concat(*[F.substring(text, 15 - 2 * k, 2) for k in range(8)])
    return F.conv(turned, 16, -10).cast("long")


# Graphs of the relational tables: consecutive parts of an order.


def part_pairs(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    """(src, dst) of parts on consecutive lines of an order, loops and repeats included; condition: over the first."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    a = items.where(condition).select("l_orderkey", (F.col("l_linenumber") + 1).alias("next"), F.col("l_partkey").alias("src"))
    b = items.select("l_orderkey", F.col("l_linenumber").alias("next"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "next"]).select("src", "dst")


def part_graph(spark: SparkSession, sf_dir: str, condition: str = "true", name: str = "G") -> Graph:
    """The undirected graph of part_pairs, with symmetric weights 1..14 in the column dist."""
    edges = symmetrize(drop_self_loops(part_pairs(spark, sf_dir, condition)))
    weight = F.lit(1) + (31 * F.least("src", "dst") + 17 * F.greatest("src", "dst")) % 14
    edges = edges.withColumn("dist", weight)
    return Graph(edges.select(F.col("src").alias("id")).distinct(), edges, name)


def place_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, their nations, and the nations' customers and suppliers: one tree for each region. Ids are 4 * key + kind
    (0 region, 1 nation, 2 customer, 3 supplier)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pair = lambda t, a, x, b, y: read(t).select((4 * F.col(a).cast("long") + x).alias("src"), (4 * F.col(b).cast("long") + y).alias("dst"))
    up = pair("nation", "n_regionkey", 0, "n_nationkey", 1).unionByName(pair("customer", "c_nationkey", 1, "c_custkey", 2)).unionByName(pair("supplier", "s_nationkey", 1, "s_suppkey", 3))
    return Graph.of(up, "places")


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their orders: one star for each customer. Ids are 2 * key, and 2 * key + 1 for orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return Graph.of(o.select((2 * F.col("o_custkey").cast("long")).alias("src"), (2 * F.col("o_orderkey").cast("long") + 1).alias("dst")), "orders")
