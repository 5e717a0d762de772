"""Seeded graph generators. Every random number is a function of (seed, row, draw), so partitioning changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import draw, uniform
from ..graph import Graph
from ..storage import work_folder, written
from .preprocess import dense_rank_ids, symmetrize

# Quadrant probabilities of the public Kronecker benchmark.
A, B, C = 0.57, 0.19, 0.19


def check_num_edges(nodes: int, edges: int, digraph: bool = False, loops: bool = False) -> None:
    """Whether a simple connected graph of this size exists."""
    most = nodes * (nodes - 1) // (1 if digraph else 2) + (nodes if loops else 0)
    if not nodes - 1 <= edges <= most:
        raise ValueError(f"{nodes} nodes need {nodes - 1} to {most} edges, not {edges}")


def edge_set(edges: DataFrame, loops: bool = False, multigraph: bool = False, digraph: bool = False) -> DataFrame:
    """Edges as a graph kind allows them, in order: loops and repeats (of either direction) go unless allowed."""
    if not loops:
        edges = edges.where("src <> dst")
    if not digraph:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return (edges if multigraph else edges.distinct()).orderBy("src", "dst")


def _tree(spark: SparkSession, nodes: int, seed: int, walk: bool) -> DataFrame:
    """A spanning tree on 1..nodes. walk: a vertex hangs on one shortly before it, as in a walk's first visits; else on
    any vertex before it."""
    v = spark.range(2, nodes + 1).select(F.col("id").alias("v"))
    u = uniform(seed, F.col("v"))
    back = F.floor(u * u * (F.col("v") - 1)) if walk else F.floor(u * (F.col("v") - 1))
    parent = F.col("v") - 1 - back if walk else back + 1
    order = lambda c: c.cast("long")
    return v.select(order(parent).alias("src"), order(F.col("v")).alias("dst"))


def _random_edges(spark: SparkSession, nodes: int, first: int, count: int, seed: int) -> DataFrame:
    row = F.col("id")
    return spark.range(first, first + count).select((F.floor(uniform(seed, row, 1) * nodes) + 1).cast("long").alias("src"), (F.floor(uniform(seed, row, 2) * nodes) + 1).cast("long").alias("dst"))


def random_connected(spark: SparkSession, nodes: int, edges: int, approach: str = "random_walk", digraph: bool = False, seed: int = 42) -> Graph:
    """A connected graph of exactly so many distinct edges, on nodes 1..nodes with their labels as origin.

    approach: "random_walk" or "partition" grow a spanning tree and fill up with random edges; "naive" draws random
    edges only and raises if they don't connect. Edges are filled up in rounds: draws are deduplicated and those with
    the least hash kept. Wilson's algorithm is named by some interfaces; it is not implemented.
    """
    check_num_edges(nodes, edges, digraph)
    if approach == "wilsons_algo":
        raise NotImplementedError(approach)
    if approach not in ("random_walk", "partition", "naive"):
        raise ValueError(f"unknown approach {approach!r}")
    folder = work_folder(spark, "generate")
    ends = [F.col("src"), F.col("dst")] if digraph else [F.least("src", "dst"), F.greatest("src", "dst")]
    norm = lambda df: df.where("src <> dst").select(ends[0].alias("src"), ends[1].alias("dst")).distinct()
    tree = spark.createDataFrame([], "src long, dst long") if approach == "naive" else _tree(spark, nodes, seed, approach == "random_walk")
    have = written(norm(tree), f"{folder}/0")
    drawn, k = 0, 0
    while (missing := edges - have.count()) > 0:
        k += 1
        more = 2 * missing + 16
        new = norm(_random_edges(spark, nodes, drawn, more, seed + 1)).join(have, ["src", "dst"], "left_anti")
        drawn += more
        ranked = dense_rank_ids(new.withColumn("h", draw(seed, F.col("src"), F.col("dst") % 2147483647)), ["h", "src", "dst"], f"{folder}/new{k}")
        have = written(have.unionByName(ranked.where(F.col("rank") < missing).select("src", "dst")), f"{folder}/{k}")
    vertices = spark.range(1, nodes + 1).select("id", F.col("id").cast("string").alias("origin"))
    graph = Graph(vertices, have if digraph else symmetrize(have), f"uni_{nodes}V_{edges}E.graph", digraph)
    if approach == "naive":
        from .algorithms import connected_components

        if connected_components(graph).select("color").distinct().count() > 1:
            raise ValueError("the drawn edges don't connect the graph; take more edges or another approach")
    return graph


def scramble(v: Column, scale: int, seed: int) -> Column:
    """A permutation of [0, 2**scale): odd multiplications, additions and shifts, each of them invertible."""
    mask = F.lit((1 << scale) - 1)
    half = max(1, scale // 2)
    for k in range(3):
        v = (v * F.lit((2 * (seed * 7919 + k * 104729) + 1) % (1 << min(scale, 30)) | 1) + F.lit(seed * 31 + k)).bitwiseAND(mask)
        v = v.bitwiseXOR(F.shiftright(v, half))
    return v


def _placed_bits(spark: SparkSession, scale: int, edge_factor: int, quadrant) -> DataFrame:
    """(src, dst) whose bits are dealt by quadrant(bit): a number of 0 to 3, the upper bit of it for src."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), quadrant)
    fold = lambda take: F.aggregate("q", F.lit(0).cast("long"), lambda acc, q: acc * 2 + take(q))
    raw = spark.range(edge_factor << scale).select("id", bits.alias("q"))
    return raw.select(fold(lambda q: F.shiftright(q, 1)).alias("src"), fold(lambda q: q % 2).alias("dst"))


def _in_quadrant(u: Column, a: Column, b: Column, c: Column) -> Column:
    """0 to 3 of a number by the upper ends of the first three quadrants."""
    return F.when(u < a, 0).when(u < b, 1).when(u < c, 2).otherwise(3).cast("long")


def kronecker(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 42, scrambled: bool = True) -> DataFrame:
    """(src, dst): edge_factor * 2**scale raw edges, loops and repeats included.

    Each bit of an edge falls into a quadrant with probabilities A, B, C and the rest; ends are flipped to the upper
    triangle and ids scrambled.
    """

    def quadrant(bit: Column) -> Column:
        return _in_quadrant(uniform(seed, F.col("id"), bit), F.lit(A), F.lit(A + B), F.lit(A + B + C))

    raw = _placed_bits(spark, scale, edge_factor, quadrant)
    src, dst = F.least("src", "dst"), F.greatest("src", "dst")
    raw = raw.select(src.alias("src"), dst.alias("dst"))
    return raw.select(scramble(F.col("src"), scale, seed).alias("src"), scramble(F.col("dst"), scale, seed).alias("dst")) if scrambled else raw


def rmat(spark: SparkSession, scale: int, edge_factor: int = 8, seed: int = 42, noise: float = 0.05) -> DataFrame:
    """(src, dst): recursive quadrants whose probabilities are shaken by up to noise and normalised at every level, ids
    scrambled and edges in hashed order."""

    def quadrant(bit: Column) -> Column:
        row = F.col("id")
        shake = lambda p, k: F.lit(p) * (F.lit(1 - noise) + F.lit(2 * noise) * uniform(seed + 1, row, bit * 4 + k))
        a, b, c, d = shake(A, 0), shake(B, 1), shake(C, 2), shake(1 - A - B - C, 3)
        return _in_quadrant(uniform(seed, row, bit) * (a + b + c + d), a, a + b, a + b + c)

    raw = _placed_bits(spark, scale, edge_factor, quadrant)
    return shuffle_edges(raw.select(scramble(F.col("src"), scale, seed).alias("src"), scramble(F.col("dst"), scale, seed).alias("dst")), seed)


def permute_labels(vertices: DataFrame, folder: str, seed: int = 42) -> DataFrame:
    """(id, label): ids in the order of their hash get labels 0, 1, ..."""
    hashed = vertices.select("id").withColumn("h", draw(seed, F.col("id")))
    return dense_rank_ids(hashed, ["h", "id"], folder).select("id", F.col("rank").alias("label"))


def shuffle_edges(edges: DataFrame, seed: int = 42) -> DataFrame:
    """The same edges in hashed order."""
    return edges.orderBy(draw(seed, F.col("src"), F.col("dst") % 2147483647), "src", "dst")


def edge_weights(edges: DataFrame, seed: int = 42, most: int = 14, symmetric: bool = True) -> DataFrame:
    """edges with dist in 1..most, the same both ways or each direction with its own."""
    ends = (F.least("src", "dst"), F.greatest("src", "dst")) if symmetric else (F.col("src"), F.col("dst"))
    w = draw(seed, ends[0], ends[1] % 2147483647)
    return edges.withColumn("dist", F.lit(1) + (w % most))


def sample_roots(edges: DataFrame, count: int = 64, seed: int = 42) -> DataFrame:
    """(root): up to count distinct vertices with an edge that is no loop, those with the least hash."""
    d = edges.where("src <> dst").select(F.col("src").alias("root")).distinct()
    return d.orderBy(draw(seed, F.col("root")), "root").limit(count)
