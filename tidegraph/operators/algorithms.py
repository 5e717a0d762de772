"""The graph algorithms: vertex programs for the superstep engine, and joins where no loop is needed.

Choices where implementations differ: undefined values are null; a root is its own parent; parents are the least
vertex that qualifies, so results don't depend on arrival order; distances are 64-bit; PageRank starts at 1/N.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.superstep import Program, Relay, Run, register, relay, run
from ..storage import checkpointed, work_folder, written
from .preprocess import degrees
from .stars import star_components

DAMPING = 0.85
ROUNDS = 30


@register("bfs")
def bfs_program(root: int) -> Program:
    """State parent and level: levels from a root, parents the least neighbour on the level above."""
    is_root = F.col("id") == F.lit(root)
    new = F.col("parent").isNull() & F.col("least").isNotNull()
    return Program(
        "bfs",
        init={"parent": F.when(is_root, F.col("id")), "level": F.when(is_root, F.lit(0))},
        active=F.col("parent").isNotNull(),
        send={"sender": F.col("sender")},
        gather={"least": F.min("msg_sender")},
        apply={"parent": F.coalesce("parent", "least"), "level": F.when(new, F.col("step") + 1).otherwise(F.col("level"))},
        activate=new,
    )


@register("cc")
def cc_program() -> Program:
    """State color: the least id that reaches a vertex."""
    lower = F.col("least") < F.col("color")
    return Program("cc", {"color": F.col("id")}, F.lit(True), {"color": F.col("color")}, {"least": F.min("msg_color")}, {"color": F.least("color", "least")}, lower)


@register("sssp")
def sssp_program(root: int, most: int | None = None) -> Program:
    """State dist and parent, over edges with a non-negative integer column edge_dist.

    most: distances saturate there, as in a register of few bits; what would be that far counts as not reached.
    """
    is_root = F.col("id") == F.lit(root)
    offer = F.col("offer")
    better = offer["dist"].isNotNull() & (F.col("dist").isNull() | (offer["dist"] < F.col("dist")))
    reach = F.col("dist") + F.col("edge_dist")
    return Program(
        "sssp",
        init={"dist": F.when(is_root, F.lit(0)).cast("long"), "parent": F.when(is_root, F.col("id"))},
        active=F.col("dist").isNotNull(),
        send={"dist": F.col("dist") + F.col("edge_dist"), "sender": F.col("sender")},
        gather={"offer": F.min(F.struct(F.col("msg_dist").alias("dist"), F.col("msg_sender").alias("sender")))},
        apply={"dist": F.when(better, offer["dist"]).otherwise(F.col("dist")), "parent": F.when(better, offer["sender"]).otherwise(F.col("parent"))},
        activate=better,
        send_if=None if most is None else reach < most,
    )


@register("pr")
def pagerank_program(n: int, rounds: int = ROUNDS, init_sum: str = "spec") -> Program:
    """State rank over vertices with a column degree: R_0 and rounds - 1 propagations; sums are not redistributed."""
    start = {"spec": 1.0 / n, "py": DAMPING / n, "cpp": (1 - DAMPING) / n}[init_sum]
    base = (1 - DAMPING) / n
    return Program(
        "pr",
        init={"rank": F.lit(base + DAMPING * start), "degree": F.col("degree"), "received": F.lit(0).cast("long")},
        active=F.lit(True),
        send={"rank": F.col("rank") / F.col("degree")},
        gather={"sum": F.sum("msg_rank"), "n": F.count("*")},
        apply={"rank": F.lit(base) + F.lit(DAMPING) * F.coalesce("sum", F.lit(0.0)), "degree": F.col("degree"), "received": F.coalesce("n", F.lit(0).cast("long"))},
        activate=F.lit(True),
        max_steps=rounds - 1,
        halts=False,
        cut_every=5,
    )


def bfs(graph: Graph, root: int, strategy: str = "push", telemetry: bool = False) -> Run:
    """(id, parent, level) from a root; null where it doesn't reach."""
    return run(graph, bfs_program(root), strategy=strategy, telemetry=telemetry)


def bfs_relaxed(graph: Graph, root: int) -> DataFrame:
    """(id, parent, level) of the vertices that a root reaches, by a relaxed program: a vertex takes the first message
    that finds it without a parent and passes it on at once. Only what is new is written in a step, and no state is
    looked at that no message meets. Of messages that arrive together the least sender's is the first."""
    start = graph.vertices.where(F.col("id") == F.lit(root)).select(F.col("id").alias("root"))
    return bfs_many(graph, start).select("id", "parent", "level")


def bfs_many(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id, parent, level) for every root (root): all searches advance together, one superstep a level.

    Levels are written as tables of their own, so a step costs its frontier's messages and the keys seen before.
    """
    spark = graph.edges.sparkSession
    folder, schema = work_folder(spark, "bfs"), "root long, id long, parent long, level int"
    by_src = graph.co_located("src")
    frontier = written(roots.select("root", F.col("root").alias("id"), F.col("root").alias("parent"), F.lit(0).alias("level")), f"{folder}/0")
    paths = [f"{folder}/0"]
    try:
        while not frontier.isEmpty():
            seen = spark.read.schema(schema).parquet(*paths).select("root", "id")
            reached = frontier.select("root", F.col("id").alias("src")).join(by_src.edges.select("src", "dst"), "src").groupBy("root", F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
            new = reached.join(seen, ["root", "id"], "left_anti").select("root", "id", "parent", F.lit(len(paths)).alias("level"))
            paths.append(f"{folder}/{len(paths)}")
            frontier = written(new, paths[-1])
    finally:
        by_src.release()
    return spark.read.schema(schema).parquet(*paths)


def connected_components(graph: Graph, method: str = "stars", strategy: str = "push") -> DataFrame:
    """(id, color): the least id of each vertex's component, edge directions ignored.

    method: "stars" takes rounds that grow with the logarithm of the graph's size; "labels" propagates labels, one
    superstep a hop of the diameter (for a directed graph it needs symmetric edges).
    """
    if method == "labels":
        return run(graph, cc_program(), strategy=strategy).state
    folder = work_folder(graph.vertices.sparkSession, "components")
    stars = star_components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), folder)
    return graph.vertices.select("id").join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("color"))


def pagerank(graph: Graph, rounds: int = ROUNDS, init_sum: str = "spec", strategy: str = "push", dangling: str = "keep", n: int | None = None) -> Run:
    """(id, rank, degree, received). dangling: "keep" leaves the mass of vertices without out-edges where it is;
    "redistribute" deals it to all vertices in every round."""
    degree = graph.out_degrees()
    n = n or graph.vertices.count()
    g = Graph(graph.vertices.select("id").join(degree, "id"), graph.edges.select("src", "dst"), graph.name, graph.directed)
    program = pagerank_program(max(n, 1), rounds, init_sum)
    if dangling == "keep":
        return run(g, program, strategy=strategy)
    out = run(g, program, max_steps=0)
    state = out.state
    for step in range(program.max_steps or 0):
        lost = state.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sums = state.where("degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("r")).join(g.edges, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("r").alias("sum"), F.count("*").alias("n"))
        state = state.select("id", "degree").join(sums, "id", "left").select("id", (F.lit((1 - DAMPING) / n) + DAMPING * (F.coalesce("sum", F.lit(0.0)) + F.lit(lost / n))).alias("rank"), "degree", F.coalesce("n", F.lit(0).cast("long")).alias("received"))
        state = checkpointed(state)
        out = Run(state, step + 1)
    return out


def sssp(graph: Graph, root: int, weight: str = "dist", strategy: str = "push", most: int | None = None) -> Run:
    """(id, dist, parent): shortest distances over a column of non-negative integer weights; the parent is the least
    vertex among those that offered the distance first. most: see sssp_program; 255 for distances of 8 bits."""
    edges = graph.edges.select("src", "dst", F.col(weight).alias("edge_dist"))
    return run(graph.with_edges(edges), sssp_program(root, most), strategy=strategy)


def tight_parents(state: DataFrame, edges: DataFrame, weight: str = "dist") -> DataFrame:
    """(id, parent): for every reached vertex but the roots the least neighbour on a shortest path to it."""
    d = state.where("dist is not null").select("id", "dist")
    from_, to = d.select(F.col("id").alias("src"), F.col("dist").alias("ds")), d.select(F.col("id").alias("dst"), F.col("dist").alias("dd"))
    tight = edges.select("src", "dst", F.col(weight).alias("w")).join(from_, "src").join(to, "dst").where((F.col("ds") + F.col("w") == F.col("dd")) & (F.col("dd") > 0))
    return tight.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


def directed_by_rank(edges: DataFrame) -> DataFrame:
    """(src, dst, src_degree, dst_degree) of the edges that lead down the order (degree descending, id ascending) to a
    vertex that can lie on a triangle."""
    d = degrees(edges)
    s = d.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    t = d.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    ends = edges.select("src", "dst").join(s, "src").join(t, "dst")
    down = (F.col("src_degree") > F.col("dst_degree")) | ((F.col("src_degree") == F.col("dst_degree")) & (F.col("src") < F.col("dst")))
    return ends.where((F.col("dst_degree") >= 2) & down).select("src", "dst", "src_degree", "dst_degree")


def triangles(edges: DataFrame) -> DataFrame:
    """(first, second, third) of every triangle once, its vertices down the order of directed_by_rank.

    Wedges open at the last vertex of the order, that of the least degree: its list of vertices above it is short even
    next to hubs, which bounds the wedges by edges times the square root of edges.
    """
    o = checkpointed(directed_by_rank(edges))
    up = o.select(F.col("dst").alias("third"), F.col("src").alias("above"), F.struct((-F.col("src_degree")).alias("d"), F.col("src").alias("i")).alias("place"))
    a, b = up.select("third", F.col("above").alias("first"), F.col("place").alias("p1")), up.select("third", F.col("above").alias("second"), F.col("place").alias("p2"))
    wedges = a.join(b, "third").where("p1 < p2").select("first", "second", "third")
    return wedges.join(o.select(F.col("src").alias("first"), F.col("dst").alias("second")), ["first", "second"])


def triangle_counts(graph: Graph) -> DataFrame:
    """(id, num_triangles): triangles whose first vertex in the order each vertex is; 0 where it is of none."""
    per = triangles(graph.edges).groupBy(F.col("first").alias("id")).agg(F.count("*").alias("num_triangles"))
    return graph.vertices.select("id").join(per, "id", "left").select("id", F.coalesce("num_triangles", F.lit(0)).alias("num_triangles"))


def triangle_work(edges: DataFrame) -> DataFrame:
    """(id, num_active, sum_active): out-edges down the order, and those of their ends: the two-hop work of a vertex."""
    o = directed_by_rank(edges).select("src", "dst")
    out = o.groupBy("src").agg(F.count("*").alias("n"))
    two = o.join(out.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst", "left").groupBy("src").agg(F.count("*").alias("num_active"), F.coalesce(F.sum("m"), F.lit(0)).alias("sum_active"))
    ids = degrees(edges).select("id")
    return ids.join(two.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("num_active", F.lit(0)).alias("num_active"), F.coalesce("sum_active", F.lit(0)).alias("sum_active"))


def activation_batches(work: DataFrame, folder: str, budget: int = 1024) -> DataFrame:
    """(id, batch): vertices in id order, cut where their summed work passes a budget, to spread a costly start.

    work: (id, work). The running sum is taken per range partition; offsets come from the partitions' totals.
    """
    from pyspark.sql import Window

    placed = written(work.repartitionByRange("id").withColumn("part", F.spark_partition_id()), f"{folder}/work")
    within = F.sum("work").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = placed.groupBy("part").agg(F.sum("work").alias("total"))
    offset = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    summed = placed.withColumn("sum", within).join(F.broadcast(offset), "part")
    return summed.select("id", F.floor((F.col("offset") + F.col("sum") - F.col("work")) / F.lit(budget)).cast("long").alias("batch"))


def triangle_counts_by_tokens(graph: Graph, budget: int | None = None) -> DataFrame:
    """triangle_counts by three-hop tokens: a token goes two hops down the order and has to come back to its origin.

    Every message acts alone, as in message-driven frameworks; triangle_counts does the same work in fewer rows.
    budget: start the vertices in batches whose two-hop work stays near it, one after the other, which bounds the
    messages that are under way at a time.
    """
    d = degrees(graph.edges)
    s = d.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    t = d.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    edges = checkpointed(graph.edges.select("src", "dst").join(s, "src").join(t, "dst"))
    down = (F.col("dst_degree") >= 2) & ((F.col("src_degree") > F.col("dst_degree")) | ((F.col("src_degree") == F.col("dst_degree")) & (F.col("sender") < F.col("dst"))))
    program = Relay(
        "tri",
        start={"origin": F.col("id"), "hops": F.lit(0)},
        send_if=F.when(F.col("hops") < 2, down & (F.col("dst") != F.col("origin"))).otherwise(F.col("dst") == F.col("origin")),
        forward={"origin": F.col("origin"), "hops": F.col("hops") + 1},
        keep=F.col("hops") < 2,
        max_steps=3,
    )
    start = None
    if budget:
        work = triangle_work(graph.edges).select("id", F.col("sum_active").alias("work"))
        start = activation_batches(work, work_folder(graph.edges.sparkSession, "batches"), budget)
    per = relay(graph.with_edges(edges), program, start).groupBy("id").agg(F.count("*").alias("num_triangles"))
    return graph.vertices.select("id").join(per, "id", "left").select("id", F.coalesce("num_triangles", F.lit(0)).alias("num_triangles"))


#: Name to a function of (graph, root, config) that gives the algorithm's result; configurations name it.
RUNNERS: dict[str, Callable] = {}


def runner(*names: str):
    """Add a way to run an algorithm under some names."""

    def add(f: Callable) -> Callable:
        RUNNERS.update(dict.fromkeys(names, f))
        return f

    return add


def _weighted(graph: Graph, config, most: int) -> Graph:
    from .generate import edge_weights

    return graph if "dist" in graph.edges.columns else graph.with_edges(edge_weights(graph.edges, config.seed, most))


@runner("bfs", "vbfs")
def _run_bfs(graph: Graph, root: int, config) -> DataFrame:
    return bfs(graph, root, config.architecture).state


@runner("bfs_relaxed")
def _run_bfs_relaxed(graph: Graph, root: int, config) -> DataFrame:
    return bfs_relaxed(graph, root)


@runner("cc")
def _run_components(graph: Graph, root: int, config) -> DataFrame:
    return connected_components(graph)


@runner("pr")
def _run_pagerank(graph: Graph, root: int, config) -> DataFrame:
    return pagerank(graph, config.rounds, config.init_sum, config.architecture).state.select("id", "rank")


@runner("sssp")
def _run_sssp(graph: Graph, root: int, config) -> DataFrame:
    return sssp(_weighted(graph, config, 14), root, strategy=config.architecture).state


@runner("vsssp")
def _run_sssp_8_bits(graph: Graph, root: int, config) -> DataFrame:
    return sssp(_weighted(graph, config, 9), root, strategy=config.architecture, most=255).state


@runner("tri")
def _run_triangles(graph: Graph, root: int, config) -> DataFrame:
    return triangle_counts(graph)
