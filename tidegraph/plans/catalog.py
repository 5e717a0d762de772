"""The registered queries over the relational tables, each next to the SQL that gives the same rows."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..graph import Graph
from ..operators import algorithms, generate, partition, preprocess, stats, validate
from ..sources import edges as sources
from ..sources import sinks
from ..storage import checkpointed, work_folder, written
from .superstep import REGISTRY, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PARTS = 8

#: Pairs (s, t) of the three graphs over whole tables: parts on consecutive lines of an order (one component), places
#: (a tree for each region) and orders (a star for each customer).
PART_PAIRS = "SELECT a.l_partkey s, b.l_partkey t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
PLACE_PAIRS = """SELECT 4 * CAST(n_regionkey AS BIGINT) s, 4 * CAST(n_nationkey AS BIGINT) + 1 t FROM nation
  UNION ALL SELECT 4 * CAST(c_nationkey AS BIGINT) + 1, 4 * c_custkey + 2 FROM customer UNION ALL SELECT 4 * CAST(s_nationkey AS BIGINT) + 1, 4 * s_suppkey + 3 FROM supplier"""
ORDER_PAIRS = "SELECT 2 * o_custkey s, 2 * o_orderkey + 1 t FROM orders"


def _graph_sql(pairs: str = PART_PAIRS, recursive: bool = False) -> str:
    """Common table expressions raw (s, t), d (directed), e (src, dst), v (id), deg (id, degree)."""
    return f"""WITH {"RECURSIVE " if recursive else ""}raw AS MATERIALIZED ({pairs}),
d AS MATERIALIZED (SELECT DISTINCT s, t FROM raw WHERE s <> t),
e AS MATERIALIZED (SELECT s src, t dst FROM d UNION SELECT t, s FROM d),
v AS MATERIALIZED (SELECT DISTINCT src id FROM e),
deg AS MATERIALIZED (SELECT src id, count(*) degree FROM e GROUP BY src)"""


WEIGHTED = ", w AS MATERIALIZED (SELECT src, dst, 1 + (31 * least(src, dst) + 17 * greatest(src, dst)) % 14 AS dist FROM e)"
BFS = """, b(v, lvl) USING KEY (v) AS (
  SELECT min(src), 0 FROM e
  UNION
  SELECT e.dst, min(b.lvl) + 1 FROM b JOIN e ON e.src = b.v
  LEFT JOIN recurring.b r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)"""
CC = """, c(v, lbl) USING KEY (v) AS (
  SELECT id, id FROM v
  UNION
  SELECT e.dst, min(c.lbl) FROM c JOIN e ON e.src = c.v JOIN recurring.c r ON r.v = e.dst
  WHERE c.lbl < r.lbl GROUP BY e.dst)"""
SSSP = """, q(v, dist) USING KEY (v) AS (
  SELECT min(src), CAST(0 AS BIGINT) FROM w
  UNION
  SELECT w.dst, min(q.dist + w.dist) FROM q JOIN w ON w.src = q.v LEFT JOIN recurring.q r ON r.v = w.dst
  WHERE r.v IS NULL OR q.dist + w.dist < r.dist GROUP BY w.dst)"""
DOWN = """, o AS MATERIALIZED (SELECT e.src i, e.dst j FROM e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst
  WHERE b.degree >= 2 AND (a.degree > b.degree OR a.degree = b.degree AND e.src < e.dst))"""
ROBIN = f", p AS MATERIALIZED (SELECT id, CAST(k % {PARTS} AS INTEGER) part, k // {PARTS} AS loc FROM (SELECT id, row_number() OVER (ORDER BY id) k FROM v))"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _g(spark: SparkSession, sf_dir: str, of: Callable[[SparkSession, str], Graph] = sources.part_graph) -> Graph:
    """A graph over whole tables, its edges written once: algorithms read them in every superstep."""
    g = of(spark, sf_dir)
    e = written(g.edges, work_folder(spark, "graph") + "/edges")
    return Graph(e.select(F.col("src").alias("id")).distinct(), e, g.name)


def _root(g: Graph) -> int:
    return g.edges.agg(F.min("src")).first()[0]


# Edges and preprocessing


@query(_graph_sql() + " SELECT s AS src, t AS dst FROM d")
def edges_directed(spark, sf_dir):
    return preprocess.dedup(preprocess.drop_self_loops(sources.part_pairs(spark, sf_dir)))


@query(_graph_sql() + " SELECT src, dst FROM e")
def edges_symmetric(spark, sf_dir):
    return sources.part_graph(spark, sf_dir).edges.select("src", "dst")


@query(_graph_sql() + " SELECT count(*) AS raw_edges, count(*) FILTER (s = t) AS loops, (SELECT count(*) FROM d) AS kept FROM raw")
def self_loops_removed(spark, sf_dir):
    raw = sources.part_pairs(spark, sf_dir)
    kept = preprocess.dedup(preprocess.drop_self_loops(raw)).agg(F.count("*").alias("kept"))
    return raw.agg(F.count("*").alias("raw_edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops")).crossJoin(kept)


@query(_graph_sql() + WEIGHTED + " SELECT src, dst, dist FROM w")
def edge_weights_table(spark, sf_dir):
    return sources.part_graph(spark, sf_dir).edges


@query(_graph_sql() + f" SELECT src, dst, 1 + {scalars.draw_sql(42, 'least(src, dst)', 'greatest(src, dst)')} % 14 AS dist FROM e")
def edge_weights_seeded(spark, sf_dir):
    return generate.edge_weights(sources.part_graph(spark, sf_dir).edges.select("src", "dst"))


@query(_graph_sql() + " SELECT id, degree FROM deg")
def degree(spark, sf_dir):
    return preprocess.degrees(sources.part_graph(spark, sf_dir).edges)


@query(_graph_sql() + " SELECT src AS id, count(*) AS n, min(dst) AS first_neighbor, max(dst) AS last_neighbor, sum(dst) AS neighbor_sum FROM e GROUP BY src")
def adjacency_list_size(spark, sf_dir):
    a = preprocess.adjacency(sources.part_graph(spark, sf_dir).edges)
    total = F.aggregate("neighbors", F.lit(0).cast("long"), lambda x, y: x + y)
    return a.select("id", F.size("neighbors").alias("n"), F.element_at("neighbors", 1).alias("first_neighbor"), F.element_at("neighbors", -1).alias("last_neighbor"), total.alias("neighbor_sum"))


@query(_graph_sql() + " SELECT v.id, n.dst AS neighbor FROM v LEFT JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) r FROM e) n ON n.src = v.id AND n.r = 3")
def neighbor_by_index(spark, sf_dir):
    return preprocess.neighbor_at(sources.part_graph(spark, sf_dir).edges, 2)


@query(_graph_sql() + " SELECT e.src, e.dst, deg.degree FROM e JOIN deg ON deg.id = e.dst")
def edge_dest_degree(spark, sf_dir):
    return preprocess.with_endpoint_degree(sources.part_graph(spark, sf_dir).edges.select("src", "dst"))


@query(_graph_sql() + " SELECT max(id) + 1 AS vertices, max(id) + 1 - count(*) AS without_edges FROM v")
def max_id_sizing(spark, sf_dir):
    e = sources.part_graph(spark, sf_dir).edges
    alone = preprocess.unreachable(preprocess.max_id_vertices(e), e.select(F.col("src").alias("id"))).agg(F.count("*").alias("without_edges"))
    return preprocess.max_id_vertices(e).agg(F.count("*").alias("vertices")).crossJoin(alone)


@query(
    """WITH l AS (SELECT o_orderkey AS n, o_orderpriority AS a, 'C' || o_custkey AS b FROM orders),
s AS (SELECT n * 2 AS pos, a AS origin FROM l UNION ALL SELECT n * 2 + 1, b FROM l)
SELECT row_number() OVER (ORDER BY pos, origin) - 1 AS id, origin FROM (SELECT origin, min(pos) AS pos FROM s GROUP BY origin)"""
)
def encode_labels(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("a"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("b"))
    return preprocess.encode_labels(lines, work_folder(spark, "labels"))[0]


@query(_graph_sql() + " SELECT src AS id, count(*) AS common FROM (SELECT e.src, f.dst FROM e JOIN e f ON f.src = e.dst JOIN e h ON h.src = e.src AND h.dst = f.dst) GROUP BY src")
def common_neighbors(spark, sf_dir):
    """Of each vertex, how often two of its neighbours are neighbours of each other: twice for each of its triangles."""
    found = algorithms.triangles(_g(spark, sf_dir).edges)
    corners = found.select(F.explode(F.array("first", "second", "third")).alias("id"))
    return corners.groupBy("id").agg((2 * F.count("*")).alias("common"))


@query(_graph_sql() + ", x AS (SELECT src, dst FROM e EXCEPT SELECT s, t FROM d) SELECT src, dst FROM x")
def edges_added_by_symmetry(spark, sf_dir):
    d = preprocess.dedup(preprocess.drop_self_loops(sources.part_pairs(spark, sf_dir)))
    return preprocess.symmetrize(d).exceptAll(d)


# Traversal


@query(_graph_sql(recursive=True) + BFS + " SELECT v AS id, CAST(lvl AS INTEGER) AS level FROM b")
def bfs_levels(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.bfs(g, _root(g)).state.where("level is not null").select("id", "level")


@query(_graph_sql(recursive=True) + BFS + " SELECT CAST(lvl AS INTEGER) AS level, count(*) AS n FROM b GROUP BY lvl")
def bfs_level_sizes(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.bfs(g, _root(g)).state.where("level is not null").groupBy("level").agg(F.count("*").alias("n"))


PARENTS = " SELECT x.v AS id, CASE WHEN x.lvl = 0 THEN x.v ELSE (SELECT min(e.src) FROM e JOIN b y ON y.v = e.src WHERE e.dst = x.v AND y.lvl = x.lvl - 1) END AS parent FROM b x"


@query(_graph_sql(recursive=True) + BFS + PARENTS)
def bfs_parents(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.bfs(g, _root(g)).state.where("parent is not null").select("id", "parent")


@query(_graph_sql(recursive=True) + BFS + PARENTS)
def bfs_pull(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.bfs(g, _root(g), strategy="pull").state.where("parent is not null").select("id", "parent")


@query(_graph_sql(PLACE_PAIRS, True) + BFS + " SELECT id FROM v WHERE id NOT IN (SELECT v FROM b)")
def bfs_reachable_anti(spark, sf_dir):
    g = _g(spark, sf_dir, sources.place_graph)
    return preprocess.unreachable(g.vertices, algorithms.bfs(g, _root(g)).state.where("parent is not null"))


ROOTS = f", roots AS MATERIALIZED (SELECT id AS root FROM v ORDER BY {scalars.draw_sql(42, 'id')}, id LIMIT 64)"


@query(_graph_sql() + f" SELECT id AS root FROM v ORDER BY {scalars.draw_sql(42, 'id')}, id LIMIT 64")
def sample_roots(spark, sf_dir):
    return generate.sample_roots(sources.part_graph(spark, sf_dir).edges)


def _searches(g: Graph, roots: DataFrame) -> DataFrame:
    """(root, reached, depth, traversed_edges) of a search from every root."""
    d = preprocess.degrees(g.edges)
    found = algorithms.bfs_many(g, roots).join(d, "id")
    return found.groupBy("root").agg(F.count("*").alias("reached"), F.max("level").alias("depth"), F.floor(F.sum("degree") / 2).cast("long").alias("traversed_edges"))


@query(
    _graph_sql(recursive=True) + ROOTS + """, m(root, v, lvl) USING KEY (root, v) AS (
  SELECT root, root, 0 FROM roots
  UNION
  SELECT m.root, e.dst, min(m.lvl) + 1 FROM m JOIN e ON e.src = m.v
  LEFT JOIN recurring.m r ON r.root = m.root AND r.v = e.dst WHERE r.v IS NULL GROUP BY m.root, e.dst)
SELECT root, count(*) AS reached, CAST(max(lvl) AS INTEGER) AS depth, CAST(sum(degree) // 2 AS BIGINT) AS traversed_edges FROM m JOIN deg ON deg.id = m.v GROUP BY root"""
)
def graph500_searches(spark, sf_dir):
    g = _g(spark, sf_dir)
    return _searches(g, generate.sample_roots(g.edges))


# Components and connection


@query(_graph_sql(ORDER_PAIRS, True) + CC + " SELECT v AS id, lbl AS color FROM c")
def cc_labels(spark, sf_dir):
    return algorithms.connected_components(_g(spark, sf_dir, sources.order_graph))


@query(_graph_sql(ORDER_PAIRS, True) + CC + " SELECT v AS id, lbl AS color FROM c")
def cc_label_propagation(spark, sf_dir):
    return algorithms.connected_components(_g(spark, sf_dir, sources.order_graph), "labels")


@query(_graph_sql(ORDER_PAIRS, True) + CC + " SELECT lbl AS color, count(*) AS n FROM c GROUP BY lbl")
def cc_sizes(spark, sf_dir):
    return algorithms.connected_components(_g(spark, sf_dir, sources.order_graph)).groupBy("color").agg(F.count("*").alias("n"))


@query("SELECT CAST(0 AS BIGINT) AS split_edges, CAST(0 AS BIGINT) AS wrong_colors")
def cc_validate(spark, sf_dir):
    g = _g(spark, sf_dir, sources.place_graph)
    return validate.components_valid(algorithms.connected_components(g), g.edges)


@query(_graph_sql(PLACE_PAIRS, True) + BFS + ", x AS (SELECT (SELECT min(src) FROM e) AS r, id FROM v WHERE id NOT IN (SELECT v FROM b)) SELECT r AS src, id AS dst FROM x UNION ALL SELECT id, r FROM x")
def connect_star(spark, sf_dir):
    g = _g(spark, sf_dir, sources.place_graph)
    root = _root(g)
    return preprocess.star_connections(g.vertices, algorithms.bfs(g, root).state.where("parent is not null"), root)


@query(_graph_sql(PLACE_PAIRS, True) + CC + ", r AS (SELECT DISTINCT lbl FROM c) SELECT a.lbl AS src, b.lbl AS dst FROM r a JOIN r b ON a.lbl <> b.lbl")
def connect_clique(spark, sf_dir):
    return preprocess.clique_connections(algorithms.connected_components(_g(spark, sf_dir, sources.place_graph)).withColumnRenamed("color", "component"))


@query("SELECT CAST(1 AS BIGINT) AS components")
def force_connected(spark, sf_dir):
    g = sources.connected(_g(spark, sf_dir, sources.place_graph), "star")
    return algorithms.connected_components(g).agg(F.count_distinct("color").alias("components"))


# PageRank


def _pagerank_sql(rounds: int = 30) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM v, n)"]
    for k in range(1, rounds):
        steps.append(f"r{k} AS MATERIALIZED (SELECT v.id, 0.15 / n + 0.85 * coalesce(s.sum, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r.rank / deg.degree) AS sum FROM r{k - 1} r JOIN deg USING (id) JOIN e ON e.src = r.id GROUP BY e.dst) s ON s.dst = v.id)")
    return _graph_sql() + ", n AS (SELECT count(*)::DOUBLE AS n FROM v), " + ", ".join(steps)


RANK = f"SELECT id, CAST(round(rank * 1e6, 3) AS DOUBLE) AS rank_ppm FROM r{algorithms.ROUNDS - 1}"


def _ppm(state: DataFrame) -> DataFrame:
    return state.select("id", F.round(F.col("rank") * 1e6, 3).alias("rank_ppm"))


@query(_pagerank_sql() + " " + RANK)
def pagerank_30(spark, sf_dir):
    return _ppm(algorithms.pagerank(_g(spark, sf_dir)).state)


@query(_pagerank_sql() + " " + RANK)
def pull_vs_push_pagerank(spark, sf_dir):
    return _ppm(algorithms.pagerank(_g(spark, sf_dir), strategy="pull").state)


@query(_pagerank_sql() + " " + RANK + " ORDER BY rank_ppm DESC, id LIMIT 10")
def pagerank_topk(spark, sf_dir):
    return _ppm(algorithms.pagerank(_g(spark, sf_dir)).state).orderBy(F.desc("rank_ppm"), "id").limit(10)


@query("SELECT CAST(0 AS BIGINT) AS miscounted, CAST(0 AS BIGINT) AS dangling_edges, CAST(1.0 AS DOUBLE) AS total")
def pagerank_checks(spark, sf_dir):
    g = _g(spark, sf_dir)
    state = algorithms.pagerank(g).state
    return validate.miscounted(state).agg(F.count("*").alias("miscounted")).crossJoin(validate.dangling_edges(g.vertices, g.edges).agg(F.count("*").alias("dangling_edges"))).crossJoin(state.agg(F.round(F.sum("rank"), 6).alias("total")))


# Shortest paths


@query(_graph_sql(recursive=True) + WEIGHTED + SSSP + " SELECT v AS id, dist FROM q")
def sssp_dist(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.sssp(g, _root(g)).state.where("dist is not null").select("id", "dist")


@query(_graph_sql(recursive=True) + WEIGHTED + SSSP + " SELECT w.dst AS id, min(w.src) AS parent FROM w JOIN q a ON a.v = w.src JOIN q b ON b.v = w.dst WHERE a.dist + w.dist = b.dist AND b.dist > 0 GROUP BY w.dst")
def sssp_parent(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.tight_parents(algorithms.sssp(g, _root(g)).state, g.edges)


@query("SELECT CAST(0 AS BIGINT) AS improvable_edges, CAST(0 AS BIGINT) AS loose_parents")
def sssp_validate(spark, sf_dir):
    g = _g(spark, sf_dir)
    return validate.distances_valid(algorithms.sssp(g, _root(g)).state, g.edges)


# Triangles

TRIANGLES = DOWN + ", t AS MATERIALIZED (SELECT a.i, a.j, b.j AS k FROM o a JOIN o b ON b.i = a.j JOIN o c ON c.i = a.i AND c.j = b.j)"


@query(_graph_sql() + TRIANGLES + " SELECT count(*) AS num_triangles FROM t")
def triangles_total(spark, sf_dir):
    return algorithms.triangles(_g(spark, sf_dir).edges).agg(F.count("*").alias("num_triangles"))


@query(_graph_sql() + TRIANGLES + " SELECT v.id, coalesce(n, 0) AS num_triangles FROM v LEFT JOIN (SELECT i, count(*) AS n FROM t GROUP BY i) x ON x.i = v.id")
def triangles_per_vertex(spark, sf_dir):
    return algorithms.triangle_counts(_g(spark, sf_dir))


@query(_graph_sql() + TRIANGLES + " SELECT v.id, coalesce(n, 0) AS num_triangles FROM v LEFT JOIN (SELECT i, count(*) AS n FROM t GROUP BY i) x ON x.i = v.id")
def triangles_by_tokens(spark, sf_dir):
    return algorithms.triangle_counts_by_tokens(_g(spark, sf_dir))


@query(_graph_sql() + DOWN + " SELECT i AS src, j AS dst FROM o")
def edge_direction(spark, sf_dir):
    return algorithms.directed_by_rank(_g(spark, sf_dir).edges).select("src", "dst")


WORK = DOWN + ", k AS MATERIALIZED (SELECT i, count(*) AS n FROM o GROUP BY i), work AS MATERIALIZED (SELECT v.id, coalesce(x.n, 0) AS num_active, CAST(coalesce(x.s, 0) AS BIGINT) AS sum_active FROM v LEFT JOIN (SELECT o.i, count(*) AS n, sum(k.n) AS s FROM o LEFT JOIN k ON k.i = o.j GROUP BY o.i) x ON x.i = v.id)"


@query(_graph_sql() + WORK + " SELECT id, num_active, sum_active FROM work")
def tri_work(spark, sf_dir):
    return algorithms.triangle_work(_g(spark, sf_dir).edges)


@query(_graph_sql() + WORK + " SELECT id, CAST((sum(sum_active) OVER (ORDER BY id) - sum_active) // 1024 AS BIGINT) AS batch FROM work")
def activation_batches(spark, sf_dir):
    work = algorithms.triangle_work(_g(spark, sf_dir).edges).select("id", F.col("sum_active").alias("work"))
    return algorithms.activation_batches(work, work_folder(spark, "batches"))


# Partitioning


def _placed(spark, g: Graph) -> DataFrame:
    return partition.robin(g.vertices, PARTS, work_folder(spark, "robin"))


@query(_graph_sql() + ROBIN + " SELECT id, part, loc AS local FROM p")
def partition_robin(spark, sf_dir):
    return _placed(spark, _g(spark, sf_dir))


BALANCE = ROBIN + ", bal AS MATERIALIZED (SELECT part, count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges, max(loc) AS max_local FROM p JOIN deg USING (id) GROUP BY part)"


@query(_graph_sql() + BALANCE + " SELECT part, vertices, edges, max_local FROM bal")
def partition_balance(spark, sf_dir):
    g = _g(spark, sf_dir)
    return partition.balance(_placed(spark, g), g.edges)


@query(_graph_sql() + BALANCE + " SELECT round(avg(vertices), 6) AS vertices_mean, round(stddev_samp(vertices), 6) AS vertices_stdev, round(avg(edges), 6) AS edges_mean, round(stddev_samp(edges), 6) AS edges_stdev, max(edges) AS edges_max, max(max_local) AS max_local FROM bal")
def partition_balance_summary(spark, sf_dir):
    g = _g(spark, sf_dir)
    s = partition.balance_summary(partition.balance(_placed(spark, g), g.edges))
    return s.select(*[F.round(c, 6).alias(c) for c in ("vertices_mean", "vertices_stdev", "edges_mean", "edges_stdev")], "edges_max", "max_local")


@query(_graph_sql() + ROBIN + f" SELECT count(*) AS edges, count(*) FILTER (a.part <> b.part) AS cut, CAST(count(*) * {PARTS - 1} / {PARTS} AS DOUBLE) AS expected FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst")
def edge_cut(spark, sf_dir):
    g = _g(spark, sf_dir)
    return partition.edge_cut(_placed(spark, g), g.edges, PARTS)


@query(_graph_sql() + ROBIN + " SELECT e.src AS id, count(DISTINCT p.part) AS parts FROM e JOIN p ON p.id = e.dst GROUP BY e.src")
def update_recipients(spark, sf_dir):
    g = _g(spark, sf_dir)
    return partition.recipients(_placed(spark, g), g.edges)


@query(_graph_sql() + ROBIN + " SELECT id, (CAST(part AS BIGINT) << 20) | CASE WHEN part = 0 THEN loc + 1 ELSE loc END AS address FROM p")
def relabel_by_parts(spark, sf_dir):
    return partition.relabel(_placed(spark, _g(spark, sf_dir)), 20).select("id", "address")


@query(_graph_sql() + " SELECT id, ((id + 1) % 8 << 20) + (id + 1) // 8 AS address, (id + 1) % 8 AS part, (id + 1) // 8 AS local, (id + 1) % 8 // 4 AS node, id AS origin FROM v")
def partition_cyclic_roundtrip(spark, sf_dir):
    at = sources.part_graph(spark, sf_dir).vertices.select("id", partition.cyclic(F.col("id"), PARTS, 20).alias("address"))
    a = F.col("address")
    return at.select("id", "address", partition.part_of(a, 20).alias("part"), partition.local_of(a, 20).alias("local"), partition.node_of(a, 20, 4).alias("node"), partition.cyclic_origin(a, PARTS, 20).alias("origin"))


@query(
    _graph_sql(recursive=True) + f""", r AS MATERIALIZED (SELECT id, CAST(degree AS BIGINT) AS degree, row_number() OVER (ORDER BY id) AS k FROM deg),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS id, CAST(-1 AS BIGINT) AS part, list_transform(range({PARTS}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT r.k, r.id, list_position(g.loads, list_min(g.loads)) - 1, list_transform(g.loads, lambda x, i: x + CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN r.degree ELSE 0 END)
  FROM g JOIN r ON r.k = g.k + 1)
SELECT id, CAST(part AS INTEGER) AS part, row_number() OVER (PARTITION BY part ORDER BY k) - 1 AS local FROM g WHERE k > 0"""
)
def partition_greedy(spark, sf_dir):
    return partition.greedy(preprocess.degrees(_g(spark, sf_dir).edges), PARTS)


@query()
def partition_label_propagation(spark, sf_dir):
    g = _g(spark, sf_dir)
    return partition.edge_cut(partition.label_propagation(g.vertices, g.edges, PARTS), g.edges, PARTS)


# Statistics and telemetry


@query(_graph_sql() + " SELECT count(*) AS vertices, 2 * min(degree) AS degree_min, 2 * max(degree) AS degree_max, round(2 * avg(degree), 6) AS degree_mean, round(2 * stddev_pop(degree), 6) AS degree_stdev, (SELECT count(*) FROM e) AS edges FROM deg")
def degree_summary(spark, sf_dir):
    return stats.graph_summary(_g(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("degree_mean", "degree_stdev")})


@query(
    _graph_sql() + """, x AS (SELECT 2 * degree AS g FROM deg), r AS (SELECT min(g)::DOUBLE AS lo, max(g)::DOUBLE AS hi FROM x),
h AS (SELECT least(floor((g - lo) * 6 / (hi - lo)), 5) AS bin, count(*) AS n FROM x, r GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * (hi - lo) / 6, 6) AS lower, round(lo + (b + 1) * (hi - lo) / 6, 6) AS upper, coalesce(n, 0) AS n FROM range(6) t(b) CROSS JOIN r LEFT JOIN h ON h.bin = b"""
)
def degree_histogram(spark, sf_dir):
    return stats.histogram(stats.total_degrees(_g(spark, sf_dir)), "degree").withColumns({c: F.round(c, 6) for c in ("lower", "upper")})


@query(
    _graph_sql() + """, x AS (SELECT degree::DOUBLE AS x, row_number() OVER (ORDER BY degree) AS r FROM deg), n AS (SELECT count(*) AS n FROM x),
q AS (SELECT k, (k * (n + 1)) // 4 AS w, (k * (n + 1)) % 4 / 4.0 AS f FROM n, range(1, 4) t(k)),
z AS (SELECT k, sum(CASE WHEN x.r = w THEN x.x * (1 - f) ELSE x.x * f END) AS v FROM q JOIN x ON x.r IN (w, w + 1) GROUP BY k)
SELECT count(*) AS n, min(x) AS min, round((SELECT v FROM z WHERE k = 1), 6) AS q1, round((SELECT v FROM z WHERE k = 2), 6) AS median, round((SELECT v FROM z WHERE k = 3), 6) AS q3,
max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stdev, round(1 / avg(1 / x), 6) AS harmonic_mean, round(stddev_samp(1 / x) / sqrt(count(*) - 1) / (avg(1 / x) * avg(1 / x)), 6) AS harmonic_stdev FROM x"""
)
def degree_quartiles(spark, sf_dir):
    out = stats.quartiles(preprocess.degrees(_g(spark, sf_dir).edges), "degree", work_folder(spark, "quartiles"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("n", "min", "max")})


@query(
    _graph_sql(recursive=True) + BFS + ROBIN + f""", f AS (SELECT b.lvl, p.part, count(*) AS u, sum(degree) AS m FROM b JOIN deg ON deg.id = b.v JOIN p ON p.id = b.v GROUP BY 1, 2)
SELECT CAST(lvl AS INTEGER) AS superstep, CAST(sum(u) AS BIGINT) AS updates, CAST(sum(m) AS BIGINT) AS messages,
CAST(floor(100 * (max(u) - CASE WHEN count(*) < {PARTS} THEN 0 ELSE min(u) END) / sum(u)) AS BIGINT) AS update_imbalance, CAST(floor(100 * (max(m) - CASE WHEN count(*) < {PARTS} THEN 0 ELSE min(m) END) / sum(m)) AS BIGINT) AS message_imbalance FROM f GROUP BY lvl"""
)
def superstep_messages(spark, sf_dir):
    g = _g(spark, sf_dir)
    return stats.frontier_report(algorithms.bfs(g, _root(g)).state, _placed(spark, g), g.edges, PARTS)


@query(
    _graph_sql(recursive=True) + BFS + ROBIN + """ SELECT (SELECT CAST(max(lvl) + 1 AS INTEGER) FROM b) AS supersteps, (SELECT count(*) FROM b) AS updates, count(*) AS messages, count(*) FILTER (x.part <> y.part) AS crossing,
(SELECT max(u) FROM (SELECT count(*) AS u FROM b JOIN p ON p.id = b.v GROUP BY b.lvl, p.part)) AS most_updates FROM b JOIN e ON e.src = b.v JOIN p x ON x.id = e.src JOIN p y ON y.id = e.dst"""
)
def run_summary(spark, sf_dir):
    g = _g(spark, sf_dir)
    return stats.run_summary(algorithms.bfs(g, _root(g)).state, _placed(spark, g), g.edges)


@query(_graph_sql(recursive=True) + BFS + " SELECT CAST(lvl AS BIGINT) AS superstep, count(*) AS updates, CAST(sum(degree) AS BIGINT) AS messages FROM b JOIN deg ON deg.id = b.v GROUP BY lvl")
def engine_telemetry(spark, sf_dir):
    g = _g(spark, sf_dir)
    log = run(g, algorithms.bfs_program(_root(g)), telemetry=True).telemetry
    return spark.createDataFrame([(x["superstep"], x["updates"], x["messages"]) for x in log], "superstep long, updates long, messages long")


# Validation

_ZERO = ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in validate.CODES)


@query(_graph_sql(recursive=True) + BFS + f" SELECT {_ZERO}, (SELECT count(*) FROM raw JOIN b x ON x.v = s JOIN b y ON y.v = t) AS traversed_edges")
def bfs_validate(spark, sf_dir):
    g = _g(spark, sf_dir)
    root = _root(g)
    raw = sources.part_pairs(spark, sf_dir).select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    raw = raw.join(g.vertices.select(F.col("id").alias("v0")), "v0").join(g.vertices.select(F.col("id").alias("v1")), "v1")
    return validate.validate_bfs(algorithms.bfs(g, root).state.select("id", "parent"), raw, root, g.vertices.agg(F.max("id")).first()[0])


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST({code} AS BIGINT) AS code, true AS found" for rule, code in validate.CODES.items()))
def bfs_validate_broken(spark, sf_dir):
    """A search tree, or the edges it is held against, broken once for every rule; whether the rule finds it. One report is
    made after the other, as each joins whole tables."""
    g = _g(spark, sf_dir, sources.place_graph)
    root, top = _root(g), g.vertices.agg(F.max("id")).first()[0]
    tree = checkpointed(algorithms.bfs(g, root).state)
    raw = g.edges.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    last, inner, lost = tree.agg(F.max(F.struct("level", "id"))["id"], F.max(F.when(F.col("level") == 1, F.col("id"))), F.max(F.when(F.col("level").isNull(), F.col("id")))).first()
    twin = tree.where((F.col("level") == 2) & (F.col("id") != last)).agg(F.max("id")).first()[0]
    moved = lambda *changes: tree.select("id", F.coalesce(*[F.when(F.col("id") == v, F.lit(p)) for v, p in changes], F.col("parent")).alias("parent"))
    lone = tree.select("id", F.when(F.col("id") != last, F.col("parent")).alias("parent"))
    more = lambda a, b: raw.unionByName(spark.createDataFrame([(a, b)], "v0 long, v1 long"))
    whole = tree.select("id", "parent")
    cases = {
        "bad_root": (moved((root, inner)), raw),
        "no_level": (moved((last, twin), (twin, last)), raw),
        "left_out_of_range": (whole, more(top + 1, root)),
        "right_out_of_range": (whole, more(root, top + 1)),
        "right_not_in_tree": (whole, more(root, lost)),
        "left_not_in_tree": (lone, raw.where(F.col("v0") == last)),
        "levels_too_far": (whole, more(root, last)),
        "not_an_edge": (moved((last, root)), raw),
        "second_root": (moved((last, last)), raw),
    }
    rows = [(rule, validate.CODES[rule], validate.validate_bfs(t, r, root, top).first()[rule] > 0) for rule, (t, r) in cases.items()]
    return spark.createDataFrame(rows, "rule string, code long, found boolean")


# Generators


def _scrambled_sql(c: str, scale: int) -> str:
    for k in range(3):
        factor = (2 * (42 * 7919 + k * 104729) + 1) % (1 << min(scale, 30)) | 1
        c = f"list_transform([({c} * {factor} + {42 * 31 + k}) & {(1 << scale) - 1}], lambda z: xor(z, z >> {max(1, scale // 2)}))[1]"
    return c


def _kronecker_sql(scale: int, factor: int) -> str:
    u = f"{scalars.draw_sql(42, 'i', 'b')} / {float(scalars.PRIME)}"
    a, b, c = generate.A, generate.A + generate.B, generate.A + generate.B + generate.C
    return f"""WITH u AS (SELECT i, b, {u} AS u FROM range({factor << scale}) t(i), range({scale}) s(b)),
r AS (SELECT i, CAST(sum(CASE WHEN u >= {b} THEN 1 << CAST({scale - 1} - b AS INTEGER) ELSE 0 END) AS BIGINT) AS x, CAST(sum(CASE WHEN u >= {a} AND u < {b} OR u >= {c} THEN 1 << CAST({scale - 1} - b AS INTEGER) ELSE 0 END) AS BIGINT) AS y FROM u GROUP BY i),
m AS (SELECT least(x, y) AS x, greatest(x, y) AS y FROM r)
SELECT {_scrambled_sql("x", scale)} AS src, {_scrambled_sql("y", scale)} AS dst FROM m"""


@query(_kronecker_sql(8, 8))
def kronecker_edges(spark, sf_dir):
    return generate.kronecker(spark, 8, 8)


def _rmat_sql(scale: int, factor: int, noise: float = 0.05) -> str:
    u = lambda seed, number: f"{scalars.draw_sql(seed, 'i', number)} / {float(scalars.PRIME)}"
    shares = (generate.A, generate.B, generate.C, 1 - generate.A - generate.B - generate.C)
    shaken = ", ".join(f"{p!r}::DOUBLE * ({1 - noise!r}::DOUBLE + {2 * noise!r}::DOUBLE * ({u(43, f'b * 4 + {k}')})) AS {name}" for k, (p, name) in enumerate(zip(shares, ("pa", "pb", "pc", "pd"), strict=True)))
    bit = f"1 << CAST({scale - 1} - b AS INTEGER)"
    return f"""WITH u AS (SELECT i, b, {u(42, "b")} AS u, {shaken} FROM range({factor << scale}) t(i), range({scale}) s(b)),
q AS (SELECT i, b, u * (pa + pb + pc + pd) AS u, pa, pa + pb AS pab, pa + pb + pc AS pabc FROM u),
r AS (SELECT i, CAST(sum(CASE WHEN u >= pab THEN {bit} ELSE 0 END) AS BIGINT) AS x, CAST(sum(CASE WHEN u >= pa AND u < pab OR u >= pabc THEN {bit} ELSE 0 END) AS BIGINT) AS y FROM q GROUP BY i)
SELECT {_scrambled_sql("x", scale)} AS src, {_scrambled_sql("y", scale)} AS dst FROM r"""


@query(_rmat_sql(8, 8))
def rmat_edges(spark, sf_dir):
    return generate.rmat(spark, 8, 8)


@query("SELECT CAST(1200 AS BIGINT) AS edges, CAST(500 AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS components")
def random_connected(spark, sf_dir):
    g = generate.random_connected(spark, 500, 1200)
    c = algorithms.connected_components(g)
    return g.edges.where("src < dst").agg(F.count("*").alias("edges")).crossJoin(c.agg(F.count("*").alias("vertices"), F.count_distinct("color").alias("components")))


@query("SELECT CAST(1500 AS BIGINT) AS edges, CAST(500 AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS components")
def random_connected_partition(spark, sf_dir):
    g = generate.random_connected(spark, 500, 1500, "partition", seed=7)
    c = algorithms.connected_components(g)
    return g.edges.where("src < dst").agg(F.count("*").alias("edges")).crossJoin(c.agg(F.count("*").alias("vertices"), F.count_distinct("color").alias("components")))


@query(_graph_sql() + f" SELECT id, row_number() OVER (ORDER BY {scalars.draw_sql(42, 'id')}, id) - 1 AS label FROM v")
def label_permutation(spark, sf_dir):
    return generate.permute_labels(sources.part_graph(spark, sf_dir).vertices, work_folder(spark, "permute"))


# Sources and sinks


@query(_graph_sql() + " SELECT src, dst FROM e")
def text_roundtrip(spark, sf_dir):
    folder = work_folder(spark, "text")
    g = sources.part_graph(spark, sf_dir)
    sinks.write_text(sinks.text_lines(g.edges.where("src < dst")), f"{folder}/out")
    back = sources.read_text_edges(spark, f"{folder}/out")
    label = back.vertices.select("id", F.col("origin").cast("long").alias("origin"))
    a, b = (label.select(F.col("id").alias(i), F.col("origin").alias(o)) for i, o in (("src", "s"), ("dst", "t")))
    return back.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


@query(_graph_sql() + " SELECT src, dst FROM e")
def binary_roundtrip(spark, sf_dir):
    folder = work_folder(spark, "binary") + "/out"
    files = sinks.write_binary_edges(sources.part_graph(spark, sf_dir).edges, folder)
    return sources.read_binary_edges(spark, files).select(F.col("v0").alias("src"), F.col("v1").alias("dst"))


@query(_graph_sql() + ", l AS (SELECT src || ' -- ' || dst AS line FROM e WHERE src < dst) SELECT line FROM l UNION ALL SELECT 'graph last_graph {' UNION ALL SELECT '}'")
def dot_lines(spark, sf_dir):
    return sinks.dot_lines(sources.part_graph(spark, sf_dir)).select("line")


@query(_graph_sql() + " SELECT '    node [' || chr(10) || '        id ' || id || chr(10) || '        label \"' || id || '\"' || chr(10) || '    ]' AS line FROM v UNION ALL SELECT '    edge [' || chr(10) || '        source ' || src || chr(10) || '        target ' || dst || chr(10) || '    ]' FROM e WHERE src <= dst UNION ALL SELECT 'graph [' UNION ALL SELECT ']'")
def gml_lines(spark, sf_dir):
    return sinks.gml_lines(sources.part_graph(spark, sf_dir)).select("line")


@query(_graph_sql() + " SELECT (s + 1) || ' ' || (t + 1) AS line FROM d")
def one_based_text(spark, sf_dir):
    return sinks.one_based_lines(preprocess.dedup(sources.part_pairs(spark, sf_dir)))


@query(_graph_sql() + " SELECT (SELECT count(DISTINCT x) FROM (SELECT s AS x FROM raw UNION ALL SELECT t FROM raw)) AS nodes, 2 * count(*) FILTER (s <> t) AS edges FROM raw")
def quick_counts(spark, sf_dir):
    return sources.count_nodes_and_edges(sinks.text_lines(sources.part_pairs(spark, sf_dir)))


# Programs by other ways to run them


@query(_graph_sql(recursive=True) + BFS + PARENTS.replace("AS parent FROM b x", "AS parent, CAST(x.lvl AS INTEGER) AS level FROM b x"))
def bfs_relaxed(spark, sf_dir):
    g = _g(spark, sf_dir)
    return algorithms.bfs_relaxed(g, _root(g)).select("id", "parent", "level")


def _configured(spark, sf_dir, algo: str) -> DataFrame:
    from .. import cli
    from ..sources.config import Config

    return cli.run(_g(spark, sf_dir), Config(algo=algo))


@query(_graph_sql(recursive=True) + BFS + PARENTS)
def vbfs_configured(spark, sf_dir):
    return _configured(spark, sf_dir, "vbfs").where("parent is not null").select("id", "parent")


BYTES = f", w AS MATERIALIZED (SELECT src, dst, 1 + {scalars.draw_sql(42, 'least(src, dst)', 'greatest(src, dst)')} % 9 AS dist FROM e)"


@query(_graph_sql(recursive=True) + BYTES + SSSP + " SELECT v AS id, dist FROM q WHERE dist < 255")
def vsssp_configured(spark, sf_dir):
    g = sources.part_graph(spark, sf_dir)
    e = written(g.edges.select("src", "dst"), work_folder(spark, "graph") + "/edges")
    from .. import cli
    from ..sources.config import Config

    return cli.run(Graph(e.select(F.col("src").alias("id")).distinct(), e), Config(algo="vsssp")).where("dist is not null").select("id", "dist")


@query(_graph_sql(ORDER_PAIRS, True) + CC + " SELECT v AS id, lbl AS color FROM c")
def registered_program(spark, sf_dir):
    return run(_g(spark, sf_dir, sources.order_graph), REGISTRY["cc"]()).state


@query(_graph_sql() + f" SELECT src, dst, 1 + {scalars.draw_sql(42, 'src', 'dst')} % 10 AS dist FROM e")
def edge_weights_directed(spark, sf_dir):
    return generate.edge_weights(sources.part_graph(spark, sf_dir).edges.select("src", "dst"), most=10, symmetric=False)


@query(_graph_sql() + TRIANGLES + " SELECT v.id, coalesce(n, 0) AS num_triangles FROM v LEFT JOIN (SELECT i, count(*) AS n FROM t GROUP BY i) x ON x.i = v.id")
def triangles_throttled(spark, sf_dir):
    g = _g(spark, sf_dir)
    work = algorithms.triangle_work(g.edges).agg(F.sum("sum_active")).first()[0]
    return algorithms.triangle_counts_by_tokens(g, budget=max(1, work // 3))


@query(_graph_sql(recursive=True) + BFS + " SELECT (SELECT count(*) FROM b) AS updates, CAST(sum(degree) AS BIGINT) AS neighbors_issued, CAST(max(lvl) + 1 AS BIGINT) AS supersteps, CAST(0 AS BIGINT) AS kernel_errors FROM b JOIN deg ON deg.id = b.v")
def run_counters(spark, sf_dir):
    g = _g(spark, sf_dir)
    out = run(g, algorithms.bfs_program(_root(g)), telemetry=True)
    errors = validate.dangling_edges(g.vertices, g.edges).count()
    row = (sum(x["updates"] for x in out.telemetry), sum(x["messages"] for x in out.telemetry), out.steps, errors)
    return spark.createDataFrame([row], "updates long, neighbors_issued long, supersteps long, kernel_errors long")


@query(_graph_sql() + ROBIN + " SELECT DISTINCT e.src AS id FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst WHERE a.part <> b.part")
def update_senders(spark, sf_dir):
    g = _g(spark, sf_dir)
    return partition.crossing_senders(_placed(spark, g), g.edges)


_SEARCHES = """, m(root, v, lvl) USING KEY (root, v) AS (
  SELECT root, root, 0 FROM roots
  UNION
  SELECT m.root, e.dst, min(m.lvl) + 1 FROM m JOIN e ON e.src = m.v
  LEFT JOIN recurring.m r ON r.root = m.root AND r.v = e.dst WHERE r.v IS NULL GROUP BY m.root, e.dst)"""


@query(
    _graph_sql(ORDER_PAIRS, recursive=True) + ROOTS + _SEARCHES + """, x AS (SELECT CAST(sum(degree) // 2 AS DOUBLE) AS x, row_number() OVER (ORDER BY sum(degree) // 2) AS r FROM m JOIN deg ON deg.id = m.v GROUP BY root),
n AS (SELECT count(*) AS n FROM x), q AS (SELECT k, (k * (n + 1)) // 4 AS w, (k * (n + 1)) % 4 / 4.0 AS f FROM n, range(1, 4) t(k)),
z AS (SELECT k, sum(CASE WHEN x.r = w THEN x.x * (1 - f) ELSE x.x * f END) AS v FROM q JOIN x ON x.r IN (w, w + 1) GROUP BY k)
SELECT count(*) AS n, min(x) AS min, round((SELECT v FROM z WHERE k = 1), 6) AS q1, round((SELECT v FROM z WHERE k = 2), 6) AS median, round((SELECT v FROM z WHERE k = 3), 6) AS q3,
max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stdev, round(1 / avg(1 / x), 6) AS harmonic_mean, round(stddev_samp(1 / x) / sqrt(count(*) - 1) / (avg(1 / x) * avg(1 / x)), 6) AS harmonic_stdev FROM x"""
)
def graph500_edge_statistics(spark, sf_dir):
    """Statistics of the traversed edges of 64 searches."""
    g = _g(spark, sf_dir, sources.order_graph)
    searches = _searches(g, generate.sample_roots(g.edges))
    out = stats.quartiles(searches, "traversed_edges", work_folder(spark, "nedge"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("n", "min", "max")})


@query()
def graph500_teps(spark, sf_dir):
    """Statistics of traversed edges per second of 64 searches, which run together and share their time by their edges."""
    g = _g(spark, sf_dir)
    began = time.time()
    found = written(_searches(g, generate.sample_roots(g.edges)), work_folder(spark, "searches") + "/found")
    seconds = time.time() - began
    total = found.agg(F.sum("traversed_edges")).first()[0]
    runs = found.select(F.col("traversed_edges").alias("edges"), (F.lit(seconds) / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("seconds"))  # 64 rows
    return stats.teps(runs, work_folder(spark, "teps")).withColumn("searches_per_second", F.lit(64 / seconds)).withColumn("edges", F.lit(total))


# Sources, generators and sinks of the older forms


@query(_graph_sql() + " SELECT src, dst FROM e")
def legacy_text_roundtrip(spark, sf_dir):
    folder = work_folder(spark, "legacy")
    sinks.write_text(sinks.text_lines(sources.part_graph(spark, sf_dir).edges.where("src < dst")), f"{folder}/out")
    back = sources.read_text_edges(spark, f"{folder}/out", legacy=True)
    label = back.vertices.select("id", F.col("origin").cast("long").alias("origin"))
    a, b = (label.select(F.col("id").alias(i), F.col("origin").alias(o)) for i, o in (("src", "s"), ("dst", "t")))
    return back.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("t").alias("dst"))


@query(
    _graph_sql() + f""", l AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM e WHERE src < dst),
f AS (SELECT origin, min(pos) AS pos FROM (SELECT src AS origin, 2 * k AS pos FROM l UNION ALL SELECT dst, 2 * k + 1 FROM l) GROUP BY origin),
r AS (SELECT origin, row_number() OVER (ORDER BY pos) AS k FROM f) SELECT CAST(origin AS VARCHAR) AS origin, CAST(k % {PARTS} AS INTEGER) AS part, k // {PARTS} AS local FROM r"""
)
def balanced_scan(spark, sf_dir):
    folder = work_folder(spark, "balanced")
    e = sources.part_graph(spark, sf_dir).edges.where("src < dst")
    lines = e.select(F.concat_ws(" ", "src", "dst").alias("line"), "src", "dst")
    sinks.write_text(lines, f"{folder}/out", ["src", "dst"])
    graph, placed = sources.read_balanced(spark, f"{folder}/out", PARTS, 1 << 40)
    return placed.join(graph.vertices, "id").select("origin", "part", "local")


@query("SELECT CAST(n_nationkey AS BIGINT) AS root FROM nation UNION ALL SELECT CAST(n_regionkey AS BIGINT) FROM nation")
def binary_roots(spark, sf_dir):
    pairs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return sources.read_binary_roots(spark, sinks.write_binary_edges(pairs, work_folder(spark, "roots") + "/out"))


@query(_graph_sql(recursive=True) + BFS + " SELECT CAST(v.id AS VARCHAR) AS origin, CAST(b.lvl AS INTEGER) AS level FROM v LEFT JOIN b ON b.v = v.id")
def final_state(spark, sf_dir):
    g, path = _g(spark, sf_dir), work_folder(spark, "state") + "/out"
    sinks.write_state(algorithms.bfs(g, _root(g)).state, g.vertices, path)
    return spark.read.parquet(path).select("origin", "level")


@query("SELECT CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, directed, edges >= nodes - 1 AND edges <= nodes * (nodes - 1) // (CASE WHEN directed THEN 1 ELSE 2 END) AS possible FROM range(1, 9) a(nodes), range(0, 60) b(edges), (VALUES (true), (false)) c(directed)")
def possible_graphs(spark, sf_dir):
    def possible(nodes: int, edges: int, directed: bool) -> bool:
        try:
            generate.check_num_edges(nodes, edges, directed)
        except ValueError:
            return False
        return True

    rows = [(n, m, d, possible(n, m, d)) for n in range(1, 9) for m in range(60) for d in (True, False)]
    return spark.createDataFrame(rows, "nodes long, edges long, directed boolean, possible boolean")


@query(
    _graph_sql() + """ SELECT 'simple' AS kind, src, dst, count(*) AS n FROM e WHERE src < dst GROUP BY src, dst
UNION ALL SELECT 'directed', s, t, 1 FROM d UNION ALL SELECT 'multi', least(s, t), greatest(s, t), count(*) FROM raw WHERE s <> t GROUP BY 2, 3 UNION ALL SELECT 'loops', s, t, count(*) FROM raw GROUP BY s, t"""
)
def edge_sets(spark, sf_dir):
    """The edges that four kinds of graph allow, and how often."""
    raw = written(sources.part_pairs(spark, sf_dir), work_folder(spark, "raw") + "/pairs")
    kinds = {"simple": {}, "directed": {"digraph": True}, "multi": {"multigraph": True}, "loops": {"loops": True, "multigraph": True, "digraph": True}}
    counted = [generate.edge_set(raw, **how).groupBy("src", "dst").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "src", "dst", "n") for kind, how in kinds.items()]
    return functools.reduce(DataFrame.unionByName, counted)


@query("SELECT CAST(600 AS BIGINT) AS edges, CAST(100 AS BIGINT) AS vertices, CAST(1 AS BIGINT) AS components, CAST(0 AS BIGINT) AS loops")
def random_naive(spark, sf_dir):
    g = generate.random_connected(spark, 100, 600, "naive")
    c = algorithms.connected_components(g)
    half = g.edges.where("src <= dst").agg(F.count("*").alias("edges"), F.sum((F.col("src") == F.col("dst")).cast("long")).alias("loops"))
    return half.crossJoin(c.agg(F.count("*").alias("vertices"), F.count_distinct("color").alias("components"))).select("edges", "vertices", "components", "loops")  # single rows


@query(_graph_sql() + ROBIN + " SELECT part, count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges, max(loc) AS max_local FROM p JOIN deg USING (id) GROUP BY part")
def command_line_balance(spark, sf_dir):
    """The command line, with a configuration file, over a file of edges."""
    from .. import cli

    folder = work_folder(spark, "cli")
    e = sources.part_graph(spark, sf_dir).edges.where("src < dst")
    sinks.write_text(e.select(F.concat_ws(" ", "src", "dst").alias("line"), "src", "dst"), f"{folder}/edges", ["src", "dst"])
    from ..sources.config import from_ini

    config = from_ini(f"[arch]\nnum_pe = {PARTS}\n[graph]\ngraphfile = {folder}/edges\npartition = robin\n[app]\nalgo = bfs\n")
    g = cli.load(spark, config)
    ranked = g.vertices.select("id", F.col("origin").cast("long").alias("origin"))
    by_label = Graph(ranked.select(F.col("origin").alias("id")), e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return partition.balance(cli.place(by_label, config), by_label.edges)


# Scalar functions


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey // nullif(l_suppkey, 0) AS quotient, l_partkey % nullif(l_suppkey, 0) AS remainder, CAST(l_extendedprice / l_linenumber AS DOUBLE) AS ratio, l_extendedprice AS x FROM lineitem WHERE l_linenumber > 0")
def fn_division(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber > 0")
    q, r = scalars.divide_with_remainder("l_partkey", "l_suppkey")
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q.alias("quotient"), r.alias("remainder"), scalars.float_divide("l_extendedprice", "l_linenumber").alias("ratio"), F.col("l_extendedprice").alias("x"))


@query("SELECT p_partkey AS k, CAST(p_retailprice AS FLOAT) + CAST(p_size AS FLOAT) AS added, CAST(p_retailprice AS FLOAT) * CAST(p_size AS FLOAT) AS multiplied FROM part")
def fn_float(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    return t.select(F.col("p_partkey").alias("k"), scalars.float_add("p_retailprice", "p_size").alias("added"), scalars.float_multiply("p_retailprice", "p_size").alias("multiplied"))


@query(
    """SELECT p_partkey AS k, CAST(bit_count(p_partkey) AS INTEGER) AS ones, (CAST(1 AS BIGINT) << (p_partkey % 40)) - 1 AS mask,
CASE WHEN p_partkey < 2 THEN 0 ELSE length(bin(p_partkey - 1)) END AS width,
(p_partkey % 1024) + ((p_partkey % 8) << 10) AS packed, p_partkey % 8 AS upper,
CAST(list_sum(list_transform(range(16), lambda i: ((p_partkey >> CAST(i AS INTEGER)) & 1) << CAST(15 - i AS INTEGER))) AS BIGINT) AS reversed,
CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS vector FROM part"""
)
def fn_bits(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))
    t = t.withColumn("lo", F.col("k") % 1024).withColumn("hi", F.col("k") % 8).withColumn("shift", (F.col("k") % 40).cast("int")).withColumn("flags", F.array(F.col("k") % 2 == 0, F.col("k") % 3 == 0))
    t = t.withColumn("packed", scalars.pack([("lo", 10), ("hi", 3)]))
    return t.select("k", scalars.popcount("k").alias("ones"), scalars.ones("shift").alias("mask"), scalars.bit_width(F.col("k")).cast("long").alias("width"), "packed", scalars.unpack("packed", [("low", 10), ("upper", 3)])[1], scalars.bit_reverse(F.col("k") % 65536, 16).alias("reversed"), scalars.bit_vector("flags").alias("vector"))


@query("SELECT o_orderkey AS k, regexp_extract(o_orderpriority || ' ' || o_orderstatus, '(\\w+)\\s(\\w+)', 1) AS first, regexp_extract(o_orderpriority || ' ' || o_orderstatus, '(\\w+)\\s(\\w+)', 2) AS second FROM orders WHERE regexp_matches(o_orderpriority || ' ' || o_orderstatus, '(\\w+)\\s(\\w+)')")
def fn_tokens(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), scalars.tokens(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("p")).where("p is not null")
    return t.select("k", "p.first", "p.second")


@query(
    """WITH x AS (SELECT p_partkey AS k, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS x FROM part), y AS (SELECT k, x, abs(x) AS a, CAST(floor(log2(abs(x))) AS INTEGER) AS e FROM x WHERE x <> 0),
z AS (SELECT k, x, a, CASE WHEN pow(2, e) > a THEN e - 1 WHEN pow(2, e + 1) <= a THEN e + 1 ELSE e END AS e FROM y)
SELECT k, CASE WHEN x < 0 THEN 2147483648 ELSE 0 END + CAST(e + 127 AS BIGINT) * 8388608 + CAST((a / pow(2, e) - 1) * 8388608 AS BIGINT) AS bits FROM z UNION ALL SELECT k, 0 FROM x WHERE x = 0"""
)
def fn_float_bits(spark, sf_dir):
    from ..session import ship

    ship(spark)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), scalars.float_bits()("p_retailprice").alias("bits"))


@query(f"SELECT p_partkey AS k, {scalars.draw_sql(42, 'p_partkey', '3')} AS draw FROM part")
def seeded_draws(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), scalars.draw(42, F.col("p_partkey"), 3).alias("draw"))


# Streaming


@query(_graph_sql(ORDER_PAIRS, True) + CC + " SELECT v AS id, lbl AS color FROM c")
def streaming_components(spark, sf_dir):
    from ..streaming.components import StreamingComponents

    folder = work_folder(spark, "edges")
    g = sources.order_graph(spark, sf_dir)
    g.edges.select("src", "dst").repartition(3, "src").write.parquet(f"{folder}/in")
    kept = StreamingComponents(spark, f"{folder}/state")
    stream = spark.readStream.schema("src long, dst long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    kept.start(stream, f"{folder}/checkpoint").awaitTermination()
    return kept.labels


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels and parents of a breadth-first search over the part graph."""
    g = _g(spark, sf_dir)
    return algorithms.bfs(g, _root(g)).state
