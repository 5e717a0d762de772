import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.graph import Graph
from tidegraph.operators import algorithms, generate, partition, preprocess, stats, validate
from tidegraph.operators.stars import star_components
from tidegraph.plans import catalog
from tidegraph.plans.superstep import REGISTRY, run
from tidegraph.storage import work_folder, written


def _random(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def _frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


def _both(edges):
    return {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}


def _levels(edges, root):
    level, frontier = {root: 0}, [root]
    while frontier:
        new = sorted({b for a, b in edges if a in set(frontier) and b not in level})
        level.update({b: level[frontier[0]] + 1 for b in new})
        frontier = new
    return level


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.of(_frame(spark, _random(60, 90, 1)))


@pytest.fixture(scope="module")
def edges(graph):
    return {(r.src, r.dst) for r in graph.edges.collect()}


def test_graph_of(edges):
    assert edges == _both(_random(60, 90, 1))


@pytest.mark.parametrize("strategy", ["push", "pull"])
def test_bfs(graph, edges, strategy):
    root = min(a for a, _ in edges)
    got = {r.id: (r.parent, r.level) for r in algorithms.bfs(graph, root, strategy).state.collect() if r.level is not None}
    level = _levels(edges, root)
    want = {v: (v if v == root else min(a for a, b in edges if b == v and level.get(a, 99) == n - 1), n) for v, n in level.items()}
    assert got == want


def test_relaxed_bfs(graph, edges):
    root = min(a for a, _ in edges)
    got = {r.id: (r.parent, r.level) for r in algorithms.bfs_relaxed(graph, root).collect()}
    want = {r.id: (r.parent, r.level) for r in algorithms.bfs(graph, root).state.collect() if r.level is not None}
    assert got == want and algorithms.bfs_relaxed(graph, -5).count() == 0


@pytest.mark.parametrize("n,m,strategy", [(15, 30, "push"), (31, 64, "pull"), (32, 128, "push"), (63, 128, "push")])
def test_engine_sizes(spark, n, m, strategy):
    """Generated graphs of the usual test sizes, searched and labelled."""
    g = generate.random_connected(spark, n, m)
    e = {(r.src, r.dst) for r in g.edges.collect()}
    level = _levels(e, 1)
    assert {r.id: r.level for r in algorithms.bfs(g, 1, strategy).state.collect()} == level and len(level) == n
    assert {r.color for r in algorithms.connected_components(g, "labels", strategy).collect()} == {1}


def test_components(spark, graph, edges):
    got = {r.id: r.color for r in algorithms.connected_components(graph).collect()}
    labels = {r.id: r.color for r in algorithms.connected_components(graph, "labels").collect()}
    want = {v: min(_levels(edges, v)) for v in got}
    assert got == labels == want


def test_stars_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        star_components(path, work_folder(spark, "stars"), max_rounds=1)


def test_stars_on_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (300, 301), (301, 300), (5, None)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    got = {r.id: r.component for r in star_components(frame, work_folder(spark, "stars")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 200: 200, 300: 300, 301: 300}


def test_pagerank(spark, graph, edges):
    degree = {v: sum(a == v for a, _ in edges) for v in {a for a, _ in edges}}
    n = len(degree)
    for mode, start in (("spec", 1 / n), ("py", 0.85 / n), ("cpp", 0.15 / n)):
        rank = dict.fromkeys(degree, 0.15 / n + 0.85 * start)
        for _ in range(29):
            rank = {v: 0.15 / n + 0.85 * sum(rank[a] / degree[a] for a, b in edges if b == v) for v in degree}
        state = algorithms.pagerank(graph, init_sum=mode).state.collect()
        assert all(abs(r["rank"] - rank[r.id]) < 1e-9 and r.received == r.degree for r in state)


def test_pagerank_redistributes(spark):
    g = Graph(spark.range(4), spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"), directed=True)
    keep = algorithms.pagerank(g).state.agg(F.sum("rank")).first()[0]
    dealt = algorithms.pagerank(g, dangling="redistribute").state.agg(F.sum("rank")).first()[0]
    assert keep < 0.99 and abs(dealt - 1) < 1e-9


def test_sssp(spark, graph, edges):
    weighted = graph.with_edges(generate.edge_weights(graph.edges))
    weight = {(r.src, r.dst): r.dist for r in weighted.edges.collect()}
    assert all(1 <= w <= 14 and weight[b, a] == w for (a, b), w in weight.items())
    root = min(a for a, _ in edges)
    dist = {root: 0}
    for _ in range(60):
        for (a, b), w in weight.items():
            if a in dist and dist[a] + w < dist.get(b, 10**9):
                dist[b] = dist[a] + w
    state = algorithms.sssp(weighted, root).state
    assert {r.id: r.dist for r in state.collect() if r.dist is not None} == dist
    assert tuple(validate.distances_valid(state, weighted.edges).first()) == (0, 0)
    short = algorithms.sssp(weighted, root, most=9).state
    assert {r.id: r.dist for r in short.collect() if r.dist is not None} == {v: d for v, d in dist.items() if d < 9}
    directed = {(r.src, r.dst): r.dist for r in generate.edge_weights(graph.edges, most=10, symmetric=False).collect()}
    assert set(directed) == edges and {1, 10} <= set(directed.values()) <= set(range(1, 11)) and any(directed[a, b] != directed[b, a] for a, b in edges)
    wrong = state.withColumn("dist", F.when(F.col("dist") > 3, F.col("dist") + 1).otherwise(F.col("dist")))
    assert validate.distances_valid(wrong, weighted.edges).first()["improvable_edges"] > 0


def test_triangles(spark):
    edges = _both(_random(25, 110, 4))
    graph = Graph.of(_frame(spark, sorted(edges)))
    degree = {v: sum(a == v for a, _ in edges) for v in {a for a, _ in edges}}
    want = dict.fromkeys(degree, 0)
    for tri in itertools.combinations(sorted(degree), 3):
        if all(p in edges for p in itertools.combinations(tri, 2)):
            want[min(tri, key=lambda v: (-degree[v], v))] += 1
    assert {r.id: r.num_triangles for r in algorithms.triangle_counts(graph).collect()} == want
    assert {r.id: r.num_triangles for r in algorithms.triangle_counts_by_tokens(graph).collect()} == want
    assert {r.id: r.num_triangles for r in algorithms.triangle_counts_by_tokens(graph, budget=20).collect()} == want
    work = {r.id: (r.num_active, r.sum_active) for r in algorithms.triangle_work(graph.edges).collect()}
    down = {(a, b) for a, b in edges if degree[b] >= 2 and (-degree[a], a) < (-degree[b], b)}
    out = {v: sum(a == v for a, _ in down) for v in degree}
    assert work == {v: (out[v], sum(out[b] for a, b in down if a == v)) for v in degree}


def test_validation_accepts_and_rejects(spark, graph, edges):
    root, top = min(a for a, _ in edges), max(a for a, _ in edges)
    tree = algorithms.bfs(graph, root).state.select("id", "parent")
    raw = graph.edges.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    level = _levels(edges, root)
    assert validate.verdict(validate.validate_bfs(tree, raw, root, top)) == sum(a in level for a, _ in edges)
    parent = {r.id: r.parent for r in tree.collect()}
    far = max(level, key=lambda v: (level[v], v))
    other = next(v for v in level if v != far and (far, v) not in edges and level[v] <= level[far] and v != root)
    lost = next((v for v in parent if v not in level), None)
    cases = {-999: {root: far}, -16: {far: far}, -15: {far: other}, -13: {far: None}, -1: {far: parent[far], parent[far]: far}}
    for code, change in cases.items():
        broken = spark.createDataFrame([(v, change.get(v, p)) for v, p in parent.items()], "id long, parent long")
        report = validate.validate_bfs(broken, raw, root, top)
        row, names = report.first(), {c: n for n, c in validate.CODES.items()}
        hit = row[names[code]] + (row["right_not_in_tree"] if code == -13 else 0)
        assert hit > 0 and validate.verdict(report) < 0, code
    beyond = raw.unionByName(spark.createDataFrame([(root, top + 5), (top + 7, root)], "v0 long, v1 long"))
    row = validate.validate_bfs(tree, beyond, root, top).first()
    assert row["left_out_of_range"] == row["right_out_of_range"] == 1
    assert lost is None or lost not in level


def test_validation_stops_at_cycles(spark, monkeypatch):
    """Vertices that a round doesn't bring nearer are on cycles, or hang from one: no further round is made."""
    rounds, cut = [], validate.checkpointed
    monkeypatch.setattr(validate, "checkpointed", lambda df: rounds.append(1) or cut(df))
    path, cycle = [(v, max(0, v - 1)) for v in range(12)], [(20, 21), (21, 20), (22, 20), (30, 31), (40, None), (50, 50)]
    levels = validate.tree_levels(spark.createDataFrame(path + cycle, "id long, parent long"), 0, 1 << 40)
    assert {r.id: r.level for r in levels.collect()} == {v: v for v, _ in path} | dict.fromkeys([20, 21, 22, 30, 50])
    assert len(rounds) <= 6  # four for the path, one that brings nobody home, and the first state


def test_whole_trees_are_not_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidegraph.storage.FEW", 10)
    pairs = written(spark.range(1, 100).select((F.col("id") - 1).alias("src"), F.col("id").alias("dst")), f"{tmp_path}/pairs")
    tree = written(spark.range(100).select("id", F.greatest(F.lit(0), F.col("id") - 1).cast("long").alias("parent")), f"{tmp_path}/tree")
    report = validate.validate_bfs(tree, pairs.select(F.col("src").alias("v0"), F.col("dst").alias("v1")), 0, 99)
    assert "BroadcastHashJoin" not in report._jdf.queryExecution().executedPlan().toString()
    assert validate.verdict(report) == 99
    broken = catalog.bfs_validate_broken(spark, "/root/testdata/sf0.001")
    assert "Join" not in broken._jdf.queryExecution().executedPlan().toString()  # the reports are made one by one
    assert [tuple(r) for r in broken.collect()] == [(rule, code, True) for rule, code in validate.CODES.items()]


def test_partitioners(spark, graph, edges):
    ids = sorted({a for a, _ in edges})
    robin = {r.id: (r.part, r.local) for r in partition.robin(graph.vertices, 4, work_folder(spark, "robin")).collect()}
    assert robin == {v: ((k + 1) % 4, (k + 1) // 4) for k, v in enumerate(ids)}
    degree = {v: sum(a == v for a, _ in edges) for v in ids}
    load, want = [0] * 4, {}
    for v in ids:
        p = min(range(4), key=lambda q: (load[q], q))
        want[v] = p
        load[p] += degree[v]
    assert {r.id: r.part for r in partition.greedy(graph.out_degrees(), 4).collect()} == want
    placed = partition.label_propagation(graph.vertices, graph.edges, 4)
    local = {}
    for r in partition.ranked_in_parts(placed, work_folder(spark, "parts")).collect():
        local.setdefault(r.part, []).append((r.id, r.local))
    assert all([k for _, k in sorted(x)] == list(range(len(x))) for x in local.values())
    where = {v: p for v, (p, _) in robin.items()}
    placed_robin = partition.robin(graph.vertices, 4, work_folder(spark, "robin"))
    assert {r.id for r in partition.crossing_senders(placed_robin, graph.edges).collect()} == {a for a, b in edges if where[a] != where[b]}
    assert placed.count() == len(ids) and placed.where(~F.col("part").between(0, 3)).isEmpty()
    addresses = {r.address for r in partition.relabel(partition.robin(graph.vertices, 4, work_folder(spark, "robin")), 10).collect()}
    assert len(addresses) == len(ids) and 0 not in addresses


def test_generators_do_not_depend_on_partitioning(spark):
    a = sorted(generate.kronecker(spark, 6, 4).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = sorted(generate.kronecker(spark, 6, 4).repartition(5).collect())
    g = sorted(generate.random_connected(spark, 40, 80).edges.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and len(a) == 256 and g == sorted(generate.random_connected(spark, 40, 80).edges.collect())
    assert sorted(generate.kronecker(spark, 6, 4, seed=1).collect()) != a
    counts = generate.kronecker(spark, 10, 16, scrambled=False).agg(F.avg((F.col("src") < 512).cast("int"))).first()[0]
    assert counts > 0.7  # most edges lie in the first quadrants


@pytest.mark.parametrize("approach,edges,digraph", [("random_walk", 60, False), ("partition", 39, False), ("random_walk", 200, True), ("naive", 300, False)])
def test_random_connected(spark, approach, edges, digraph):
    g = generate.random_connected(spark, 40, edges, approach, digraph, seed=3)
    n = g.edges.count()
    assert n == (edges if digraph else 2 * edges) and g.edges.distinct().count() == n and g.edges.where("src = dst").isEmpty()
    assert algorithms.connected_components(g).select("color").distinct().count() == 1


def test_generator_guards(spark):
    for nodes, edges in ((10, 8), (10, 46)):
        with pytest.raises(ValueError):
            generate.check_num_edges(nodes, edges)
    with pytest.raises(ValueError):
        generate.random_connected(spark, 30, 29, "naive")
    with pytest.raises(NotImplementedError):
        generate.random_connected(spark, 10, 12, "wilsons_algo")
    with pytest.raises(ValueError):
        generate.random_connected(spark, 10, 12, "other")
    assert generate.scramble(F.col("id"), 7, 3) is not None
    assert spark.range(128).select(generate.scramble(F.col("id"), 7, 3).alias("x")).distinct().where("x between 0 and 127").count() == 128


def test_statistics(spark, graph):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)], "x double")
    folder = work_folder(spark, "q")
    q = stats.quartiles(rows, "x", f"{folder}/a").first()
    assert (q.min, q.q1, q.median, q.q3, q["max"]) == (1.0, 1.75, 6.0, 20.0, 32.0)
    assert abs(q.harmonic_mean - 6 / (1 + 0.5 + 0.25 + 0.125 + 1 / 16 + 1 / 32)) < 1e-12
    ref = stats.quartiles(rows, "x", f"{folder}/b", "shifted").first()
    assert (ref.q1, ref.median, ref.q3) == (3.5, 12.0, 32.0)
    h = {r.bin: r.n for r in stats.histogram(spark.range(13), "id").collect()}
    assert sum(h.values()) == 13 and len(h) == 6 and h[5] == 3
    assert stats.teps(spark.createDataFrame([(10, 2.0), (20, 2.0)], "edges long, seconds double"), f"{folder}/c").first().harmonic_mean == pytest.approx(2 / (1 / 5 + 1 / 10))
    assert stats.histogram(rows.limit(0), "x").count() == 0


def test_preprocessing(spark):
    e = spark.createDataFrame([(1, 2, 5), (1, 2, 3), (2, 1, 9), (3, 3, 1)], "src long, dst long, w long")
    assert sorted(tuple(r) for r in preprocess.dedup(preprocess.drop_self_loops(e)).collect()) == [(1, 2, 3), (2, 1, 9)]
    assert sorted(tuple(r) for r in preprocess.symmetrize(preprocess.drop_self_loops(e)).collect()) == [(1, 2, 3), (2, 1, 3)]
    assert preprocess.max_id_vertices(e).count() == 4
    lines = spark.createDataFrame([(0, "b", "a"), (1, "a", "c"), (2, "b", "c")], "line_no long, a string, b string")
    v, x = preprocess.encode_labels(lines, work_folder(spark, "labels"), 1)
    assert {r.origin: r.id for r in v.collect()} == {"b": 1, "a": 2, "c": 3} and sorted(tuple(r) for r in x.collect()) == [(1, 2), (1, 3), (2, 3)]


def test_engine_guards_and_registry(spark, graph):
    assert set(REGISTRY) == {"bfs", "cc", "sssp", "pr"}
    with pytest.raises(ValueError):
        run(graph, REGISTRY["cc"](), strategy="sideways")
    limited = run(graph, REGISTRY["cc"](), max_steps=1, telemetry=True)
    assert limited.steps == 1 and limited.telemetry[0]["updates"] == graph.vertices.count()
    none = Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    assert algorithms.connected_components(none).count() == 0 and algorithms.bfs(none, 1).state.count() == 0


def test_old_checkpoints_go(spark, graph, edges):
    """A run leaves the files of its last two states at most; messages are counted by the run itself."""
    import glob
    import os

    root = min(a for a, _ in edges)
    algorithms.bfs(graph, root)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(os.path.join(top, "rdd-*")))
    out = algorithms.bfs(graph, root, telemetry=True)
    left = set(glob.glob(os.path.join(top, "rdd-*"))) - before
    assert out.steps > 2 and 1 <= len(left) <= 2
    level = _levels(edges, root)
    assert [x["messages"] for x in out.telemetry] == [sum(level.get(a) == k for a, _ in edges) for k in range(out.steps)]
