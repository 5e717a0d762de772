import glob
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from tidegraph import cli, storage
from tidegraph.functions import scalars
from tidegraph.operators import algorithms
from tidegraph.sources import edges as sources
from tidegraph.sources import sinks
from tidegraph.sources.config import Config, from_ini
from tidegraph.streaming.components import StreamingComponents

TEXT = "# a comment\nb a\na c\nb c # more\n\nd d\n x   y \nlone\na b\n"


@pytest.fixture
def path(tmp_path):
    (tmp_path / "small.graph").write_text(TEXT)
    return f"{tmp_path}/small.graph"


def _named(g):
    label = {r.id: r.origin for r in g.vertices.collect()}
    return {(label[r.src], label[r.dst]) for r in g.edges.collect()}, label


def test_text_edges(spark, path):
    g = sources.read_text_edges(spark, path)
    found, label = _named(g)
    assert found == {(a, b) for p in ("ab", "ac", "bc", "xy") for a, b in (p, p[::-1])}
    assert label == dict(enumerate("bacdxy")) and g.name == "small.graph"
    directed, _ = _named(sources.read_text_edges(spark, path, digraph=True))
    assert directed == {("b", "a"), ("a", "c"), ("b", "c"), ("x", "y"), ("a", "b")}


@pytest.mark.parametrize("connect", ["star", "clique"])
def test_connection(spark, path, connect):
    g = sources.read_text_edges(spark, path, connect=connect)
    assert algorithms.connected_components(g).select("color").distinct().count() == 1
    with pytest.raises(ValueError):
        sources.read_text_edges(spark, path, connect="rope")


def test_legacy_text(spark, path):
    g = sources.read_text_edges(spark, path, legacy=True)
    found, label = _named(g)
    assert min(label) == 1 and found == {(a, b) for p in ("ab", "ac", "bc") for a, b in (p, p[::-1])}
    placed = sources.read_balanced(spark, path, 2, 9)[1]
    assert placed.count() == 4
    with pytest.raises(ValueError):
        sources.read_balanced(spark, path, 2, 1)
    assert tuple(sources.count_nodes_and_edges(spark.read.text(path).withColumnRenamed("value", "line")).first()) == (4, 8)


def test_binary(spark, tmp_path):
    pairs = [(0, 1), (2**40 + 3, 7), (5, 5), (-1, 4)]
    (tmp_path / "e.bin").write_bytes(b"".join(struct.pack("<qq", *p) for p in pairs))
    assert sorted(tuple(r) for r in sources.read_binary_edges(spark, f"{tmp_path}/e.bin").collect()) == sorted(pairs)
    (tmp_path / "r.bin").write_bytes(struct.pack("<3q", 9, 8, 7))
    assert {r.root for r in sources.read_binary_roots(spark, f"{tmp_path}/r.bin").collect()} == {7, 8, 9}
    files = sinks.write_binary_edges(spark.createDataFrame(pairs, "src long, dst long"), f"file://{tmp_path}/out")
    size = sum(len(open(f.removeprefix("file://"), "rb").read()) for f in files)
    assert size == 16 * len(pairs)


def test_binary_sink_ignores_files_of_lost_tasks(spark, tmp_path):
    """A file that a lost attempt of this or another job has left is not read back."""
    frame = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "other.bin").write_bytes(struct.pack("<qq", 9, 9))
    files = sinks.write_binary_edges(frame, f"file://{tmp_path}/out")
    assert sorted(tuple(r) for r in sources.read_binary_edges(spark, files).collect()) == [(1, 2), (3, 4)]
    assert sources.read_binary_edges(spark, []).count() == 0


def test_labels_follow_the_files_names(spark, tmp_path):
    """The lines of a small first file come before those of a larger second one, whichever Spark reads first."""
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.txt").write_text("z y\n")
    (tmp_path / "many" / "b.txt").write_text("".join(f"v{i} v{i + 1}\n" for i in range(3000)))
    g = sources.read_text_edges(spark, f"{tmp_path}/many")
    label = {r.id: r.origin for r in g.vertices.collect()}
    assert [label[i] for i in range(5)] == ["z", "y", "v0", "v1", "v2"] and label[3002] == "v3000"


def test_whole_table_graphs(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    places, orders = sources.place_graph(spark, sf), sources.order_graph(spark, sf)
    regions = spark.read.parquet(f"{sf}/region.parquet").count()
    assert algorithms.connected_components(places).select("color").distinct().count() == regions
    buyers = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct().count()
    assert algorithms.connected_components(orders).select("color").distinct().count() == buyers


def test_shared_folder():
    class Elsewhere:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        storage.shared_root(Elsewhere)
    Elsewhere.conf = {"spark.checkpoint.dir": "hdfs://store/shared/"}
    assert storage.shared_root(Elsewhere) == "hdfs://store/shared"
    Elsewhere.conf, Elsewhere.sparkContext.master = {}, "local[2]"
    assert storage.shared_root(Elsewhere).startswith("file:///")


def test_text_sinks(spark, path, tmp_path):
    g = sources.read_text_edges(spark, path)
    sinks.write_text(sinks.dot_lines(g), f"{tmp_path}/dot", ["at", "line"])
    lines = [x for f in sorted(glob.glob(f"{tmp_path}/dot/part*")) for x in open(f).read().splitlines()]
    assert lines[0] == "graph last_graph {" and lines[-1] == "}" and "0 -- 1" in lines and "3" in lines
    sinks.write_text(sinks.gml_lines(g), f"{tmp_path}/gml", ["at", "key"])
    gml = "\n".join(x for f in sorted(glob.glob(f"{tmp_path}/gml/part*")) for x in open(f).read().splitlines())
    assert gml.startswith("graph [\n    node [\n        id 0\n        label \"b\"") and gml.endswith("]") and gml.count("edge [") == 4
    sinks.write_state(algorithms.bfs(g, 0).state, g.vertices, f"{tmp_path}/state")
    assert {r.origin: r.level for r in spark.read.parquet(f"{tmp_path}/state").collect()}["c"] == 1


def test_config():
    c = from_ini("[arch]\nnum_pe = 8\nnum_fpga = 2\n[graph]\nnodes = 63\nedges = 128\n[app]\nalgo = pr\n[logging]\ndisable_logfile = yes\n", seed=5)
    assert (c.num_pe, c.nodes, c.edges, c.algo, c.seed, c.architecture, c.disable_logfile, c.parts_per_node) == (8, 63, 128, "pr", 5, "pull", True, 4)
    assert from_ini("[arch]\nnum_pe = 4").architecture == "push" and Config(nodes=10).edges == 9
    with pytest.warns(UserWarning):
        assert from_ini("[graph]\npartition = metis").partition == "label_propagation"
    for bad in ("[arch]\narchitecture = X", "[arch]\nnum_pe = 3\nnum_fpga = 2", "[graph]\nnodes = __import__('os')", "[logging]\ndisable_logfile = maybe"):
        with pytest.raises(ValueError):
            from_ini(bad)


@pytest.mark.parametrize("algo", sorted(algorithms.RUNNERS))
def test_command_line(spark, path, tmp_path, algo):
    cli.main(["-f", path, "--algo", algo, "-o", f"{tmp_path}/out", "run"], spark)
    assert spark.read.parquet(f"{tmp_path}/out").count() == (3 if algo == "bfs_relaxed" else 6)
    with pytest.raises(ValueError):
        cli.main(["-f", path, "--algo", "other", "run"], spark)


def test_command_line_reports(spark, tmp_path):
    ini = tmp_path / "c.ini"
    ini.write_text("[arch]\nnum_pe = 4\n[graph]\nnodes = 20\nedges = 30\npartition = greedy\n[app]\nalgo = cc\n")
    cli.main(["-c", str(ini), "-o", f"{tmp_path}/b", "balance"], spark)
    assert spark.read.parquet(f"{tmp_path}/b").agg(F.sum("edges")).first()[0] == 60
    out = cli.main(["-n", "12", "--save-graph", f"{tmp_path}/g", "stats"], spark)
    assert out.first()["edges"] == 22 and spark.read.text(f"{tmp_path}/g").count() == 22
    with pytest.raises(ValueError):
        cli.main(["run"], spark)


def test_scalars(spark):
    row = spark.createDataFrame([(13, 4, 0, 1e-39, 2.0, [True, False, True])], "a long, b long, z long, tiny double, x double, v array<boolean>")
    q, r = scalars.divide_with_remainder("a", "b")
    none, _ = scalars.divide_with_remainder("a", "z")
    out = row.select(q, r, none, scalars.float_multiply("tiny", "x"), scalars.float_divide("x", "b"), scalars.float_divide("x", "z"), scalars.bit_vector("v"), scalars.bit_reverse(F.lit(6), 4), scalars.popcount("a"), scalars.float_bits()("x")).first()
    assert tuple(out) == (3, 1, None, 0.0, 0.5, None, 5, 6, 3, 0x40000000)
    assert [r[0] for r in spark.range(1, 9).select(scalars.bit_width(F.col("id"))).collect()] == [0, 1, 2, 2, 3, 3, 3, 3]
    spread = spark.range(4000).select(scalars.uniform(1, F.col("id"), 2).alias("u")).agg(F.avg("u"), F.stddev("u"), F.count_distinct("u")).first()
    assert abs(spread[0] - 0.5) < 0.03 and abs(spread[1] - 0.2887) < 0.02 and spread[2] > 3980


def test_stream(spark, tmp_path):
    schema = "src long, dst long"
    for k, batch in enumerate([[(1, 2), (3, 4)], [(2, 3)], [(9, 8), (1, 2)]]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"src": a, "dst": b}) for a, b in batch))
    kept = StreamingComponents(spark)
    kept.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    assert {r.id: r.color for r in kept.labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} and kept.version == 2


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """A new object on the folder knows the labels before it; a batch that is delivered again changes nothing."""
    folder = f"file://{tmp_path}/labels"
    batch = lambda *pairs: spark.createDataFrame(list(pairs), "src long, dst long")
    first = StreamingComponents(spark, folder)
    first.merge(batch((1, 2), (5, 6)), 0)
    first.merge(batch((3, 4)), 1)
    again = StreamingComponents(spark, folder)
    assert again.version == 1
    again.merge(batch((3, 4)), 1)
    again.merge(batch((2, 3)), 2)
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert {r.id: r.color for r in again.labels.collect()} == want
    (tmp_path / "labels" / "3" / "labels").mkdir(parents=True)  # a batch that was lost while it was written
    last = StreamingComponents(spark, folder)
    assert last.version == 2 and {r.id: r.color for r in last.labels.collect()} == want
    last.merge(batch((6, 1)), 3)
    assert {r.color for r in last.labels.collect()} == {1} and last.version == 3


def test_stream_over_two_queries(spark, tmp_path):
    """The same checkpoint and folder, a second query: only new files are read, and old labels stay."""
    (tmp_path / "in").mkdir()
    schema = "src long, dst long"
    for k, pairs in enumerate([[(1, 2)], [(2, 3)]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"src": a, "dst": b}) for a, b in pairs))
        kept = StreamingComponents(spark, f"file://{tmp_path}/labels")
        kept.start(spark.readStream.schema(schema).json(f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
        assert {r.id for r in kept.labels.collect()} == set(range(1, 3 + k))
    assert {r.color for r in kept.labels.collect()} == {1}
