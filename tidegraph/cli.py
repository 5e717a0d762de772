"""Command line: generate or read a graph, run an algorithm, report on it.

    python -m tidegraph.cli -n 1000 -e 4000 run --algo pr
    python -m tidegraph.cli -c config.ini stats
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .operators import algorithms, generate, partition, stats
from .session import session
from .sources.config import Config, read_config
from .sources.edges import read_text_edges
from .sources.sinks import text_lines, write_text
from .storage import work_folder


def load(spark: SparkSession, config: Config) -> Graph:
    """The configured graph: a file's, or a generated one."""
    if config.graphfile:
        return read_text_edges(spark, config.graphfile, config.digraph, config.connect)
    if not config.nodes:
        raise ValueError("neither a graph file nor a number of nodes is given")
    return generate.random_connected(spark, config.nodes, config.edges, config.approach, config.digraph, config.seed)


def place(graph: Graph, config: Config) -> DataFrame:
    """(id, part, local) by the configured partitioner."""
    spark = graph.vertices.sparkSession
    if config.partition in ("robin", "random"):
        return partition.robin(graph.vertices, config.num_pe, work_folder(spark, "robin"))
    if config.partition == "greedy":
        return partition.greedy(graph.out_degrees(), config.num_pe)
    if config.partition == "cyclic":
        return graph.vertices.select("id", F.pmod(F.col("id") + 1, F.lit(config.num_pe)).cast("int").alias("part"), F.floor((F.col("id") + 1) / config.num_pe).cast("long").alias("local"))
    return partition.ranked_in_parts(partition.label_propagation(graph.vertices, graph.edges, config.num_pe), work_folder(spark, "parts"))


def run(graph: Graph, config: Config) -> DataFrame:
    """The configured algorithm's result: the registry knows it by its name."""
    if config.algo not in algorithms.RUNNERS:
        raise ValueError(f"unknown algorithm {config.algo!r}; known are {', '.join(sorted(algorithms.RUNNERS))}")
    root = config.root if config.root is not None else graph.vertices.agg(F.min("id")).first()[0]
    return algorithms.RUNNERS[config.algo](graph, root, config)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("-c", "--config-file", help="INI file")
    parser.add_argument("-f", "--from-file", dest="graphfile", help="text edge list")
    parser.add_argument("-n", "--nodes", type=int)
    parser.add_argument("-e", "--edges", type=int)
    parser.add_argument("-d", "--digraph", action="store_true", default=None)
    parser.add_argument("-s", "--seed", type=int)
    parser.add_argument("--algo")
    parser.add_argument("--root", type=int)
    parser.add_argument("--save-graph")
    parser.add_argument("-o", "--output", help="folder for the result, as Parquet")
    parser.add_argument("command", choices=["run", "stats", "balance"])
    args = vars(parser.parse_args(argv))
    command, output, path = args.pop("command"), args.pop("output"), args.pop("config_file")
    config = read_config(path, **args) if path else Config(**{k: v for k, v in args.items() if v is not None})
    spark = spark or session()
    graph = load(spark, config)
    if config.save_graph:
        write_text(text_lines(graph.edges), config.save_graph)
    if command == "run":
        out = run(graph, config)
    elif command == "stats":
        out = stats.graph_summary(graph)
    else:
        out = partition.balance(place(graph, config), graph.edges)
    if output:
        out.write.mode("overwrite").parquet(output)
    else:
        out.show()
    return out


if __name__ == "__main__":
    main()
