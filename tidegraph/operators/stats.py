"""Statistics of graphs, samples and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .preprocess import degrees, dense_rank_ids

BINS = 6


def graph_summary(graph: Graph) -> DataFrame:
    """One row: vertices, edges, and least, largest, mean and population deviation of in- plus out-degree."""
    d = total_degrees(graph)
    edges = graph.edges.agg(F.count("*").alias("edges"))
    row = d.agg(F.count("*").alias("vertices"), F.min("degree").alias("degree_min"), F.max("degree").alias("degree_max"), F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_stdev"))
    return row.crossJoin(edges)  # two single rows


def total_degrees(graph: Graph) -> DataFrame:
    """(id, degree): in- plus out-degree of every vertex."""
    e = graph.edges
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    d = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return graph.vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def histogram(rows: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lower, upper, n) of equal-width bins from the least to the largest value; the last takes the largest in."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return rows.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - F.lit(low)) * F.lit(bins) / F.lit(high - low)), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edge = lambda k: F.lit(float(low)) + F.col("bin") * F.lit(float(width)) + F.lit(float(k * width))
    return every.join(counted, "bin", "left").select("bin", edge(0).alias("lower"), edge(1).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def quartiles(rows: DataFrame, column: str, folder: str, mode: str = "textbook") -> DataFrame:
    """One row of a sample: min, q1, median, q3, max, mean, stdev (sample), and harmonic mean and its standard error.

    Quartiles stand at (n + 1) p in the sorted sample, between two values weighted. mode "shifted" takes the value one
    place later, as implementations do that index from 0 with a rank from 1. Only the few values at those places are
    looked at, whatever the sample's size. Reciprocals of zero count as zero.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ranked = dense_rank_ids(x, ["x"], folder, start=1)
    inverse = F.when(F.col("x") != 0, 1 / F.col("x")).otherwise(0.0)
    row = x.agg(F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stdev"), F.avg(inverse).alias("i"), F.stddev_samp(inverse).alias("si"))
    n = row.first()["n"]
    shift = 1 if mode == "shifted" else 0
    places: dict[int, list[tuple[str, float]]] = {}
    for name, quarter in (("q1", 1), ("median", 2), ("q3", 3)):
        whole, part = divmod(quarter * (n + 1), 4)
        for k, weight in ((whole, 1 - part / 4), (whole + 1, part / 4)):
            places.setdefault(min(max(k + shift, 1), max(n, 1)), []).append((name, weight))
    at = ranked.where(F.col("rank").isin(sorted(places)))
    sums = {name: F.sum(sum((F.when(F.col("rank") == k, F.col("x") * w).otherwise(0.0) for k, ws in places.items() for m, w in ws if m == name), F.lit(0.0))).alias(name) for name in ("q1", "median", "q3")}
    out = row.crossJoin(at.agg(*sums.values()))  # two single rows
    return out.select("n", "min", "q1", "median", "q3", "max", "mean", "stdev", (1 / F.col("i")).alias("harmonic_mean"), (F.col("si") / F.sqrt(F.col("n") - 1) / (F.col("i") * F.col("i"))).alias("harmonic_stdev"))


def teps(runs: DataFrame, folder: str) -> DataFrame:
    """Statistics of traversed edges per second over runs (edges, seconds)."""
    return quartiles(runs.select((F.col("edges") / F.col("seconds")).alias("teps")), "teps", folder)


def frontier_report(levels: DataFrame, placed: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(superstep, updates, messages, imbalances in percent) of a BFS run (id, level): what each superstep sent.

    Imbalance is the difference between the busiest and the idlest part, relative to the total.
    """
    active = levels.where("level is not null").join(degrees(edges), "id", "left").join(placed.select("id", "part"), "id")
    by_part = active.groupBy("level", "part").agg(F.count("*").alias("u"), F.coalesce(F.sum("degree"), F.lit(0)).alias("m"))
    idle = lambda c: F.when(F.count("*") < parts, F.lit(0)).otherwise(F.min(c))
    per = by_part.groupBy(F.col("level").alias("superstep")).agg(F.sum("u").alias("updates"), F.sum("m").alias("messages"), (F.max("u") - idle("u")).alias("du"), (F.max("m") - idle("m")).alias("dm"))
    share = lambda d, t: F.when(F.col(t) == 0, 0).otherwise(F.floor(100 * F.col(d) / F.col(t))).cast("long")
    return per.select("superstep", "updates", "messages", share("du", "updates").alias("update_imbalance"), share("dm", "messages").alias("message_imbalance"))


def run_summary(levels: DataFrame, placed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of a BFS run: supersteps, updates, messages, messages that change parts, most updates of a part."""
    active = levels.where("level is not null").select("id", "level")
    sent = active.withColumnRenamed("id", "src").join(edges.select("src", "dst"), "src")
    a, b = (placed.select(F.col("id").alias(i), F.col("part").alias(p)) for i, p in (("src", "p"), ("dst", "q")))
    moved = sent.join(a, "src").join(b, "dst").agg(F.count("*").alias("messages"), F.coalesce(F.sum((F.col("p") != F.col("q")).cast("long")), F.lit(0)).alias("crossing"))
    busiest = active.join(placed, "id").groupBy("level", "part").agg(F.count("*").alias("u")).agg(F.max("u").alias("most_updates"))
    steps = active.agg((F.max("level") + 1).alias("supersteps"), F.count("*").alias("updates"))
    return steps.crossJoin(moved).crossJoin(busiest)  # three single rows
