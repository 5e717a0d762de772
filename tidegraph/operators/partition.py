"""Partitioners, addresses and balance reports. Placement is always a derived column."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .preprocess import degrees, dense_rank_ids


def robin(vertices: DataFrame, parts: int, folder: str) -> DataFrame:
    """(id, part, local): the k-th vertex in id order goes to part (k + 1) mod parts, place (k + 1) div parts."""
    ranked = dense_rank_ids(vertices.select("id"), ["id"], folder, start=1)
    return ranked.select("id", F.pmod("rank", F.lit(parts)).cast("int").alias("part"), F.floor(F.col("rank") / parts).cast("long").alias("local"))


def greedy(degree: DataFrame, parts: int) -> DataFrame:
    """(id, part, local): each vertex in id order goes to the part with the least summed degree, the lowest on ties.

    Every step depends on all before it, so all rows (id, degree) stream through one task in their order, sorted on its
    disk; it holds the parts' loads and one batch, and the driver nothing. Use robin or cyclic for very large graphs.
    """

    def assign(batches):
        import pandas as pd

        heap, count = [(0, p) for p in range(parts)], [0] * parts
        for batch in batches:
            rows = []
            for key, d in zip(batch["id"].tolist(), batch["degree"].tolist(), strict=True):
                load, p = heapq.heappop(heap)
                rows.append((key, p, count[p]))
                count[p] += 1
                heapq.heappush(heap, (load + d, p))
            yield pd.DataFrame(rows, columns=["id", "part", "local"])

    ship(degree.sparkSession)
    return degree.select("id", "degree").repartition(1).sortWithinPartitions("id").mapInPandas(assign, "id long, part int, local long")


def label_propagation(vertices: DataFrame, edges: DataFrame, parts: int, rounds: int = 5, slack: float = 1.1) -> DataFrame:
    """(id, part): a k-way partition with few cut edges, in place of an external partitioner.

    Vertices start at a hash and move, in each round, to the part most of their neighbours are in, as long as that part
    keeps under slack times the mean degree load; moves into a part are admitted with the probability that fills it.
    """
    from ..functions.scalars import uniform
    from ..storage import checkpointed

    d = degrees(edges)
    state = checkpointed(vertices.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")))
    for k in range(rounds):
        loads = state.groupBy("part").agg(F.sum("degree").alias("load"))
        at = state.select(F.col("id").alias("src"), "part")
        votes = edges.join(at, "src").groupBy(F.col("dst").alias("id"), "part").agg(F.count("*").alias("n"))
        wish = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("part"))).alias("w")).select("id", (-F.col("w.col2")).cast("int").alias("wish"))
        moving = state.join(wish, "id", "left").withColumn("wish", F.coalesce("wish", "part"))
        asked = moving.where("wish <> part").groupBy("wish").agg(F.sum("degree").alias("asked"))
        room = loads.withColumnRenamed("part", "wish").join(asked, "wish")
        mean = loads.agg(F.sum("load")).first()[0] / parts
        share = room.select("wish", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.lit(slack * mean) - F.col("load")) / F.col("asked"))).alias("share"))
        admitted = uniform(k + 1, F.col("id")) < F.coalesce("share", F.lit(0.0))
        state = checkpointed(moving.join(F.broadcast(share), "wish", "left").select("id", "degree", F.when(admitted, F.col("wish")).otherwise(F.col("part")).alias("part")))
    return state.select("id", "part")


def relabel(placed: DataFrame, bits: int) -> DataFrame:
    """placed (id, part, local) with address = part << bits | local; part 0 starts at local 1, so 0 is never issued."""
    local = F.when(F.col("part") == 0, F.col("local") + 1).otherwise(F.col("local"))
    return placed.withColumn("address", F.shiftleft(F.col("part").cast("long"), bits).bitwiseOR(local))


def part_of(address: Column, bits: int) -> Column:
    return F.shiftright(address, bits)


def local_of(address: Column, bits: int) -> Column:
    return address.bitwiseAND(F.lit((1 << bits) - 1))


def address_of(part: Column, local: Column, bits: int) -> Column:
    return F.shiftleft(part.cast("long"), bits).bitwiseOR(local.cast("long"))


def node_of(address: Column, bits: int, parts_per_node: int) -> Column:
    """The machine that holds a part, at so many parts each."""
    return F.floor(part_of(address, bits) / parts_per_node).cast("long")


def cyclic(v: Column, parts: int, shift: int) -> Column:
    """Cyclic placement of a vertex id: ((v + 1) mod parts) << shift, plus (v + 1) div parts."""
    w = v + 1
    return F.shiftleft(w % parts, shift) + F.floor(w / parts).cast("long")


def cyclic_origin(address: Column, parts: int, shift: int) -> Column:
    """The vertex id back from its cyclic placement."""
    return local_of(address, shift) * parts + part_of(address, shift) - 1


def balance(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, vertices, edges, max_local) of each part; edges counts out-edges of its vertices."""
    d = degrees(edges)
    full = placed.join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return full.groupBy("part").agg(F.count("*").alias("vertices"), F.sum("degree").alias("edges"), F.max("local").alias("max_local"))


def balance_summary(report: DataFrame) -> DataFrame:
    """Means, sample deviations and maxima over the parts of a balance report."""
    return report.agg(
        F.avg("vertices").alias("vertices_mean"), F.stddev_samp("vertices").alias("vertices_stdev"), F.avg("edges").alias("edges_mean"), F.stddev_samp("edges").alias("edges_stdev"), F.max("edges").alias("edges_max"), F.max("max_local").alias("max_local")
    )


def edge_cut(placed: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """One row: edges, cut edges, and the cut expected at random, E (f - 1) / f."""
    a, b = (placed.select(F.col("id").alias(i), F.col("part").alias(p)) for i, p in (("src", "p"), ("dst", "q")))
    cut = edges.select("src", "dst").join(a, "src").join(b, "dst")
    return cut.agg(F.count("*").alias("edges"), F.sum((F.col("p") != F.col("q")).cast("long")).alias("cut")).withColumn("expected", F.col("edges") * (parts - 1) / F.lit(parts))


def recipients(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parts): in how many parts a vertex has neighbours: who must get its updates in pull mode."""
    b = placed.select(F.col("id").alias("dst"), "part")
    return edges.join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("part").alias("parts"))


def crossing_senders(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): vertices with a neighbour in another part; only their updates have to leave theirs."""
    a, b = (placed.select(F.col("id").alias(i), F.col("part").alias(p)) for i, p in (("src", "p"), ("dst", "q")))
    away = edges.select("src", "dst").join(a, "src").join(b, "dst").where("p <> q")
    return placed.select("id").join(away.select(F.col("src").alias("id")), "id", "left_semi")


def ranked_in_parts(parts: DataFrame, folder: str) -> DataFrame:
    """(id, part, local): places of vertices (id, part) in their parts, in id order, without one task for each part."""
    ranked = dense_rank_ids(parts.select("part", "id"), ["part", "id"], folder)
    first = ranked.groupBy("part").agg(F.min("rank").alias("first"))
    return ranked.join(F.broadcast(first), "part").select("id", "part", (F.col("rank") - F.col("first")).alias("local"))
