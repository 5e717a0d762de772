"""Validation of BFS trees against the raw edges they came from, and integrity checks of runs.

A tree is (id, parent): a root is its own parent, unreached vertices have a null parent. Each check gives the number of
its violations; a valid tree has none, and the traversed edges (loops and repeats included) are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import checkpointed, spread

#: Check to the code that the public benchmark's validator reports, in the order in which it is given.
CODES = {"bad_root": -999, "no_level": -1, "left_out_of_range": -10, "right_out_of_range": -11, "right_not_in_tree": -12, "left_not_in_tree": -13, "levels_too_far": -14, "not_an_edge": -15, "second_root": -16}


def tree_levels(tree: DataFrame, root: int, vertices: int) -> DataFrame:
    """(id, level) by pointer doubling; null where the parents don't lead to the root (a cycle, or off the tree).

    Needs as many rounds as the longest path has binary digits: a round that brings no vertex home is the last, as the
    rest is on cycles.
    """
    state = tree.where("parent is not null").select("id", F.when(F.col("id") == root, F.col("id")).otherwise(F.col("parent")).alias("up"), F.when(F.col("id") == root, 0).otherwise(1).cast("long").alias("far"))
    state = checkpointed(state)
    rows, before = state.count(), None
    for _ in range(max(1, vertices).bit_length() + 1):
        away = state.where(F.col("up") != root).count()
        if away in (0, before):
            break
        before = away
        above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        state = checkpointed(state.join(spread(above, rows), "up", "left").select("id", F.coalesce("up2", F.lit(None)).alias("up"), (F.col("far") + F.col("far2")).alias("far")))
    return state.select("id", F.when((F.col("up") == root) & (F.col("far") < max(1, vertices)), F.col("far")).alias("level"))


def validate_bfs(tree: DataFrame, raw: DataFrame, root: int, max_id: int) -> DataFrame:
    """One row: violations of every check and traversed_edges. tree: (id, parent); raw: (v0, v1), loops and all."""
    n = max_id + 1
    inside = tree.where(F.col("id").between(0, max_id)).select("id", "parent")
    rows = tree.count()
    level = checkpointed(inside.join(spread(tree_levels(inside, root, n), rows), "id", "left").select("id", "parent", "level"))
    edges = raw.where("v0 >= 0 and v1 >= 0")
    left_out, right_out = F.col("v0") > max_id, F.col("v1") > max_id
    ends = edges.where(~left_out & ~right_out)
    a = level.select(F.col("id").alias("v0"), F.col("parent").alias("p0"), F.col("level").alias("l0"))
    b = level.select(F.col("id").alias("v1"), F.col("parent").alias("p1"), F.col("level").alias("l1"))
    met = ends.join(spread(a, rows), "v0", "left").join(spread(b, rows), "v1", "left")
    has0, has1 = F.col("p0").isNotNull(), F.col("p1").isNotNull()
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = has0 & has1
    on_edges = met.agg(one(has0 & ~has1).alias("right_not_in_tree"), one(has1 & ~has0).alias("left_not_in_tree"), one(both & F.coalesce(F.abs(F.col("l0") - F.col("l1")) > 1, F.lit(False))).alias("levels_too_far"), one(both).alias("traversed_edges"))
    ranges = edges.agg(one(left_out & ~right_out).alias("left_out_of_range"), one(right_out & ~left_out).alias("right_out_of_range"))
    either = edges.select(F.col("v0").alias("id"), F.col("v1").alias("parent")).unionByName(edges.select(F.col("v1").alias("id"), F.col("v0").alias("parent"))).where("id <> parent")
    hanging = level.where(F.col("parent").isNotNull() & (F.col("id") != root) & (F.col("parent") != F.col("id")))
    missing = hanging.join(spread(either), ["id", "parent"], "left_anti").agg(F.count("*").alias("not_an_edge"))
    tree_row = level.agg(
        F.when(one((F.col("id") == root) & F.coalesce(F.col("parent") == root, F.lit(False))) == 1, 0).otherwise(1).cast("long").alias("bad_root"),
        one(F.col("parent").isNotNull() & F.col("level").isNull() & (F.col("parent") != F.col("id"))).alias("no_level"),
        one((F.col("parent") == F.col("id")) & (F.col("id") != root)).alias("second_root"),
    )
    out = tree_row.crossJoin(on_edges).crossJoin(ranges).crossJoin(missing)  # four single rows
    return out.select(*CODES, "traversed_edges")


def verdict(report: DataFrame) -> int:
    """Traversed edges of a valid tree, or the first failed check's code."""
    row = report.first()
    return next((code for check, code in CODES.items() if row[check]), row["traversed_edges"])


def dangling_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that lead to no known vertex."""
    return edges.join(vertices.select(F.col("id").alias("dst")), "dst", "left_anti")


def miscounted(state: DataFrame) -> DataFrame:
    """Vertices of a PageRank state (id, degree, received) that got messages, but not one from each neighbour."""
    return state.where("received > 0 and received <> degree")


def components_valid(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges whose ends differ in color, and colors that are not the least id of their component."""
    a, b = (labels.select(F.col("id").alias(i), F.col("color").alias(c)) for i, c in (("src", "x"), ("dst", "y")))
    split = edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum((F.col("x") != F.col("y")).cast("long")), F.lit(0)).alias("split_edges"))
    least = labels.groupBy("color").agg(F.min("id").alias("least")).agg(F.coalesce(F.sum((F.col("least") != F.col("color")).cast("long")), F.lit(0)).alias("wrong_colors"))
    return split.crossJoin(least)  # two single rows


def distances_valid(state: DataFrame, edges: DataFrame, weight: str = "dist") -> DataFrame:
    """One row: edges that would shorten a distance, and reached vertices whose parent doesn't account for theirs."""
    a = state.select(F.col("id").alias("src"), F.col("dist").alias("ds"))
    b = state.select(F.col("id").alias("dst"), F.col("dist").alias("dd"), F.col("parent").alias("p"))
    e = edges.select("src", "dst", F.col(weight).alias("w")).join(a, "src").join(b, "dst").where("ds is not null")
    loose = (F.col("dd").isNull() | (F.col("ds") + F.col("w") < F.col("dd"))).cast("long")
    tight = ((F.col("p") == F.col("src")) & (F.col("ds") + F.col("w") == F.col("dd"))).cast("long")
    hung = state.where("dist is not null and parent <> id").count()
    return e.agg(F.coalesce(F.sum(loose), F.lit(0)).alias("improvable_edges"), (F.lit(hung) - F.coalesce(F.sum(tight), F.lit(0))).alias("loose_parents"))
