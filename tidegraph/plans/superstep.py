"""The superstep engine: vertex programs as column expressions, run as DataFrame plans.

One superstep is: active vertices (scatter) ⋈ edges → messages → group by destination (gather) → join into the state
(apply). Messages combine before they are shuffled. The state is cut at every superstep by checkpoint(), which keeps
its partitioning, so that the state itself is not shuffled again; edges are dealt by source once and kept.

Strategies: "push" sends updates to the edges' partitions and messages to their destinations; Spark may still broadcast
updates whose measured size is small. "pull" broadcasts the updates to edges dealt by destination, so messages need no
shuffle; it is taken only while the updates' number is under PULL_ROWS, and push otherwise.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import checkpoint_folder, checkpointed, drop_path, spread, work_folder, written

#: Updates that may be broadcast: some 16 bytes each, so a few tens of megabytes at the very most.
PULL_ROWS = 500_000


@dataclass
class Program:
    """A vertex program. Expressions see columns by name.

    init: state columns, over the vertices' columns. active: who sends first, over the state.
    send: message fields, over the sender's state, its id as "sender", its out-degree as "degree" if asked for, and the
    edge's other columns. send_if: which messages are sent.
    gather: aggregates of message fields, by destination.
    apply: new state columns, over the old state and the gathered columns (null where no message came) and "step".
    activate: who sends next, over the same.
    """

    name: str
    init: dict[str, Column]
    active: Column
    send: dict[str, Column]
    gather: dict[str, Column]
    apply: dict[str, Column]
    activate: Column
    send_if: Column | None = None
    max_steps: int | None = None
    halts: bool = True
    cut_every: int = 1


@dataclass
class Run:
    """A finished run: the state (id, ...), the number of supersteps, and one telemetry entry a superstep."""

    state: DataFrame
    steps: int
    telemetry: list[dict] = field(default_factory=list)


REGISTRY: dict[str, Callable[..., Program]] = {}


def register(name: str):
    """Add a program's maker to the registry by which configurations name it."""

    def add(make: Callable[..., Program]) -> Callable[..., Program]:
        REGISTRY[name] = make
        return make

    return add


def messages(updates: DataFrame, edges: DataFrame, program: Program) -> DataFrame:
    """Scatter: one message for each update and edge that send_if lets pass. updates: src, state columns."""
    sent = updates.join(edges, "src").withColumn("sender", F.col("src"))
    if program.send_if is not None:
        sent = sent.where(program.send_if)
    return sent.select("dst", *[c.alias(f"msg_{k}") for k, c in program.send.items()])


def _cut(state: DataFrame) -> tuple[DataFrame, int]:
    """The state at a checkpoint, and how many vertices are active: counted by the job that writes it."""
    counted = Observation()
    out = checkpointed(state.observe(counted, F.count(F.when(F.col("active"), 1)).alias("active")))
    return out, counted.get["active"]


def run(graph: Graph, program: Program, max_steps: int | None = None, strategy: str = "push", telemetry: bool = False) -> Run:
    """Run a program until no vertex is active, or for max_steps supersteps."""
    if strategy not in ("push", "pull"):
        raise ValueError(f"unknown strategy {strategy!r}")
    limit = max_steps if max_steps is not None else program.max_steps
    state_columns = list(program.init)
    state = graph.vertices.select("id", *[c.alias(k) for k, c in program.init.items()])
    state, active = _cut(state.withColumn("active", program.active))
    by_src = graph.co_located("src")
    by_dst = graph.co_located("dst") if strategy == "pull" else None
    # Who has edges at all, dealt as the state is: pull mode broadcasts the updates of no others.
    senders = by_src.edges.select(F.col("src").alias("id")).distinct().persist() if strategy == "pull" else None
    log: list[dict] = []
    folders = [checkpoint_folder(state)]
    step = 0
    try:
        while limit is None or step < limit:
            began = time.time()
            if program.halts and not active:
                break
            sending = state.where("active")
            updates = (sending if senders is None else sending.join(senders, "id", "left_semi")).select(F.col("id").alias("src"), *state_columns)
            pull = strategy == "pull" and active <= PULL_ROWS
            if pull:
                sent = messages(F.broadcast(updates), by_dst.edges, program)
            else:
                sent = messages(spread(updates, active), by_src.edges, program)
            if telemetry:
                counts = Observation()
                sent = sent.observe(counts, F.count("*").alias("messages"))
            gathered = sent.groupBy(F.col("dst").alias("id")).agg(*[c.alias(k) for k, c in program.gather.items()])
            joined = state.join(gathered, "id", "left").withColumn("step", F.lit(step))
            state = joined.select("id", *[c.alias(k) for k, c in program.apply.items()], F.coalesce(program.activate, F.lit(False)).alias("active"))
            step += 1
            if step % program.cut_every == 0 or program.halts or telemetry or strategy == "pull":
                if telemetry:
                    before = active
                state, active = _cut(state)
                folders.append(checkpoint_folder(state))
                for old in filter(None, folders[:-2]):  # the state is read from the last one only
                    drop_path(state.sparkSession, old)
                folders = folders[-2:]
            if telemetry:
                log.append({"superstep": step - 1, "updates": before, "messages": counts.get["messages"], "strategy": "pull" if pull else "push", "seconds": time.time() - began})
    finally:
        by_src.release()
        if by_dst is not None:
            by_dst.release()
            senders.unpersist()
    return Run(state.select("id", *state_columns), step, log)


@dataclass
class Relay:
    """A message-driven program: every message acts on its own, nothing is gathered first.

    start: fields of the updates that all vertices send first, over the vertices' columns. send_if: which edges an update
    takes, over its fields, "sender", "dst" and the edge's columns. forward: fields of the update that a message makes at
    its destination, over the message's fields; keep: which messages make one. What they don't keep is the outcome.
    """

    name: str
    start: dict[str, Column]
    send_if: Column
    forward: dict[str, Column]
    keep: Column
    max_steps: int


def relay(graph: Graph, program: Relay, batches: DataFrame | None = None) -> DataFrame:
    """Run a relay; returns the messages (id, fields) that ended at a vertex instead of being forwarded.

    batches: (id, batch); the vertices of a batch start when those of the batch before have ended. Without it all start
    at once.
    """
    by_src = graph.co_located("src")
    spark = graph.edges.sparkSession
    folder = work_folder(spark, "relay")
    turns = [None] if batches is None else [r[0] for r in batches.select("batch").distinct().orderBy("batch").toLocalIterator()]
    paths, schema = [], None
    try:
        for turn in turns:
            first = graph.vertices if turn is None else graph.vertices.join(batches.where(F.col("batch") == F.lit(turn)).select("id"), "id")
            updates = first.select(F.col("id").alias("src"), *[c.alias(k) for k, c in program.start.items()])
            for _ in range(program.max_steps):
                sent = updates.join(by_src.edges, "src").withColumn("sender", F.col("src")).where(program.send_if).select(F.col("dst").alias("id"), *program.start, program.keep.alias("__keep"))
                paths.append(f"{folder}/{len(paths)}")
                sent = written(sent, paths[-1])
                schema = sent.schema
                updates = sent.where("__keep").select(F.col("id").alias("src"), *[c.alias(k) for k, c in program.forward.items()])
                if updates.isEmpty():
                    break
    finally:
        by_src.release()
    if not paths:
        return graph.vertices.where("false").select("id", *[c.alias(k) for k, c in program.start.items()])
    return spark.read.schema(schema).parquet(*paths).where("not __keep").drop("__keep")
