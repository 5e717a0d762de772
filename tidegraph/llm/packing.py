"""Best-fit packing of tokenized documents into sequences, by bulk-synchronous sweeps.

Each document becomes ids and an end id. Documents longer than a sequence are cut: the remainder is the first piece,
all others fill a sequence of their own. The remainders are packed:

1. Pieces over half a sequence can't share one, so each opens a sequence and leaves a gap. Before every round as many
   empty sequences are opened as the pieces exceed all gaps together by: whatever the packing, no fewer will do.
2. A round puts the pieces and the gaps into one order by size, descending, dealt over range partitions. Going down
   this order, a piece takes the nearest gap above it that no piece before it has taken: its best fit; between pieces
   that want one gap, the rank in the order decides. Each partition resolves its own range with a stack; what is left
   of it is some pieces that look for gaps further up and some gaps free for pieces further down. A carry over the
   partitions' counts (two numbers each) pairs these by ranges of ranks, and two joins hand the gaps over.
3. Gaps shrink by what they took, and the round is repeated until every piece has its place. While all open pieces are
   less than half of a gap, the gap stands in the order as several slots, so that small pieces don't need a round each.
4. When a round places nothing, as many empty sequences are opened as the rest fills at least.

No step holds more than one range partition or constant data in a task, and every round's state is a written table.
The driver sees a few sums and two numbers a partition; the method is the same at every size.

Defined results: a null text is one end id; null and repeated doc_ids are kept (rows are told apart by a key of their
own); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work
from .tokens import default_tokenizer, encoder

LENGTH = 1024
END_ID = 2
#: Sequences opened empty are numbered from here; those opened by a piece have its number, which is lower.
EMPTY_FROM = 1 << 62
PIECES = "u long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the remainder first."""
    first = n % length or length
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces_of(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, kept: int | None = None) -> DataFrame:
    """One row for each piece; u numbers the pieces of the whole table without coordination."""
    path = tokenizer or default_tokenizer()

    def make(batches):
        import pandas as pd

        enc, end = encoder(path, kept), np.array([end_id], "<u4").tobytes()
        u = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for key, missing, text in zip(batch["k"], batch["m"], batch["text"], strict=True):
                ids = enc.encode(text) + end
                for k, (at, n) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((u, None if missing else int(key), k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    u += 1
            out = pd.DataFrame(rows, columns=["u", "doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    key = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(work.tidy(make, "tokens"), PIECES)


def _local_sweep(batches):
    """Stack over one range partition: pairs within it (kind 2), pieces left (1) and gaps left (0) with their ranks."""
    import pandas as pd

    part = TaskContext.get().partitionId()
    stack: list[tuple[int, int]] = []
    left = 0
    columns = ["kind", "id", "size", "seq", "part", "rank"]
    for batch in batches:
        rows = []
        for kind, size, key in zip(batch["kind"].tolist(), batch["size"].tolist(), batch["id"].tolist(), strict=True):
            if kind == 0:
                stack.append((key, size))
            elif stack:
                rows.append((2, key, size, stack.pop()[0], part, 0))
            else:
                rows.append((1, key, size, -1, part, left))
                left += 1
        if rows:
            yield pd.DataFrame(rows, columns=columns)
    if stack:
        yield pd.DataFrame([(0, key, size, key, part, i) for i, (key, size) in enumerate(stack)], columns=columns)


def carry(counts: dict[int, tuple[int, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """Pairs what the ranges left over. counts: partition to (gaps, pieces) left, in order of the partitions.

    Gives, for each partition with pieces left, (first piece rank, how many, gap partition, rank of the first gap taken;
    the next pieces take the gaps below it).
    """
    stack: list[list[int]] = []
    taken: dict[int, list[tuple[int, int, int, int]]] = {}
    for part in sorted(counts):
        gaps, wanted = counts[part]
        at = 0
        while at < wanted and stack:
            top = stack[-1]
            n = min(wanted - at, top[1])
            taken.setdefault(part, []).append((at, n, top[0], top[1] - 1))
            at += n
            top[1] -= n
            if not top[1]:
                stack.pop()
        if gaps:
            stack.append([part, gaps])
    return taken


def _sweep(items: DataFrame, gaps: DataFrame, folder: str, largest: int, most_slots: int) -> DataFrame:
    """One round. items (id, size), gaps (seq, gap); returns items with seq, null where none was found."""
    spark = items.sparkSession
    slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / F.lit(largest)), F.lit(most_slots))).cast("int")
    open_ = gaps.select("seq", "gap", slots.alias("n")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
    open_ = open_.select(F.lit(0).alias("kind"), F.floor(F.col("gap") / F.col("n")).cast("long").alias("size"), F.col("seq").alias("id"))
    rows = items.select(F.lit(1).alias("kind"), "size", "id").unionByName(open_)
    order = [F.col("size").desc(), F.col("kind").asc(), F.col("id").asc()]
    swept = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(work.tidy(_local_sweep), "kind int, id long, size long, seq long, part int, rank long")
    swept = work.written(swept, f"{folder}/swept")
    counts = {r["part"]: (r["gaps"], r["pieces"]) for r in swept.where("kind < 2").groupBy("part").agg(F.sum(F.expr("int(kind = 0)")).alias("gaps"), F.sum(F.expr("int(kind = 1)")).alias("pieces")).collect()}
    runs = [(p, at, at + n, gp, top + at) for p, found in carry(counts).items() for at, n, gp, top in found]
    # a run ends a partition's pieces or a partition's gaps, so there are two a range partition at most
    columns = zip(*runs, strict=True) if runs else [()] * 5
    kinds = {"part": pa.int32(), "low": pa.int64(), "high": pa.int64(), "gp": pa.int32(), "turn": pa.int64()}
    taken = F.broadcast(spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))))
    looking = swept.where("kind = 1").select("id", "size", "part", "rank").alias("p")
    looking = looking.join(taken.alias("t"), F.expr("p.part = t.part and p.rank >= t.low and p.rank < t.high"), "left").select("id", "size", "gp", (F.col("turn") - F.col("rank")).alias("gr"))
    free = swept.where("kind = 0").select(F.col("part").alias("gp"), F.col("rank").alias("gr"), F.col("seq").alias("given"))
    looking = looking.join(free, ["gp", "gr"], "left").select("id", "size", F.col("given").alias("seq"))
    return work.written(swept.where("kind = 2").select("id", "size", "seq").unionByName(looking), f"{folder}/result")


def place(items: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """Sequence of each piece shorter than a sequence. items: id, size; ids differ and lie below EMPTY_FROM."""
    spark = items.sparkSession
    large = items.where(F.col("size") > length // 2)
    gaps = large.select(F.col("id").alias("seq"), (F.lit(length) - F.col("size")).alias("gap"))
    left, done, empty, k, stuck = items.where(F.col("size") <= length // 2), [], 0, 0, False
    while True:
        # nothing is collected but these figures
        n, most, least, total = left.agg(F.count("*"), F.max("size"), F.min("size"), F.sum("size")).first()
        if not n:
            break
        gaps = gaps.where(F.col("gap") >= least)
        holes, room = gaps.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
        new = math.ceil(total / length) if stuck else max(0, math.ceil((total - room) / length))
        if new:
            gaps = gaps.unionByName(spark.range(empty, empty + new).select((F.col("id") + EMPTY_FROM).alias("seq"), F.lit(length).cast("long").alias("gap")))
            empty, holes = empty + new, holes + new
        at = f"{folder}/round{k}"
        # twice as many slots as pieces are enough, and one a gap
        found = _sweep(left, gaps, at, most, math.ceil(2 * n / holes))
        placed = found.where("seq is not null")
        done.append(f"{at}/result")
        used = placed.groupBy("seq").agg(F.sum("size").alias("used"))
        gaps = gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
        gaps = work.written(gaps.where(F.col("gap") > 0), f"{at}/gaps")
        left = found.where("seq is null").select("id", "size")
        stuck = placed.isEmpty()
        k += 1
    out = large.select("id", F.col("id").alias("seq"))
    if done:
        out = out.unionByName(spark.read.schema("id long, size long, seq long").parquet(*done).where("seq is not null").select("id", "seq"))
    return out


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, kept: int | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text) with their sequence and their offset in it. kept: see tokens.encoder."""
    folder = work.work_folder(spark, "packing")
    pieces = work.written(pieces_of(docs, tokenizer, end_id, length, kept), f"{folder}/pieces")
    items = pieces.where(F.col("length") < length).select(F.col("u").alias("id"), F.col("length").alias("size"))
    seqs = place(items, folder, length).select(F.col("id").alias("u"), F.col("seq").alias("sequence_id"))
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", F.col("u"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    shared = pieces.where(F.col("length") < length).join(seqs, "u")
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "u").rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.select(*columns, F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return shared.unionByName(full.select(*columns, F.lit(0).cast("long").alias("offset")))
