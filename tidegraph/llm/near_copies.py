"""Near-copy groups of whole texts: pairs whose 5-word shingle sets have a similarity of 0.8 or more.

A 64-bit SimHash with 3 bits to differ finds copies that are nearly whole; of pairs of similarity 0.8 to 0.9 it misses
most (the README has figures). So texts are candidates if their fingerprints link, or if they agree in one of BANDS
bands of their min-wise signature, which a pair of similarity 0.8 fails with a chance of 0.006 %. Candidates whose
signatures agree in LIKELY of all places are compared by the shingle sets themselves; only these decide.

Texts that share a band form a group. Groups are compared in two steps, so that no pairs are written out:

1. ROUNDS rounds link members to hubs: every group has a member drawn as its hub, and a member that isn't connected to
   it yet is compared with one hub, that of the most of its groups. Then all links are connected (stars), and groups of
   one component are done. This step saves work and decides nothing.
2. In what groups remain, all members that aren't connected yet are compared, each pair in the first band it shares
   only. A task gets two blocks of a group at a time, bounded by members and by bytes, compares signatures as arrays,
   and returns a link only if it connects what its blocks' other links don't: fewer links than members.

So every pair that shares a band is compared or already connected, and nothing depends on how many links were found.
Exact copies collapse to one node first. Of each component one document stays: that with the least doc_id (null last),
ties broken by the row's place.

Defined results: null and empty texts are equal texts, of which one stays; texts of fewer than 5 words are one shingle;
null and repeated doc_ids are handled by row; an empty table gives no rows; very long texts have long shingle sets, and
blocks of fewer members; all columns of docs are returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stars import star_components
from . import work
from .simhash import fingerprint, hamming_links, shingle_hashes

SHINGLE = 5
HASHES = 192
#: A pair links if its shingle sets have at least this similarity, as a fraction.
SIMILAR = (4, 5)
#: Share of equal places that a candidate needs to be worth comparing: 5 deviations below what similarity 0.8 gives.
LIKELY = 0.655
#: Places of the signature in a band.
WIDTH = 6
BANDS = HASHES // WIDTH
ROUNDS = 3
#: Members, and bytes of their shingle sets, in a block; a single larger set is a block of its own.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Hashes whose signature places are worked out at once: bounds a worker's memory beside its texts.
MIXED = 256
_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> bytes:
    """Min-wise signature of a set of shingle hashes: the low 2 bytes of each place's least value."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    unique = np.unique(hashes)
    for at in range(0, len(unique), MIXED):
        mixed = unique[at : at + MIXED, None] * _FACTORS
        mixed += _SHIFTS
        mixed >>= np.uint64(32)
        np.minimum(out, mixed.min(axis=0).astype(np.uint32), out=out)
    return (out & np.uint32(0xFFFF)).astype("<u2").tobytes()


def _sketch(batches):
    for batch in batches:
        hashes = [shingle_hashes(t, SHINGLE) for t in batch["text"]]
        yield batch[["file", "row", "doc_id", "no_id", "digest"]].assign(fp=[fingerprint(h) for h in hashes], sig=[signature(h) for h in hashes])


def _bands(batches):
    import xxhash

    for batch in batches:
        sigs = np.frombuffer(b"".join(batch["sig"]), "<u2").reshape(-1, BANDS, WIDTH)
        keys = [xxhash.xxh64_intdigest(sig[k].tobytes(), k) - (1 << 63) for sig in sigs for k in range(BANDS)]
        yield pd.DataFrame({"n": np.repeat(batch["n"].to_numpy(), BANDS), "band": np.tile(np.arange(BANDS, dtype=np.int32), len(batch)), "key": np.array(keys, np.int64)})


def _sets(batches):
    for batch in batches:
        yield batch[["n", "sig"]].assign(shingles=[np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in batch["text"]])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingle hashes are near copies; two empty sets are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= SIMILAR[0] * (len(a) + len(b) - both)


def _judge(batches):
    for batch in batches:
        if len(batch):
            a, b = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            same = (a == b).mean(axis=1) >= LIKELY
            for k in np.flatnonzero(same):
                same[k] = similar(*(np.frombuffer(batch[c].iloc[k], np.uint64) for c in ("set_a", "set_b")))
            yield batch[["a", "b"]][same]


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose texts are near copies. sets: n, sig, shingles."""
    of = lambda end: sets.select(F.col("n").alias(end), F.col("sig").alias(f"sig_{end}"), F.col("shingles").alias(f"set_{end}"))
    return work.spread(pairs).join(of("a"), "a").join(of("b"), "b").select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInPandas(work.tidy(_judge), "a long, b long")


def _met(groups: DataFrame, turn: int, folder: str) -> DataFrame:
    """Pairs (a, b): a is the hub of groups (key, n, component) that b is in without being connected to it.

    The hubs are written first, as all that has a row a group is here: Spark then knows its size, and broadcasts a small
    one without moving the members, or sorts and splits the members of a hot group.
    """
    order = F.col("n") if not turn else F.xxhash64("n", F.lit(turn))
    hubs = groups.groupBy("key").agg(F.min(F.struct(order.alias("order"), "n", "component")).alias("hub"))
    hubs = work.written(hubs, f"{folder}/hubs{turn}")
    apart = groups.join(work.spread(hubs), "key").where(F.col("component") != F.col("hub.component"))
    shared = apart.groupBy("n", F.col("hub.n").alias("a")).agg(F.count("*").alias("shared"))
    best = shared.groupBy("n").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best"))
    return best.select((-F.col("best.a")).alias("a"), F.col("n").alias("b"))


def _blocks(batches):
    """Members in the order of (key, one, two): the links of each block pair that connect what others of it don't."""
    at, held = None, []
    columns = ["n", "component", "part", "sig", "shingles"]

    def links():
        return pd.DataFrame(_compared(at[3], at[1] != at[2], held), columns=["a", "b"]).astype("int64")

    for batch in batches:
        for key, one, two, band, *member in zip(*(batch[c] for c in ("key", "one", "two", "band", *columns)), strict=True):
            if (key, one, two, band) != at:
                if held:
                    yield links()
                at, held = (key, one, two, band), []
            held.append(member)
    if held:
        yield links()


def _compared(band: int, two_blocks: bool, members: list) -> list[tuple[int, int]]:
    n, label, part = (np.array([m[k] for m in members]) for k in range(3))
    sig = np.frombuffer(b"".join(m[3] for m in members), "<u2").reshape(-1, HASHES)
    sets = [np.frombuffer(m[4], np.uint64) for m in members]
    found = []
    for k in range(1, len(n)):
        other = np.flatnonzero((label[:k] != label[k]) & ((part[:k] != part[k]) | (not two_blocks)))
        if not len(other):
            continue
        equal = sig[other] == sig[k]
        likely = equal.mean(axis=1) >= LIKELY
        first = equal[likely][:, : BANDS * WIDTH].reshape(-1, BANDS, WIDTH).all(axis=2).argmax(axis=1)
        for j in other[likely][first == band]:
            if label[j] != label[k] and similar(sets[j], sets[k]):
                found.append((min(n[j], n[k]), max(n[j], n[k])))
                label[label == label[j]] = label[k]
    return found


def _rest(groups: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """Links among the members of groups (key, band, n, component) that aren't connected yet."""
    rows = work.spread(groups).join(sets, "n")
    bytes_ = F.sum(F.length("shingles").cast("long"))
    sizes = work.written(rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, bytes_ / BLOCK_BYTES)).cast("int").alias("parts")), f"{folder}/sizes")
    dealt = groups.join(work.spread(sizes), "key").withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "band", "n", "component", "part").join(sets, "n")
    return dealt.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "n").mapInPandas(work.tidy(_blocks), "a long, b long")


def _labelled(groups: DataFrame, links: DataFrame, count: int, folder: str) -> DataFrame:
    """groups (key, band, n, ...) with n's component by the links; only those of more than one component. count: nodes."""
    known = star_components(links, folder).withColumnRenamed("id", "n")
    named = groups.select("key", "band", "n").join(work.spread(known, count), "n", "left").withColumn("component", F.coalesce("component", "n"))
    named = work.written(named.select("key", "band", "n", "component"), f"{folder}/labelled")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = work.written(mixed, f"{folder}/keys")
    return work.written(named.join(work.spread(mixed), "key"), f"{folder}/mixed")


def near_links(spark: SparkSession, nodes: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) that connect all near copies among nodes (n, first, fp, sig). texts: file, row, text."""
    count = nodes.count()
    fps = work.written(nodes.groupBy("fp").agg(F.min("n").alias("n")), f"{folder}/fps")
    of_fp = work.spread(fps.select(F.col("fp").alias("a"), F.col("n").alias("na")), count)
    near = hamming_links(fps.select("fp"), folder).join(of_fp, "a").join(of_fp.select(F.col("a").alias("b"), F.col("na").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = nodes.select("fp", F.col("n").alias("b")).join(work.spread(fps.select("fp", F.col("n").alias("a")), count), "fp").where("a <> b").select("a", "b")
    prints = work.written(near.unionByName(equal), f"{folder}/prints")
    groups = work.written(nodes.select("n", "sig").mapInPandas(work.tidy(_bands), "n long, band int, key long"), f"{folder}/bands")
    several = groups.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    several = work.written(several, f"{folder}/several")
    groups = work.written(groups.join(work.spread(several), "key"), f"{folder}/groups")
    wanted = groups.select("n").union(prints.select("a")).union(prints.select("b")).distinct()
    wanted = work.spread(wanted, count).join(nodes, "n")
    wanted = work.written(wanted.select("n", "sig", F.col("first.file").alias("file"), F.col("first.row").alias("row")), f"{folder}/wanted")
    sets = texts.join(work.small(wanted.select("n", "file", "row")), ["file", "row"]).select("n", "text").join(wanted.select("n", "sig"), "n")
    sets = work.written(sets.select("n", "sig", "text").mapInPandas(work.tidy(_sets), "n long, sig binary, shingles binary"), f"{folder}/sets")
    groups = groups.withColumn("component", F.col("n"))
    paths = []
    for turn in range(ROUNDS):
        met = _met(groups, turn, folder)
        pairs = work.written(met.unionByName(prints).distinct() if not turn else met, f"{folder}/pairs{turn}")
        paths.append(f"{folder}/links{turn}")
        work.written(_linked(pairs, sets), paths[-1])
        links = spark.read.schema("a long, b long").parquet(*paths)
        groups = _labelled(groups, links, count, f"{folder}/turn{turn}")
    work.written(_rest(groups, sets, folder), f"{folder}/rest")
    return spark.read.schema("a long, b long").parquet(*paths, f"{folder}/rest")


def without_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal or similar texts."""
    folder = work.work_folder(spark, "near")
    rows, place = work.placed(docs, folder)
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    texts = rows.select(F.col(place[0]).alias("file"), F.col(place[1]).alias("row"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"))
    sketches = work.written(texts.mapInPandas(work.tidy(_sketch), "file long, row long, doc_id long, no_id boolean, digest string, fp long, sig binary"), f"{folder}/sketches")
    first = F.min(F.struct("no_id", "doc_id", "file", "row")).alias("first")
    nodes = sketches.groupBy("digest").agg(first, F.any_value("fp").alias("fp"), F.any_value("sig").alias("sig"))
    nodes = nodes.repartitionByRange("first").sortWithinPartitions("first").withColumn("n", F.monotonically_increasing_id())  # n follows first
    nodes = work.written(nodes.select("n", "first", "fp", "sig"), f"{folder}/nodes")
    count = nodes.count()
    links = near_links(spark, nodes, texts.select("file", "row", "text"), folder)
    grouped = star_components(links, f"{folder}/all").withColumnRenamed("id", "n")
    kept = nodes.select("n", "first").join(work.spread(grouped, count), "n", "left").groupBy(F.coalesce("component", "n").alias("component")).agg(F.min("first").alias("first"))
    kept = kept.select(F.col("first.file").alias("file"), F.col("first.row").alias("row"))
    gone = work.written(sketches.select("file", "row").join(work.spread(kept, count), ["file", "row"], "left_anti").select(F.col("file").alias(place[0]), F.col("row").alias(place[1])), f"{folder}/gone")
    return rows.join(work.small(gone), place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
