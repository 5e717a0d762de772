"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have it set. Two fingerprints link if they
differ in 3 bits at most. Links are found on distinct fingerprints, so any number of exact copies costs one row:

1. A fingerprint has two segments of 32 bits. Of 3 differing bits one segment holds 1 at most, so looking up a segment's
   Hamming ball of radius 1 in the table of that segment loses no link. Segments at distance 1 differ in parity, so only
   those of odd parity enumerate their ball; equal segments meet anyway.
2. Probes first meet the count of their bucket, one row a bucket, so nothing multiplies there. Probes of buckets up to
   BUCKET fetch the matches, whose complete distance is verified.
3. The fingerprints of larger buckets, and those that probe them, go another exact way, which makes no pairs: each
   emits keys around it in the full 64-bit space (itself and all single flips; those of even parity also all pair flips
   within a half). Who shares a key with a fingerprint at distance 1 or less of that key is within 3 bits of it, so all
   members of such a key are linked to one of these. Any two fingerprints within 3 bits share such a key: at distance 3
   two of the three bits lie in one half. The rows grow with the number of fingerprints, never with a bucket's square.
4. Components come from alternating stars over the links.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other; a
null doc_id keeps its row and never becomes a component id (a component of such rows only has null); repeated rows are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stars import star_components
from . import work

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Matches are fetched from buckets up to this size; larger ones go by shared keys, equally exact.
BUCKET = 128
_LOW = 0xFFFFFFFF


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of a text, repeats included; fewer words make one shingle, none none."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 9-13 and 32 only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(k)), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint as a signed number, as Spark's long holds it."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8"))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text), one row for each."""

    def run(batches):
        for batch in batches:
            yield batch[["k", "m"]].assign(fp=[fingerprint(shingle_hashes(t, k)) for t in batch["text"]])

    key = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(work.tidy(run), "k long, m boolean, fp long").select(F.when(~F.col("m"), F.col("k")).alias("doc_id"), "fp")


def _segments(fps: DataFrame) -> DataFrame:
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(_LOW))
    return fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("key")), F.struct(F.lit(1).alias("side"), low.alias("key")))).alias("s")).select("s.side", "s.key", "fp")


def _flips(masks: list[int]):
    """Array column: fp with each mask applied."""
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _by_shared_keys(fps: DataFrame, count: int, tasks: int) -> DataFrame:
    """Links (a, b) that span the same components as all links within 3 bits of fps, without making pairs."""
    single = [0] + [_signed(1 << i) for i in range(64)]
    double = [_signed((1 << i) | (1 << j)) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    dealt = fps.repartition(tasks, "fp")
    near = dealt.select("fp", F.explode(_flips(single)).alias("key"), F.lit(True).alias("near"))
    far = dealt.where(F.bit_count("fp") % 2 == 0).select("fp", F.explode(_flips(double)).alias("key"), F.lit(False).alias("near"))
    keys = near.unionByName(far)
    hubs = keys.groupBy("key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
    return keys.join(work.spread(hubs.select("key", "hub"), count * (len(single) + len(double))), "key").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def hamming_links(fps: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp within 3 bits: all, or for large buckets as many as connect them."""
    spark = fps.sparkSession
    most = fps.count() * 2 * (1 + 32)  # probes
    table = _segments(fps)
    odd = (F.bit_count("key") % 2) == 1
    ball = F.when(odd, F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("key").bitwiseXOR(F.expr("1L").cast("long") * F.pow(F.lit(2), i).cast("long")))).otherwise(F.array().cast("array<long>"))
    own = table.select("side", "key", "fp", F.lit(True).alias("own"))
    others = table.select("side", F.explode(ball).alias("key"), "fp", F.lit(False).alias("own"))
    sizes = table.groupBy("side", "key").agg(F.count("*").alias("n"))
    hits = own.unionByName(others).join(work.spread(sizes, most), ["side", "key"]).where(~F.col("own") | (F.col("n") > 1))
    hits = work.written(hits, f"{folder}/hits")
    mine = table.withColumnRenamed("fp", "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS
    pairs = hits.where(F.col("n") <= bucket).join(work.spread(mine, most), ["side", "key"]).where(near & (~F.col("own") | (F.col("fp") < F.col("other"))) & (F.col("fp") != F.col("other")))
    links = pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    large = hits.where(F.col("n") > bucket).select("fp").distinct()
    count = large.count()
    if not count:
        return links
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    return links.unionByName(_by_shared_keys(large, count, tasks))


def components(members: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of members (doc_id, fp)."""
    nodes = work.written(members.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/nodes")
    count = nodes.count()
    links = hamming_links(nodes.select("fp"), folder, bucket)
    stars = star_components(links, folder).withColumnRenamed("id", "fp")
    labelled = work.written(nodes.join(work.spread(stars, count), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), f"{folder}/labelled")
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return labelled.join(work.spread(ids, count), "component").select("fp", "component_id")


def simhash_groups(spark: SparkSession, docs: DataFrame, k: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach)."""
    folder = work.work_folder(spark, "simhash")
    members = work.written(fingerprints(docs, k), f"{folder}/members")
    found = components(members, folder, bucket)
    return members.join(work.spread(found, members.count()), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
