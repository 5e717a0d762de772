"""Benchmark decontamination: rare n-gram seeds join documents to test items, then Smith-Waterman alignment.

1. Each test item's word trigrams are its seeds, a table (item, place, seed). One pass over the documents looks their
   trigrams up in a Bloom filter of all seeds, which has at most FILTER_BITS bits however many items there are, and
   writes the hits.
2. The hits give each seed's document frequency. Rare seeds are kept; of common ones the rarest of every SPREAD places
   in a row, so that any stretch of an item keeps some, even of an item that very many documents hold. Hits and kept seeds meet in a join on the seed.
3. A hit's diagonal is its place in the document less its place in the item. Diagonals fall into tiles a little longer
   than the item, and again into tiles half a tile further on, so that hits near each other share one. Tiles are counted
   by aggregation; one with two hits (one, for items of up to 2 * SEED words) opens a window of a few item lengths.
4. Only documents with windows are read again, to cut the windows out. Windows join their items' words, and each pair is
   aligned word by word (match 2, mismatch and gap -1, local). The score is the best alignment's share of the item's own
   score; SCORE or more reports the pair.

All items are looked up at once; nothing that grows with the tables goes to the driver or into a task's closure.

Defined results: null texts hold nothing; items of fewer than 3 words have no seed and give no rows; a null doc_id or
item_id comes back as null; repeated rows give repeated pairs; very long texts are read in parts, and a text that
repeats an item is aligned window by window; of windows with equal scores the one with more hits, then the later one
is reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import work

WORD = re.compile(r"\w+")
NOT_WORD = re.compile(r"\W")
SEED = 3
SCORE = 0.42
MATCH, MISMATCH, GAP = 2, -1, -1
#: Documents that may hold a rare seed: this share of them, or LEAST_RARE where that is more.
RARE_SHARE, LEAST_RARE = 0.001, 20
#: Of so many places of an item in a row, the rarest seed is kept even if it is common.
SPREAD = 3
#: Bits of the seeds' filter, at most (16 MB); two are set for each seed.
FILTER_BITS = 1 << 27
#: Windows up to which their list is broadcast to the documents (some 32 bytes each); more are joined by a shuffle.
FEW_WINDOWS = 250_000
#: Words of a window and its lane, times lanes that are aligned side by side.
CELLS = 1 << 20
#: Characters of a text that are split into words at a time, and words whose hashes a worker keeps.
CHUNK, KEPT = 1 << 20, 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    """Word to its 64-bit hash, kept in a bounded table."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


_hashes = _Hashes()
work.CACHES["words"] = _hashes.clear


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words, in order."""
    parts, at = [], 0
    text = text or ""
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            stop = NOT_WORD.search(text, end)
            end = stop.start() if stop else len(text)
        words = words_of(text[at:end])
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def seeds_of(words: np.ndarray) -> np.ndarray:
    """The hash of the trigram that starts at each word."""
    if len(words) < SEED:
        return np.zeros(0, np.int64)
    h = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, place in the text where it ends) of each pair, computed along anti-diagonals side by side."""
    lanes, m, n = len(items), max(map(len, items)), max(map(len, texts))
    _, codes = np.unique(np.concatenate([*items, *texts]), return_inverse=True)
    a = np.full((lanes, m), -3, np.int32)
    b = np.full((lanes, n + 2 * m), -2, np.int32)
    at = 0
    for rows, first, group in ((a, 0, items), (b, m, texts)):
        for k, x in enumerate(group):
            rows[k, first : first + len(x)] = codes[at : at + len(x)]
            at += len(x)
    before, last = np.zeros((lanes, m + 1), np.int32), np.zeros((lanes, m + 1), np.int32)
    best, end = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
    back = b[:, ::-1]  # so that an anti-diagonal is a slice
    width = b.shape[1]
    lane = np.arange(lanes)
    for d in range(m + n - 1):
        same = a == back[:, width - 1 - m - d : width - 1 - d]
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(before[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), np.maximum(last[:, :-1], last[:, 1:]) + np.int32(GAP))
        np.maximum(now, 0, out=now)
        top = now.argmax(axis=1)
        value = now[lane, top]
        better = value > best
        best[better] = value[better]
        end[better] = (d - (top - 1))[better]
        before, last = last, now
    return best, end


def lanes(items: list[np.ndarray], texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Pairs of like lengths, as many at a time as CELLS allow."""
    size = np.array([len(x) * 2 + len(y) for x, y in zip(items, texts, strict=True)])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, CELLS // max(1, int(size[order[at]]))))
        while end > at + 1 and (end - at) * size[order[end - 1]] > CELLS:
            end = at + max(1, (end - at) // 2)
        yield order[at:end]
        at = end


def _item_seeds(batches):
    for batch in batches:
        rows = [(u, word_hashes(text)) for u, text in zip(batch["u"].tolist(), batch["text"], strict=True)]
        rows = [(u, words, seeds_of(words)) for u, words in rows if len(words) >= SEED]
        u = np.repeat(np.array([u for u, *_ in rows], np.int64), [len(s) for *_, s in rows])
        size = np.repeat(np.array([len(w) for _, w, _ in rows], np.int32), [len(s) for *_, s in rows])
        place = np.concatenate([np.arange(len(s), dtype=np.int32) for *_, s in rows]) if rows else np.zeros(0, np.int32)
        yield pd.DataFrame({"u": u, "size": size, "place": place, "seed": np.concatenate([s for *_, s in rows]) if rows else np.zeros(0, np.int64)})


def _item_words(batches):
    for batch in batches:
        yield batch[["u"]].assign(item=[word_hashes(t).tobytes() for t in batch["text"]])


def _bits(seed):
    """The two bits of a seed in the filter, before they are reduced to its size."""
    return [F.shiftrightunsigned(seed, 20), F.shiftrightunsigned(F.xxhash64(seed), 20)]


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """The seeds' Bloom filter, as 64-bit words, and the number of its bits (a power of 2, at most FILTER_BITS)."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 64 * seeds.count()):
        bits *= 2
    bit = F.explode(F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in _bits(F.col("seed"))]))
    words = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toPandas()
    out = np.zeros(bits // 64, np.int64)  # as many rows as the filter has words, at most
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out, bits


def _found(words: np.ndarray, bits: int, seeds: np.ndarray, mixed: np.ndarray) -> np.ndarray:
    hit = np.ones(len(seeds), bool)
    for x in (seeds, mixed):
        bit = (x.view(np.uint64) >> np.uint64(20)) & np.uint64(bits - 1)
        hit &= (words[(bit >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return hit


def xxh64_longs(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of one long column, by its public definition."""
    p = [np.uint64(v) for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]
    rotated = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    k = rotated(x.view(np.uint64) * p[1], 31) * p[0]
    with np.errstate(over="ignore"):
        h = rotated(k ^ (np.uint64(seed) + p[4] + np.uint64(8)), 27) * p[0] + p[3]
    h = (h ^ (h >> np.uint64(33))) * p[1]
    h = (h ^ (h >> np.uint64(29))) * p[2]
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _looker(shared, bits: int):
    def look(batches):
        words = shared.value
        for batch in batches:
            file, row, seed, at, first = [], [], [], [], []
            for f, r, text in zip(batch["file"].tolist(), batch["row"].tolist(), batch["text"], strict=True):
                seeds = seeds_of(word_hashes(text))
                hit = np.flatnonzero(_found(words, bits, seeds, seeds))
                hit = hit[_found(words, bits, xxh64_longs(seeds[hit]), seeds[hit])] if len(hit) else hit
                file.append(np.full(len(hit), f))
                row.append(np.full(len(hit), r))
                seed.append(seeds[hit])
                at.append(hit)
                new = np.zeros(len(hit), bool)
                new[np.unique(seeds[hit], return_index=True)[1]] = True
                first.append(new)
            if file:
                yield pd.DataFrame({"file": np.concatenate(file), "row": np.concatenate(row), "seed": np.concatenate(seed), "at": np.concatenate(at), "first": np.concatenate(first)})

    return look


def _cut(batches):
    for batch in batches:
        out = []
        for f, r, text, windows in zip(batch["file"].tolist(), batch["row"].tolist(), batch["text"], batch["windows"], strict=True):
            words = word_hashes(text)
            out += [(f, r, w["u"], w["start"], w["hits"], words[w["start"] : w["end"]].tobytes()) for w in windows]
        yield pd.DataFrame(out, columns=["file", "row", "u", "start", "hits", "words"])


def _align(batches):
    for batch in batches:
        items = [np.frombuffer(x, np.uint64) for x in batch["item"]]
        texts = [np.frombuffer(x, np.uint64) for x in batch["words"]]
        best, end = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for rows in lanes(items, texts):
            best[rows], end[rows] = align([items[k] for k in rows], [texts[k] for k in rows])
        share = best / np.array([MATCH * len(x) for x in items]) if len(items) else best.astype(float)
        yield batch[["file", "row", "u", "hits"]].assign(score=share, end=end + batch["start"].to_numpy())


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, folder: str, score: float = SCORE) -> tuple[DataFrame, DataFrame]:
    """(pairs, items): (file, row, u, score, hits, end) of docs (file, row, text) and items (u, item_id), each pair once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("u"))
    items = work.written(items, f"{folder}/items")
    seeds = work.written(items.select("u", "text").mapInPandas(work.tidy(_item_seeds), "u long, size int, place int, seed long"), f"{folder}/seeds")
    words, bits = _filter(seeds.select("seed").distinct())
    shared = spark.sparkContext.broadcast(words)
    hits = work.written(docs.mapInPandas(work.tidy(_looker(shared, bits), "words"), "file long, row long, seed long, at int, first boolean"), f"{folder}/hits")
    common = hits.groupBy("seed").agg(F.sum(F.col("first").cast("long")).alias("held"))
    rare = F.col("held") <= F.greatest(F.lit(float(LEAST_RARE)), F.lit(RARE_SHARE) * F.lit(docs.count()))
    near = Window.partitionBy("u", F.floor(F.col("place") / SPREAD))  # of SPREAD rows
    order = F.struct("held", "place")
    kept = seeds.join(common, "seed").withColumn("rarest", F.min(order).over(near) == order).where(rare | F.col("rarest"))
    kept = work.written(kept.select("u", "size", "place", "seed"), f"{folder}/kept")
    diagonal = hits.select("file", "row", "seed", "at").join(kept, "seed").select("file", "row", "u", "size", "at", (F.col("at") - F.col("place")).alias("diagonal"))
    tile = F.col("size") + 8
    tiles = F.array(F.floor(F.col("diagonal") / tile) * 2, F.floor(F.col("diagonal") / tile + 0.5) * 2 + 1)
    told = diagonal.withColumn("tile", F.explode(tiles)).groupBy("file", "row", "u", "size", "tile").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("hits"))
    told = told.where((F.col("first") < F.col("last")) | (F.col("size") <= 2 * SEED))
    told = told.where((F.col("tile") % 2 == 0) | (F.floor(F.col("low") / tile) != F.floor(F.col("high") / tile)))
    slack = F.floor(F.col("size") / 2) + 4
    window = F.struct("u", F.greatest(F.lit(0), F.col("low") - slack).cast("int").alias("start"), (F.col("high") + F.col("size") + slack).cast("int").alias("end"), F.col("hits").cast("int").alias("hits"))
    wanted = work.written(told.groupBy("file", "row").agg(F.collect_list(window).alias("windows")), f"{folder}/windows")
    n = wanted.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    cut = docs.join(F.broadcast(wanted) if n <= FEW_WINDOWS else wanted, ["file", "row"]).select("file", "row", "text", "windows").mapInPandas(work.tidy(_cut, "words"), "file long, row long, u long, start int, hits int, words binary")
    cut = work.written(cut, f"{folder}/cut")  # so that no task has two Python workers
    item_words = work.written(items.join(seeds.select("u").distinct(), "u").select("u", "text").mapInPandas(work.tidy(_item_words), "u long, item binary"), f"{folder}/item_words")
    aligned = cut.join(item_words, "u").select("file", "row", "u", "start", "hits", "words", "item").mapInPandas(work.tidy(_align), "file long, row long, u long, hits int, score double, end long")
    best = aligned.where(F.col("score") >= score).groupBy("file", "row", "u").agg(F.max(F.struct("score", "hits", "end")).alias("best"))
    return best.select("file", "row", "u", "best.*"), items.select("u", "item_id")


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """One row for each document and test item that it holds a copy of: doc_id, item_id, score, seeds, ends_at_word."""
    folder = work.work_folder(spark, "leaks")
    rows, place = work.placed(docs, folder)
    rows = rows.select(F.col(place[0]).alias("file"), F.col(place[1]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs, items = matches(spark, rows.select("file", "row", "text"), benchmark, folder, score)
    pairs = work.written(pairs.join(items, "u"), f"{folder}/pairs")
    named = work.small(pairs).join(rows.select("file", "row", "doc_id"), ["file", "row"])
    return named.select("doc_id", "item_id", F.round("score", 6).alias("score"), F.col("hits").alias("seeds"), F.col("end").alias("ends_at_word"))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """docs without the rows that hold a copy of a test item."""
    folder = work.work_folder(spark, "leaks")
    rows, place = work.placed(docs, folder)
    small = rows.select(F.col(place[0]).alias("file"), F.col(place[1]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    pairs, _ = matches(spark, small, benchmark, folder, score)
    gone = work.written(pairs.select(F.col("file").alias(place[0]), F.col("row").alias(place[1])).distinct(), f"{folder}/gone")
    return rows.join(work.small(gone), place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
