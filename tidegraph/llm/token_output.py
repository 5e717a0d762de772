"""Token-ID output: documents to Simple-8b shard files in ascending doc_id order, and back.

A shard file is a magic word and frames. A frame holds whole documents: a header of four little-endian 64-bit counts
(documents, ids, blocks, words), then doc_ids (int64), a validity byte for each doc_id, ids per document (uint64), block
offsets (uint32) and the words (uint64). Shards are named by range partition and attempt; only the attempt that Spark
committed is named in the manifest, so a task that runs twice leaves an unread file and nothing worse.

Defined results: a null text is empty; a null doc_id sorts first and comes back as null; rows with equal doc_id are
kept apart and ordered by the text's hash; an empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b, work
from .tokens import default_tokenizer, encoder

MAGIC = b"TDS8B001"
#: Ids gathered before a frame is written: bounds a writer's memory beside one document.
FRAME_IDS = 1 << 20
END_ID = 0
MANIFEST = "shard int, path string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frame(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    head = struct.pack("<4Q", len(doc_ids), len(ids), len(offsets), len(words))
    return b"".join([head, keys.tobytes(), valid.tobytes(), np.array(lengths, "<u8").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def frames(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) of each frame of an open shard."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token shard")
    while head := stream.read(32):
        if len(head) < 32:
            raise ValueError("the token shard ends inside a frame")
        docs, n, blocks, words = struct.unpack("<4Q", head)
        take = lambda kind, k: np.frombuffer(stream.read(k * np.dtype(kind).itemsize), kind)
        keys, valid, lengths, offsets, coded = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u4", blocks), take("<u8", words)
        if len(coded) < words:
            raise ValueError("the token shard ends inside a frame")
        yield [int(k) if v else None for k, v in zip(keys, valid, strict=True)], lengths.astype(np.int64), simple8b.decode(coded, offsets, n)


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs (doc_id, text) as token shards below folder; returns the manifest, one row a shard, in order."""
    path = tokenizer or default_tokenizer()
    run = uuid.uuid4().hex[:8]

    def write(batches):
        import pandas as pd

        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        out, name = None, f"{folder}/{run}-{shard:07d}-{attempt}.tds8"
        keys, lengths, parts, held, n_docs, n_ids = [], [], [], 0, 0, 0

        def flush():
            nonlocal keys, lengths, parts, held
            out.write(frame(keys, lengths, np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)))
            keys, lengths, parts, held = [], [], [], 0

        for batch in batches:
            for key, missing, text in zip(batch["k"], batch["m"], batch["text"], strict=True):
                if out is None:
                    out = work.open_new(name)
                    out.write(MAGIC)
                ids = enc.encode(text) + end
                keys.append(None if missing else int(key))
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += lengths[-1]
                n_docs, n_ids = n_docs + 1, n_ids + lengths[-1]
                if held >= FRAME_IDS:
                    flush()
        if out is not None:
            if keys:
                flush()
            out.close()
            yield pd.DataFrame({"shard": [shard], "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    # the place only splits rows that are equal otherwise, however many there are
    ordered = ordered.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("doc_id").isNull().alias("m"), "text")
    return ordered.mapInPandas(work.tidy(write, "tokens"), MANIFEST)


def read_token_shards(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents back from the shards of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    start is the number of ids before the document over all shards in order; it needs one running sum over the
    manifest, which has one short row for each shard.
    """
    schema = DOCS + (", ids array<long>" if with_ids else "")

    def read(batches):
        import pandas as pd

        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                with work.open_read(path) as stream:
                    start = int(base)
                    for keys, lengths, ids in frames(stream):
                        ends = np.cumsum(lengths)
                        small = ids.astype("<u4")
                        rows = {"doc_id": pd.array(keys, dtype="Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": [zlib.crc32(small[a:b].tobytes()) for a, b in zip(ends - lengths, ends, strict=True)]}
                        if with_ids:
                            rows["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(ends - lengths, ends, strict=True)]
                        yield pd.DataFrame(rows)
                        start += int(ends[-1]) if len(ends) else 0

    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    shards = max(1, manifest.count())
    return placed.repartition(shards).mapInPandas(work.tidy(read), schema)


def token_output(spark: SparkSession, docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token shards and give, per document, what is read back from them."""
    folder = folder or work.work_folder(spark, "tokens")
    manifest = work.written(write_token_shards(docs, f"{folder}/shards", tokenizer), f"{folder}/manifest")
    return read_token_shards(manifest)
