import os
import zlib

import numpy as np
import pytest

from tidegraph.llm import packing
from tidegraph.llm.tokens import default_tokenizer, encoder


def _check(rows, texts, length=1024, end=2):
    """Every document whole, in order and cut as told; sequences gapless and not too long. Returns their number."""
    e = encoder(default_tokenizer())
    left = sorted(((k, np.append(np.frombuffer(e.whole(t or ""), "<u4"), end).astype("<u4")) for k, t in texts), key=lambda x: (str(x[0]), len(x[1]), x[1].tobytes()))
    want = []
    for k, ids in left:
        first = len(ids) % length or length
        cuts = [(0, first), *((a, length) for a in range(first, len(ids), length))]
        want += [(k, i, a, n, zlib.crc32(ids[a : a + n].tobytes())) for i, (a, n) in enumerate(cuts)]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows))) == sorted(map(str, want))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_odd_rows(spark, odd_docs, odd_rows):
    rows = packing.pack(spark, odd_docs).collect()
    total = sum(r.length for r in rows)
    assert _check(rows, odd_rows) <= -(-total // 1024) + 1


def test_small_sequences_and_rounds(spark):
    """Hot sizes, many pieces a sequence, and several rounds."""
    rng = np.random.default_rng(0)
    texts = [(i, " ".join(["word"] * int(n))) for i, n in enumerate([*rng.integers(1, 90, 400), *[20] * 300, *[1] * 200])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    rows = packing.pack(spark, docs, length=64).collect()
    n = _check(rows, texts, 64)
    assert n <= 1.02 * sum(r.length for r in rows) / 64 + 1


@pytest.mark.parametrize("sizes", [[5] * 700, [513] * 30 + [511] * 30, [300] * 40 + [200] * 40 + [10] * 300, [1] * 1500, [1023] * 10 + [1] * 10])
def test_place_comes_near_the_bound(spark, sizes, tmp_path):
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(4)
    seqs = {r.id: r.seq for r in packing.place(items, f"file://{tmp_path}/p", 1024).collect()}
    fill = {}
    for i, s in enumerate(sizes):
        fill[seqs[i]] = fill.get(seqs[i], 0) + s
    greedy = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, f in enumerate(greedy) if f + s <= 1024), None)
        if k is None:
            greedy.append(s)
        else:
            greedy[k] += s
    assert max(fill.values()) <= 1024 and len(fill) <= len(greedy) + 1


def test_carry_pairs_ranks():
    taken = packing.carry({0: (2, 0), 1: (1, 1), 2: (0, 3)})
    assert taken == {1: [(0, 1, 0, 1)], 2: [(0, 1, 1, 0), (1, 1, 0, 0)]}


def test_empty_table(spark, no_docs):
    assert packing.pack(spark, no_docs).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_sweeps_place_everything(spark, monkeypatch):
    """Whatever doesn't open a sequence of its own gets its place in a sweep; the number of sequences is near its bound."""
    sweeps, sweep = [], packing._sweep

    def counted(*args):
        sweeps.append(out := sweep(*args))
        return out

    monkeypatch.setattr(packing, "_sweep", counted)
    rows = packing.pack(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len(sweeps) > 1
    placed = sum(x.where("seq is not null").count() for x in sweeps)
    assert placed == sum(r.length <= 512 for r in rows) > 0
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 1024) + 2


def test_first_round_has_gaps(spark, monkeypatch, tmp_path):
    """Without any large piece, empty sequences are there before the first sweep, so that it places pieces."""
    sweeps, sweep = [], packing._sweep

    def counted(*args):
        sweeps.append(sweep(*args))
        return sweeps[-1]

    monkeypatch.setattr(packing, "_sweep", counted)
    items = spark.createDataFrame([(i, 5) for i in range(3000)], "id long, size long").repartition(4)
    assert packing.place(items, f"file://{tmp_path}/p").count() == 3000
    assert all(not x.where("seq is not null").isEmpty() for x in sweeps)
