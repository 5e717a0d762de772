import os
import random
import tracemalloc

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidegraph.llm import near_copies, work
from tidegraph.llm.simhash import fingerprint, shingle_hashes


def _similarity(a, b):
    x, y = (set(shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def _bits(a, b):
    x, y = (fingerprint(shingle_hashes(t, 5)) for t in (a, b))
    return ((x ^ y) & (1 << 64) - 1).bit_count()


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in near_copies.without_near_copies(spark, docs).collect()}


def _words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_links_are_exact(spark):
    """Pairs of similarity 0.75 stay and pairs of 0.802 don't, whatever their signatures say."""
    rng = random.Random(8)
    texts = []
    while len(texts) < 120:
        base = _words(rng, 204)
        edited = 28 if len(texts) < 80 else 22
        pair = [" ".join(base), " ".join(base[:-edited] + _words(rng, edited))]
        if _bits(*pair) > 3:  # a fingerprint's link is a link of its own
            texts += pair
    assert {k for k in range(60) if _similarity(texts[2 * k], texts[2 * k + 1]) >= 0.8} == set(range(40, 60))
    assert _kept(spark, texts) == {i for i in range(120) if i % 2 == 0 or i < 80}


def test_similarity_of_sets():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.similar(a[:8], a[:10]) and near_copies.similar(a[:4], np.arange(5, dtype=np.uint64))
    assert not near_copies.similar(a[:7], a) and near_copies.similar(a[:0], a[:0]) and not near_copies.similar(a[:0], a)


def test_copies_among_many_with_a_shared_passage(spark, monkeypatch):
    """Texts of one passage, all unlike each other, don't hide the two that are copies; nor do blocks."""
    rng = random.Random(9)
    passage = _words(rng, 164)
    texts = [" ".join(passage + _words(rng, n)) for n in [80] * 200 + [18, 18]]
    assert _similarity(texts[200], texts[201]) >= 0.8 and max(_similarity(texts[k], x) for k in range(200) for x in texts[k + 1 :]) < 0.7
    assert _kept(spark, texts) == set(range(201))
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    assert _kept(spark, texts) == set(range(201))


def test_linked_texts_still_link_others(spark):
    """Copies c1 and c2 of o are unlike each other; o meets c1 first and must link c2 too."""
    rng = random.Random(10)
    first, second, whole = [], [], []
    for _ in range(20):
        o = _words(rng, 204)
        first.append(" ".join(o[:-16] + _words(rng, 16)))
        second.append(" ".join(_words(rng, 16) + o[16:]))
        whole.append(" ".join(o))
        assert _similarity(first[-1], whole[-1]) >= 0.8 and _similarity(second[-1], whole[-1]) >= 0.8 and _similarity(first[-1], second[-1]) < 0.75
    assert _kept(spark, first + second + whole) == set(range(20))


def _brute(texts):
    """The least row of each component of all pairs of similarity 0.8 or more."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    holders, label = {}, list(range(len(texts)))
    for k, x in enumerate(sets):
        for h in x or {None}:
            holders.setdefault(h, []).append(k)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, x in enumerate(sets):
        shared = {}
        for h in x or {None}:
            for other in holders[h]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if not x and not sets[other] or x and n * 5 >= 4 * (len(x) + len(sets[other]) - n):
                a, b = sorted((root(k), root(other)))
                label[b] = a
    return {k for k in range(len(texts)) if root(k) == k}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_against_brute_force_over_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {rows[k][0] for k in _brute([t for _, t in rows])}
    assert {r.doc_id for r in near_copies.without_near_copies(spark, docs).collect()} == want and len(want) < len(rows)


def test_a_large_group_with_members_of_all_distances(spark, monkeypatch):
    """Copies with few and with many edits, which links connect in chains or not at all, in blocks and without."""
    rng = random.Random(11)
    base = _words(rng, 150)
    texts = []
    for k in range(250):
        words = list(base)
        for at in rng.sample(range(150), k % 9):
            words[at] = _words(rng, 1)[0]
        texts.append(" ".join(words))
    texts += ["", "", "a b", "a b", "a c"]
    want = _brute(texts)
    assert 5 < len(want) < 240
    assert _kept(spark, texts) == want
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    monkeypatch.setattr(near_copies, "ROUNDS", 1)
    assert _kept(spark, texts) == want


def test_rows_are_told_apart_whatever_the_plan(spark, tmp_path):
    """Tables, filtered tables, unions, joins, repeated rows and frames without files: each row has a place of its own."""
    spark.createDataFrame([(k, f"text {k} a b c d e") for k in range(30)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    plans = {
        "table": (table, 30, True),
        "filtered": (table.where("doc_id > 9").withColumn("more", F.lit(1)), 20, True),
        "union": (table.unionByName(table), 60, False),
        "exploded": (table.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), 60, False),
        "joined": (table.join(table.select("doc_id"), "doc_id"), 30, False),
        "memory": (spark.createDataFrame([(1, "x")] * 5, "doc_id long, text string"), 5, False),
    }
    for name, (frame, n, by_file) in plans.items():
        rows, place = work.placed(frame, f"file://{tmp_path}/{name}")
        assert rows.select(*place).distinct().count() == rows.count() == n, name
        assert (rows.where(F.col(place[0]) != 0).count() > 0) == by_file, name
        assert near_copies.without_near_copies(spark, frame).columns == frame.columns


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """With more rows than FEW only tables of texts' sets, whose files aren't smaller than they are, may be broadcast."""
    plans, write = {}, work.written

    def noted(df, path):
        plans.setdefault(os.path.basename(path), df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(work, "written", noted)
    monkeypatch.setattr("tidegraph.storage.FEW", 5)
    rng = random.Random(13)
    bases = [_words(rng, 200) for _ in range(12)]
    texts = [" ".join(b[:-k] + _words(rng, k)) for b in bases for k in range(1, 9)]
    assert len(_kept(spark, texts)) == len(bases)
    names = {"prints", "groups", "wanted", "hubs0", "pairs0", "labelled"}
    assert names <= set(plans) and any("SortMergeJoin" in plans[k] for k in names)
    assert not [k for k in names if "BroadcastHashJoin" in plans[k] or "BroadcastNestedLoopJoin" in plans[k]]


def test_signature_memory_is_bounded():
    """A long text's signature takes little more than its hashes, and is what all of them at once give."""
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    tracemalloc.start()
    got = near_copies.signature(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    least = (((hashes[:, None] * near_copies._FACTORS + near_copies._SHIFTS) >> np.uint64(32)).min(axis=0)) & np.uint64(0xFFFF)
    assert got == least.astype("<u2").tobytes()


def test_short_read_batches(spark):
    """Texts are read in short batches; a session's own bound stays."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        work.prepare(spark)
        assert spark.conf.get(key) == "512"
        spark.conf.set(key, "77")
        work.prepare(spark)
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
