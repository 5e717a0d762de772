import itertools

import numpy as np
import pytest
import xxhash

from tidegraph.llm import near_copies, simhash, work
from tidegraph.operators import stars


def _fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    ids = list(range(len(fps)))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = ids[a], ids[b]
            ids = [min(x, y) if i in (x, y) else i for i in ids]
    return ids


def test_fingerprints(odd_rows):
    for text in [t for _, t in odd_rows] + ["One two", "ONE two three", "Ä B C"]:
        assert simhash.fingerprint(simhash.shingle_hashes(text or "", 3)) % (1 << 64) == _fingerprint(text)


def test_odd_rows(spark, odd_docs, odd_rows):
    got = simhash.simhash_groups(spark, odd_docs).collect()
    fps = [_fingerprint(t) for _, t in odd_rows]
    label = _components(fps)
    want = []
    for i, (key, _) in enumerate(odd_rows):
        group = [odd_rows[j][0] for j in range(len(fps)) if label[j] == label[i] and odd_rows[j][0] is not None]
        want.append((key, f"{fps[i]:016x}", min(group, default=None)))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_links_against_brute_force(spark, tmp_path, bucket):
    """Planted balls, chains and a dense cluster; bucket 1 sends nearly all by shared keys."""
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for base in fps[:12]:
        for n in (1, 2, 3, 4):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    cluster = int(rng.integers(0, 1 << 63))
    fps += [cluster ^ sum(1 << int(b) for b in rng.choice(8, n, replace=False)) for n in (0, 1, 2, 3) for _ in range(12)]
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    members = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in simhash.components(members, f"file://{tmp_path}/w{bucket}", bucket).collect()}
    want = _components(fps)
    assert got == {f: want[i] for i, f in enumerate(fps)}


def test_empty_table(spark, no_docs):
    assert simhash.simhash_groups(spark, no_docs).count() == 0
    assert near_copies.without_near_copies(spark, no_docs).count() == 0


def _similarity(a, b):
    x, y = (set(simhash.shingle_hashes(t or "", 5).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_near_copies_keep_one_of_each_group(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    rows, truth = [], []
    for g in range(25):
        base = list(rng.choice(words, 150))
        for c in range(6):
            text = list(base)
            for p in rng.choice(150, c, replace=False):
                text[p] = f"edit{g}x{c}x{p}"
            rows.append((len(rows), " ".join(text)))
            truth.append(g)
    rows += [(len(rows) + i, " ".join(rng.choice(words, 120))) for i in range(60)]
    got = {r.doc_id for r in near_copies.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i for i, _ in rows[150:]} <= got
    for g in range(25):
        kept = [i for i in got if i < 150 and truth[i] == g]
        assert 6 * g in kept
        assert all(_similarity(rows[a][1], rows[b][1]) < 0.83 for a, b in itertools.combinations(kept, 2))


def test_near_copies_of_odd_rows(spark, odd_docs, odd_rows, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/docs")
    for docs in (odd_docs, spark.read.parquet(f"{tmp_path}/docs")):
        out = near_copies.without_near_copies(spark, docs)
        assert out.columns == docs.columns
        texts = [r.text or "" for r in out.collect()]
        assert len(texts) == len(set(texts))
        assert {" ".join(t.split()) for t in texts} >= {" ".join((t or "").split()) for _, t in odd_rows} - {""}


def test_tables_that_grow_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Written files look small to Spark; with more rows than FEW no table of the search or of the stars is broadcast."""
    plans, write = [], stars.written

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(work, "written", noted)
    monkeypatch.setattr(stars, "written", noted)
    monkeypatch.setattr("tidegraph.storage.FEW", 100)
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 62), 1 << 62, 300)
    members = spark.createDataFrame([(4 * i + k, int(x) ^ k) for i, x in enumerate(base) for k in range(4)], "doc_id long, fp long")
    members = write(members, f"{tmp_path}/members")
    for bucket in (simhash.BUCKET, 1):
        noted(simhash.components(members, f"{tmp_path}/{bucket}", bucket), f"{tmp_path}/{bucket}/out")
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
