import os
import random

import pytest

import corpus_pipeline
from tidegraph.llm import decontam, queries, secrets, toxicity
from tidegraph.llm.simhash import shingle_hashes
from tidegraph.llm.tokens import default_tokenizer, encoder


def _tables(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(6)
    base = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(2500)]
    clean = [" ".join(rng.choices(base, k=rng.randint(30, 200))) for _ in range(150)]
    bench = [(i, " ".join(rng.choices(base, k=40))) for i in range(5)]
    docs, fate = [], []

    def add(text, kept):
        docs.append((len(docs), text, "en", "s", len(text)))
        fate.append(kept)

    for t in clean:
        add(t, True)
    for t in clean[:20]:
        add(t, False)  # exact copies
    for t in clean[20:40]:
        words = t.split()
        words[-1] = "changed"
        add(" ".join(words), False)  # near copies
    for k in range(10):
        add(" ".join(rng.choices(base, k=50)) + " " + bench[k % 5][1] + " " + " ".join(rng.choices(base, k=20)), False)
    for _ in range(60):
        words = rng.choices(base, k=40)
        for _ in range(3):
            words.insert(rng.randrange(40), rng.choice(["idiot", "moron", "stupid", "worthless"]))
        add(" ".join(words), False)
    secret = 'key token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here ' + " ".join(rng.choices(base, k=30))
    add(secret, True)
    toxic = range(len(docs) - 61, len(docs) - 1)
    labels = [(i, 1, int(i in toxic)) for i in range(len(docs)) if i % 3]
    _tables(spark, str(tmp_path), docs, labels, bench)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        table = spark.read.parquet(f"{tmp_path}/out{k}")
    kept = {r.doc_id: r for r in table.collect()}
    assert set(kept) == {i for i, k in enumerate(fate) if k}
    assert kept[len(docs) - 1].text == secrets.redacted(secret) and kept[len(docs) - 1].n_chars == len(secrets.redacted(secret))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept)
    e = encoder(default_tokenizer())
    assert sum(r.length for r in rows) == sum(len(e.whole(r.text)) // 4 + 1 for r in kept.values())


def test_run_against_brute_force(spark, tmp_path):
    """Every stage worked out one document at a time; only the toxic ones are taken from the model's own prediction."""
    rng = random.Random(12)
    base = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(900)]
    bench = [(i, " ".join(rng.choices(base, k=30))) for i in range(6)]
    texts = [" ".join(rng.choices(base, k=rng.randint(0, 160))) for _ in range(90)]
    for k in range(60):
        words = texts[k % 30].split()
        for _ in range(k % 7):
            if words:
                words[rng.randrange(len(words))] = rng.choice(base)
        texts.append(" ".join(words))
    for k in range(24):
        item = bench[k % 6][1].split()
        for at in rng.sample(range(30), k % 16):
            item[at] = rng.choice(base)
        texts.append(" ".join([*rng.choices(base, k=20), *item, *rng.choices(base, k=9)]))
    texts += [f"{rng.choice(base)} password = {rng.getrandbits(90):x} {' '.join(rng.choices(base, k=20))}" for _ in range(6)]
    texts += [" ".join([*rng.choices(base, k=12), "idiot", "moron", "stupid", *rng.choices(base, k=12)]) for _ in range(40)]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(None, None, "en", "s", 0)]
    labels = [(k, 1, int(k >= len(texts) - 40)) for k in range(0, len(texts), 2)]
    _tables(spark, str(tmp_path), docs, labels, bench)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(spark, table, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted}
    assert len(toxic) > 20
    left = [(k, t or "") for k, t, *_ in docs if k not in toxic]
    sets = [set(shingle_hashes(t, 5).tolist()) for _, t in left]
    label = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 5 >= 4 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    groups = {}
    for row, x in zip(left, label, strict=True):
        groups.setdefault(x, []).append(row)
    left = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    assert len(left) < len(sets)

    def share(item, text):
        a, b = decontam.words_of(item), decontam.words_of(text)
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
            best, row = max(best, *new), new
        return best / (2 * len(a))

    clean = [(k, secrets.redacted(t)) for k, t in left if max(share(i, t) for _, i in bench) < decontam.SCORE]
    assert len(clean) < len(left) and any("[assign]" in t for _, t in clean)
    e = encoder(default_tokenizer())
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {k: len(e.whole(t)) // 4 + 1 for k, t in clean}
    full = {}
    for r in rows:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert max(full.values()) <= 1024


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, odd_rows):
    for name, rows in (("odd", odd_rows), ("none", [])):
        _tables(spark, f"{tmp_path}/{name}", [(k, t, None, None, None) for k, t in rows], [], [])
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns[:2] == ["doc_id", "piece"] and (out.count() > 0) == bool(rows)


def test_every_query_has_a_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_whole_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    table = "pages" if name in ("op2_html", "op3_warc") else "documents"
    rows = queries.QUERIES[name](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    if name == "op9_decontamination":
        assert {r.doc_id for r in rows} and all(r.score >= 0.42 for r in rows)
    elif name == "op10_packing":
        assert len({r.doc_id for r in rows}) == n
    else:
        assert len(rows) == n + (spark.read.parquet(f"{sf}/pages.parquet").count() if name == "op7_language" else 0)
