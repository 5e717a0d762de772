import random

import numpy as np

from tidegraph.llm import decontam


def _score(item, text):
    """Plain Smith-Waterman, one cell at a time: share of the item's own score."""
    a, b = decontam.words_of(item), decontam.words_of(text)
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best / (2 * len(a))


def _words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_alignment_against_brute_force():
    rng = random.Random(1)
    items = [rng.choices(range(9), k=rng.randint(3, 12)) for _ in range(40)]
    texts = [rng.choices(range(-1, 9), k=rng.randint(1, 30)) for _ in range(40)]
    got, ends = decontam.align([np.array(x) for x in items], [np.array(x) for x in texts])
    for item, text, g, end in zip(items, texts, got, ends, strict=True):
        want = _score(" ".join(f"w{x}" for x in item), " ".join(f"w{x}" if x >= 0 else f"u{k}" for k, x in enumerate(text)))
        assert abs(g / (2 * len(item)) - want) < 1e-9 and 0 <= end < len(text)


def test_copies_are_found_and_nothing_else(spark):
    rng = random.Random(2)
    common = _words(rng, 30)
    items = [(i, " ".join(_words(rng, 40))) for i in range(20)] + [(20, "too short"), (21, None), (None, " ".join(_words(rng, 30)))]
    docs = []
    for d in range(400):
        words = [rng.choice(common) if rng.random() < 0.5 else w for w in _words(rng, rng.randint(20, 300))]
        if d % 4 == 0:
            words[10:10] = items[0][1].split()  # an item that a quarter of all documents hold
        if d % 10 == 1:
            item = items[d % 20][1].split()
            for k in rng.sample(range(40), 8):
                item[k] = _words(rng, 1)[0]  # a fifth of the words edited
            del item[rng.randrange(40)]
            words[5:5] = item
        docs.append((d, " ".join(words)))
    docs += [(None, "x " + items[3][1].upper().replace(" ", ",  ") + " y"), (401, None), (402, ""), (402, "")]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in docs], "doc_id long, text string, k string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark, frame, bench).collect()}
    want = {(d, i) for d, t in docs for i, x in items if t and x and len(decontam.words_of(x)) >= 3 and _score(x, t) >= decontam.SCORE}
    assert got == want and len(want) > 130
    kept = decontam.without_leaks(spark, frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in {x for x, _ in want} )


def test_any_stretch_of_a_common_item_is_found(spark):
    """An item that most documents hold whole, and documents with only its first, middle or last words."""
    rng = random.Random(5)
    item = _words(rng, 54)
    parts = [item[:36], item[9:45], item[18:], item[28:]]
    docs = [(d, " ".join(_words(rng, 20) + item + _words(rng, 20))) for d in range(60)]
    docs += [(60 + d, " ".join(_words(rng, 30) + parts[d % 4] + _words(rng, 30))) for d in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id for r in decontam.leaks(spark, frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {d for d, t in docs if _score(" ".join(item), t) >= decontam.SCORE} and len(got) == 80


def test_ways_to_join_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(_words(rng, 12))) for i in range(9)]
    docs = spark.createDataFrame([(i, "a b " + items[i % 9][1] + " c") for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(decontam.leaks(spark, docs, bench).collect())
    monkeypatch.setattr(decontam, "FEW_WINDOWS", 0)
    monkeypatch.setattr(decontam, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(decontam, "CELLS", 100)
    assert sorted(decontam.leaks(spark, docs, bench).collect()) == once and len(once) == 30


def test_repeated_lines_and_long_texts(spark):
    """A text that repeats a line of seeds over and over opens many short windows, none of which grows with the text."""
    rng = random.Random(6)
    item = _words(rng, 40)
    line = item[:4] + _words(rng, 2) + item[10:14]
    docs = [(1, " ".join(line * 4000)), (2, " ".join(_words(rng, 30_000) + item + _words(rng, 30_000))), (3, " ".join(item * 500))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in decontam.leaks(spark, frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert set(rows) == {2, 3} and rows[2].score == rows[3].score == 1.0 and rows[2].ends_at_word == 30_039


def test_hashes(spark):
    """Chunks don't change a text's words, and the filter's hash is the one that Spark has."""
    rng = random.Random(7)
    text = "İstanbul ß " + " ".join(_words(rng, 3000)) + "x" * 500
    whole = decontam.word_hashes(text)
    assert len(whole) == len(decontam.words_of(text))
    try:
        decontam.CHUNK = 100
        assert (decontam.word_hashes(text) == whole).all()
    finally:
        decontam.CHUNK = 1 << 20
    x = np.array([0, 1, -1, 1 << 62, -(1 << 63), 123456789], np.int64)
    want = [r.h for r in spark.createDataFrame([(int(v),) for v in x], "x long").selectExpr("xxhash64(x) AS h").collect()]
    assert decontam.xxh64_longs(x).tolist() == want


def test_many_items_take_as_few_scans(spark, monkeypatch):
    """Items are not taken in turns: the documents are looked at once, and cut once."""
    calls = []
    looker = decontam._looker
    monkeypatch.setattr(decontam, "_looker", lambda *a: calls.append(1) or looker(*a))
    rng = random.Random(8)
    items = [(i, " ".join(_words(rng, 8))) for i in range(20_000)]
    docs = spark.createDataFrame([(i, "a b " + items[i * 71][1] + " c") for i in range(200)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark, docs, spark.createDataFrame(items, "item_id long, text string").repartition(4)).collect()}
    assert got >= {(i, i * 71) for i in range(200)} and len(calls) == 1


def test_empty_tables(spark, no_docs, odd_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert decontam.leaks(spark, no_docs, one).count() == 0 and decontam.without_leaks(spark, no_docs, one).count() == 0
    assert decontam.leaks(spark, odd_docs, none).count() == 0 and decontam.without_leaks(spark, odd_docs, none).count() == len(odd_rows)
