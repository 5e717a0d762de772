import random
import zlib

import numpy as np

from tidegraph.llm import language, toxicity, trees, work


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = trees.boost(x[:2000], y[:2000])
    p = trees.isotonic(model.margin(x[:2000]), y[:2000])(model.margin(x[2000:]))
    assert ((p > 0.5) == y[2000:]).mean() > 0.95 and 0 < p.min() and p.max() < 1
    rising = trees.isotonic(np.array([3.0, 1, 2, 2, 5]), np.array([1.0, 0, 1, 0, 1]))
    assert (np.diff(rising(np.linspace(0, 6, 50))) >= 0).all()


def test_one_split_against_brute_force():
    """A tree of depth 1 takes the cut of the greatest gain, and its leaves are Newton steps."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (80, 3)).astype(float)
    y = (x[:, 1] + rng.normal(size=80) > 3).astype(float)
    model = trees.boost(x, y, trees=1, depth=1, rate=0.2, ridge=1.0, least=1.0)
    p = y.mean()
    best = None
    for f in range(3):
        for cut in sorted(set(x[:, f]))[:-1]:
            parts = [x[:, f] <= cut, x[:, f] > cut]
            if min(q.sum() * p * (1 - p) for q in parts) < 1:
                continue
            gain = sum(((p - y)[q].sum()) ** 2 / (q.sum() * p * (1 - p) + 1) for q in parts)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, cut, [-0.2 * (p - y)[q].sum() / (q.sum() * p * (1 - p) + 1) for q in parts])
    assert (model.feature[0, 0], model.cut[0, 0]) == best[1:3]
    assert np.allclose(model.leaf[0], best[3])
    assert np.allclose(model.margin(x), np.log(p / (1 - p)) + np.where(x[:, best[1]] <= best[2], *best[3]))


def test_features_against_brute_force():
    lexicon = {"idiot": 2.0, "grav*": 1.5, "gravo*": 3.0, "trash": 1.0}
    rng = random.Random(4)
    for _ in range(50):
        words = rng.choices(["you", "Your", "idiot", "gravona", "gravy", "trash", "plain", "WORD", "the", "fine"], k=rng.randint(1, 40))
        text = " ".join(words)
        f = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity._Weights(lexicon)), strict=True))
        low = [w.lower() for w in words]
        weight = [max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k] + "*", 0.0) for k in (4, 5, 6, 7, 8) if len(w) > k]) for w in low]
        hits, you = [i for i, w in enumerate(weight) if w], [i for i, w in enumerate(low) if w in ("you", "your")]
        gaps = [min(abs(i - j) for j in you) for i in hits] if you else []
        want = {"hits": len(hits), "weight": sum(weight), "strongest": max(weight), "distinct": len({low[i] for i in hits}), "aimed": sum(g <= 5 for g in gaps), "nearest": 1 / (1 + min(gaps)) if gaps else 0.0, "insults": sum(low[i] in ("idiot", "trash") for i in hits)}
        assert all(abs(f[k] - v) < 1e-9 for k, v in want.items())


def test_conflicting_labels_and_repeated_rows(spark):
    """An id that is labelled both ways counts as toxic, whatever the rows' order."""
    docs, labels = _corpus(300)
    frame = spark.createDataFrame(docs + docs[:40], "doc_id long, text string")
    both = labels + [(i, 0, 0) for i, _, t in labels if t]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(spark, frame.repartition(n), spark.createDataFrame(x, "doc_id long, quality int, toxic int").repartition(n)).collect()) for n, x in ((2, labels), (5, both)))
    assert a == b


def _corpus(n, seed=1):
    rng = random.Random(seed)
    base = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(base, k=rng.randint(5, 120))
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), "gravok" + rng.choice(["", "a", "ist", "um", "enta"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, odd_rows):
    docs, labels = _corpus(1200)
    odd = [(10_000 + (k or 0), t) if k is not None else (None, t) for k, t in odd_rows]
    frame = spark.createDataFrame([(*d, "clash", "clash") for d in docs + odd], "doc_id long, text string, score string, toxic string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(spark, frame, known).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    out = [r for r in rows if r.held_out and r.doc_id < 1200]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in out]) > 0.97
    kept = toxicity.without_toxic(spark, frame, known)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}


def test_held_out_labels_are_not_read(spark):
    docs, labels = _corpus(300)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    turned = [(i, q, 1 - t if i in out else t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(spark, frame, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels_or_rows(spark, odd_docs, odd_rows, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(spark, odd_docs, none).collect()} == {0.0}
    assert toxicity.without_toxic(spark, odd_docs, none).count() == len(odd_rows)
    assert toxicity.score(spark, no_docs, none).count() == 0


def test_features_of_awkward_texts():
    weights = toxicity._Weights({"idiot": 2.0})
    for text in ("", " ", "!!!", "A" * 5000, "y0u 1d10t!!!", "i d i o t you", "İıß"):
        assert len(toxicity.features(text, weights)) == len(toxicity.FEATURES)
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an 1d10t!!", weights), strict=True))
    assert f["uncovered"] == 1 and f["marks"] > 0


LANGS = {"en": "the of and that this with have from they which", "de": "der und die das nicht mit sich auf für eine", "fr": "le la les des une dans pour que qui avec"}


def _language_rows(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(6, 40))), lang, f"s{i % 3}") for i, lang in ((i, list(LANGS)[i % 3]) for i in range(n))]


def test_language(spark, odd_rows):
    rows = _language_rows(300)
    pad = [(*r, None, "odd") for r in odd_rows]
    docs = spark.createDataFrame([(*r, "clash") for r in rows] + [(k, t, None, "odd", "clash") for k, t, *_ in pad], "doc_id long, text string, lang string, source string, host string").repartition(3)
    rng = random.Random(9)
    pages = [(i, f"http://h{i % 2}.example.{'de' if i % 2 else 'org'}/{i}", f'<html lang="{"de" if i % 2 else "en"}"><body><article><p>{" ".join(rng.choices(LANGS["de" if i % 2 else "en"].split(), k=30))}</p></article></body></html>') for i in range(60)]
    pages += [(100, "http://h1.example.de/x", "<html><body><p>7</p></body></html>"), (101, "http://h0.example.org/x", '<html lang="en"></html>'), (102, None, None), (None, "odd", "")]
    got = language.identify(spark, docs, spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == docs.count() + len(pages)
    truth = {i: lang for i, _, lang, _ in rows}
    found = {r.doc_id: r.lang for r in got if r.kind == "document" and r.doc_id in truth and r.doc_id > 20}
    assert np.mean([found[i] == truth[i] for i in found]) > 0.98
    by = {r.page_id: r for r in got if r.kind == "page"}
    assert all(by[i].lang == ("de" if i % 2 else "en") for i in range(60))
    assert by[100].lang == "de" and by[100].text_lang != "fr" and by[101].lang == "en"  # the host and the markup decide
    assert all(r.lang in LANGS and 0 < r.probability <= 1 for r in got)


def test_language_of_empty_tables(spark, no_docs):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identify(spark, no_docs, pages).count() == 0
    one = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    row = language.identify(spark, no_docs, one).first()
    assert row.page_id == 1 and row.lang is None


def test_fusion_against_brute_force(spark, tmp_path, monkeypatch):
    """The posterior of every row, worked out one row at a time."""
    rng = np.random.default_rng(2)
    languages = ["de", "en", "fr"]
    rows = []
    for k in range(120):
        host = rng.choice(["a", "a", "a", "b", "c"])  # a hot host
        rows.append((k, str(rng.choice(["-", "de", "xx"])), {"a": "de", "b": "org", "c": "org"}[host], str(host), rng.normal(0, 3, 3).tolist()))
    rows[5] = (5, "-", "org", "b", [0.0, 0.0, 0.0])
    p = {k: np.exp(np.array(ll) - max(ll)) / np.exp(np.array(ll) - max(ll)).sum() for k, *_, ll in rows}
    found = spark.createDataFrame([(k, False, False, *r, p[k].tolist()) for k, *r in rows], language.FOUND).repartition(3)
    got = {r.k: r.posterior for r in language.fuse(found, languages, f"file://{tmp_path}/a").collect()}
    monkeypatch.setattr(work, "SMALL", 0)  # joined by sorting
    assert got == {r.k: r.posterior for r in language.fuse(found, languages, f"file://{tmp_path}/b").collect()}
    total = sum(p.values())
    for k, declared, suffix, host, ll in rows:
        hosts = sum(p[r[0]] for r in rows if (r[3], r[2]) == (host, suffix))
        suffixes = sum(p[r[0]] for r in rows if r[2] == suffix)
        said = sum(p[r[0]] for r in rows if r[1] == declared)
        overall = (total + 1) / (total.sum() + 3)
        suffix_prior = (suffixes + language.SUFFIX_SMOOTHING * overall) / (suffixes.sum() + language.SUFFIX_SMOOTHING)
        others = np.maximum(hosts - p[k], 0)
        host_prior = (others + language.HOST_SMOOTHING * suffix_prior) / (others.sum() + language.HOST_SMOOTHING)
        declares = (said + language.DECLARED_SMOOTHING * said.sum() / total.sum()) / (total + language.DECLARED_SMOOTHING)
        want = np.exp(ll) * host_prior * declares
        assert np.allclose(got[k], want / want.sum(), atol=1e-5)


def test_likelihood_against_brute_force():
    """Mean log-likelihood of a text's trigrams, counted one by one, times the evidence of its length."""
    counts = np.zeros((2, language.BUCKETS))
    for k, text in enumerate(("the cat sat on the mat", "der hund lag auf der matte")):
        for t in language.trigrams(text):
            counts[k, t] += 1
    model = language.TextModel(["en", "de"], counts)
    for text in ("the hat", "der hut", "a", "", "the cat " * 40):
        t = language.trigrams(text)
        want = [np.mean([np.log((counts[k, x] + 0.1) / (counts[k].sum() + 0.1 * language.BUCKETS)) for x in t]) * min(len(t), language.EVIDENCE_CHARS) if text else 0.0 for k in range(2)]
        assert np.allclose(model.likelihood(text), want, atol=1e-3)
