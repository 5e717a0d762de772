"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Labels are learned from rows of the training fold only, from about SAMPLE of them (those with a low hash of their id:
a documented bound on what reaches the driver). Two steps:

1. A lexicon: words and word beginnings (4 to 8 letters, as many languages inflect) that occur in toxic texts far more
   often than in others, by a likelihood-ratio test that chance among so many entries doesn't pass. Copies of a text
   would make all its words look telling, so of texts that share their least shingle hash one is counted; in a text a
   beginning counts once for each different word that has it, up to MOST, so that rare inflections speak for their stem.
   Counts are summed in Spark. A fixed list of common insults joins it.
2. Features of each whole text: lexicon densities, proximity of second-person words, capitals, punctuation and
   obfuscation rates. Everything is fitted across folds: a training text is measured with the lexicon of the other folds,
   and its margin comes from trees of the other folds, which calibrates the trees of all.

Neither labels nor lang, source or doc_id are inputs of a score. A score is the calibrated probability, with a small
share of the uncalibrated one so that equal calibrated values keep the order of their margins.

Defined results: a null text is empty and is scored like any other; a null doc_id is not held out; repeated doc_ids are
kept (of labelled ones the least text is the training row); of conflicting labels of an id the toxic one counts; without training labels every score is 0; an empty table
gives no rows; other columns are ignored by score and kept by without_toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .simhash import shingle_hashes
from .trees import Boosted, Isotonic, boost, isotonic

SAMPLE = 20_000
LEXICON = 400
THRESHOLD = 0.3
#: Words whose weight a worker keeps: bounds its memory.
KEPT = 100_000
#: Entries counted in a worker before their counts go out: bounds its memory beside one text.
COUNTED = 100_000
FOLDS, HELD_OUT = 4, 2
#: Parts of the training rows that are fitted across, and the most that one text adds to a lexicon entry's count.
PARTS, MOST = 4, 3
#: A lexicon entry's share of toxic texts over its share of others, and its likelihood ratio, at least.
RATIO, EVIDENCE = 8.0, 22.0
ORDER_SHARE = 0.02
PREFIXES = (4, 5, 6, 7, 8)
WORD = re.compile(r"[^\W_]+")
# Common insults, and second-person words, of the corpus' languages.
INSULTS = set("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown dumb imbecile fool filth vermin idiota estúpido estúpida imbécil basura asqueroso idiote stupide imbécile crétin connard ordure dumm dummkopf abschaum trottel vollidiot arschloch".split())
SECOND_PERSON = set("you your yours yourself u ur thou du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros os su".split())
#: Letters that stand for others in disguised words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")
DISGUISED = re.compile(r"(?<![\w@$!*])(?=[\w@$!*]*[^\W\d_])(?=[\w@$!*]*[0134578@$!*])[\w@$!*]{2,23}\w(?![\w@$*])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?!\w)")
MARKS = re.compile(r"[!?]{2,}")


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if len(word) > k]


class _Weights(dict):
    """Word to the weight of its best lexicon entry, kept."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        get = self.lexicon.get
        weight = max(get(word, 0.0), *(get(b, 0.0) for b in beginnings(word)), 0.0)
        if len(self) > KEPT:
            self.clear()
        self[word] = weight
        return weight


FEATURES = ["words", "hits", "density", "weight", "strongest", "distinct", "insults", "insult_density", "you", "nearest", "aimed", "capitals", "shouted", "marks", "exclaims", "questions", "punctuation", "disguised", "uncovered", "stretched", "spaced", "digits", "mean_word"]


def features(text: str, weights: _Weights) -> list[float]:
    """The dense features of a whole text, in the order of FEATURES."""
    n = len(text)
    plain = WORD.findall(text)
    words = [w.lower() for w in plain]
    m = len(words)
    per = 1000 / max(m, 20)
    found = np.fromiter(map(weights.__getitem__, words), float, m)
    at = np.flatnonzero(found)
    hits = [words[i] for i in at]
    insults = sum(w in INSULTS for w in hits)
    you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON]) if m else np.zeros(0)
    nearest, aimed = 0.0, 0
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(k, len(you) - 1)]), np.abs(at - you[np.maximum(k - 1, 0)]))
        nearest, aimed = 1 / (1 + float(gap.min())), int((gap <= 5).sum())
    odd = DISGUISED.findall(text) if re.search(r"[0-9@$!*]", text) else []
    uncovered = sum(1 for w in odd if not w.isdigit() and weights[re.sub(r"[^\w]", "", w.lower().translate(DISGUISES))] > 0 and weights[w.lower()] == 0)
    upper = sum(map(str.isupper, plain))
    letters = max(1, n - text.count(" "))
    capitals = sum(len(w) for w in plain if w.isupper() and len(w) > 1) / letters
    return [
        np.log1p(m), float(len(at)), len(at) * per, float(found.sum()), float(found.max()) if m else 0.0, float(len(set(hits))), float(insults), insults * per,
        len(you) * per, nearest, float(aimed), capitals, upper / max(m, 1), len(MARKS.findall(text)) * per, text.count("!") * per, text.count("?") * per,
        sum(map(text.count, ",.;:")) / letters, len(odd) * per, float(uncovered), len(STRETCHED.findall(text)) * per, len(SPACED.findall(text)) * per,
        sum(map(text.count, "0123456789")) / letters, sum(map(len, words)) / max(m, 1),
    ]


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted | None
    calibrated: Isotonic | None

    def score(self, texts) -> np.ndarray:
        if self.trees is None or not len(texts):
            return np.zeros(len(texts))
        weights = _weights_of(self)
        margin = self.trees.margin(np.array([features(t, weights) for t in texts]))
        return np.clip((1 - ORDER_SHARE) * self.calibrated(margin) + ORDER_SHARE / (1 + np.exp(-margin)), 0, 1)


def _weights_of(model: Model) -> _Weights:
    if not hasattr(model, "_weights"):
        model._weights = _Weights(model.lexicon)
    return model._weights


def held_out(doc_id):
    """Whether a row's id belongs to the fold whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _count(batches):
    """Counts of the lexicon entries of (text, toxic, part)."""
    counts: dict[tuple[int, int], Counter] = {}

    def flush():
        for (toxic, part), counter in counts.items():
            yield pd.DataFrame({"entry": list(counter), "toxic": toxic, "part": part, "n": list(counter.values())})
        counts.clear()

    for batch in batches:
        for text, toxic, part in zip(batch["text"], batch["toxic"].tolist(), batch["part"].tolist(), strict=True):
            words = {w.lower() for w in WORD.findall(text)}
            stems = Counter(b for w in words for b in beginnings(w))
            counter = counts.setdefault((toxic, part), Counter())
            counter.update(words)
            counter.update({b: min(n, MOST) for b, n in stems.items()})
            if sum(map(len, counts.values())) > COUNTED:
                yield from flush()
    yield from flush()


def _lexicons(sample: DataFrame, folder: str) -> list[dict[str, float]]:
    """Entry to weight (log of the ratio of shares) from sample (text, toxic, part): without each part, then of all."""

    @F.pandas_udf("long")
    def least_shingle(text: pd.Series) -> pd.Series:
        return text.map(lambda t: int(min(shingle_hashes(t, 5).view(np.int64), default=0)))

    one = F.min(F.struct("text", "part")).alias("one")
    sample = sample.select("toxic", "text", "part", least_shingle("text").alias("same")).groupBy("toxic", "same").agg(one).select("toxic", "one.*")
    sample = work.written(sample, f"{folder}/different")
    totals = {(r["toxic"], r["part"]): r["count"] for r in sample.groupBy("toxic", "part").count().collect()}
    of = lambda toxic, part: F.sum(F.when((F.col("toxic") == toxic) & (F.col("part") == part), F.col("n")).otherwise(0)).alias(f"n{toxic}_{part}")
    counted = sample.mapInPandas(work.tidy(_count), "entry string, toxic int, part int, n long").groupBy("entry").agg(*[of(t, k) for t in (0, 1) for k in range(PARTS)])
    counted = work.written(counted.where(sum(F.col(f"n1_{k}") for k in range(PARTS)) >= 3), f"{folder}/entries")
    return [_lexicon(counted, totals, [k for k in range(PARTS) if k != left_out]) for left_out in range(PARTS + 1)]


def _lexicon(counted: DataFrame, totals: dict[tuple[int, int], int], parts: list[int]) -> dict[str, float]:
    """The lexicon by the counts of some parts."""
    bad, good = (sum(totals.get((toxic, k), 0) for k in parts) for toxic in (1, 0))
    least, whole = max(3, round(0.005 * bad)), bad + good
    shares = counted.select("entry", *[sum(F.col(f"n{t}_{k}") for k in parts).alias(f"n{t}") for t in (0, 1)]).where(F.col("n1") >= least)
    ratio = (F.col("n1") + 0.5) / (bad + 1) / ((F.col("n0") + 0.5) / (good + 1))
    likely = lambda n, of: F.col(n) * F.log(F.greatest(F.col(n), F.lit(1e-9)) * whole / (of * (F.col("n1") + F.col("n0"))))
    evidence = 2 * (likely("n1", max(bad, 1)) + likely("n0", max(good, 1)))
    top = shares.withColumn("ratio", ratio).withColumn("evidence", evidence).where((F.col("ratio") >= RATIO) & (F.col("evidence") >= EVIDENCE)).orderBy(F.desc("evidence"), "entry").limit(LEXICON)
    out = {r["entry"]: float(np.log(r["ratio"])) for r in top.collect()}
    strongest = max(out.values(), default=1.0)
    return {**dict.fromkeys(sorted(INSULTS), strongest / 2), **out}


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic) of the training fold."""
    folder = work.work_folder(spark, "toxicity")
    key = F.col("doc_id").cast("long")
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select(key.alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = work.bounded_sample(known, SAMPLE, "doc_id")  # the documented bound; small enough to broadcast
    rows = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # an id may have very many rows
    rows = work.written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")), f"{folder}/sample")
    lexicons = _lexicons(rows, folder)

    def measure(batches):
        weights = [_Weights(x) for x in lexicons]
        for batch in batches:
            x = np.array([features(t, weights[k]) for t, k in zip(batch["text"], batch["part"], strict=True)])
            yield pd.DataFrame(x.reshape(-1, len(FEATURES)), columns=FEATURES).assign(doc_id=batch["doc_id"].to_numpy(), toxic=batch["toxic"].to_numpy(), part=batch["part"].to_numpy())

    found = rows.mapInPandas(work.tidy(measure), ", ".join(f"{f} double" for f in FEATURES) + ", doc_id long, toxic int, part int").toPandas().sort_values("doc_id")
    x, y, part = found[FEATURES].to_numpy(), found["toxic"].to_numpy().astype(float), found["part"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Model(lexicons[-1], None, None)
    return Model(lexicons[-1], *fit(x, y, part))


def fit(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> tuple[Boosted, Isotonic]:
    """Trees of all rows, calibrated by the margins that trees of the other parts give each row."""
    margin = np.zeros(len(y))
    for k in range(PARTS):
        own = part == k
        if own.any() and not own.all():
            margin[own] = boost(x[~own], y[~own]).margin(x[own])
    trees = boost(x, y)
    return trees, isotonic(margin if len(np.unique(part)) > 1 else trees.margin(x), y)


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    model = train(spark, docs, labels)

    def run(batches):
        for batch in batches:
            yield batch[["k", "m"]].assign(score=model.score(batch["text"]))

    key = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(work.tidy(run), "k long, m boolean, score double")
    doc_id = F.when(~F.col("m"), F.col("k"))
    return rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the model predicts as toxic; the decision is each row's own."""
    model = train(spark, docs, labels)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(text))

    return docs.where(scored(F.coalesce("text", F.lit(""))) < THRESHOLD)
