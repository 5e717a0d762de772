"""Language identification by Bayesian evidence fusion.

For each text four pieces of evidence are combined: the likelihood of its character trigrams, the language its markup
declares, the suffix of its address, and a prior for its host. How far a declaration can be trusted, and which languages
a suffix or host holds, is not assumed but counted: a first pass writes every text's likelihoods, grouped aggregations
sum the languages they point to by declaration, by suffix and by host, and hosts are smoothed towards their suffix,
suffixes towards the whole. Each text's own share is taken out of its host's sum before the host speaks for it.

The trigram model is fitted on about SAMPLE labelled documents (those with a low hash: a documented bound); all
counts of the fusion cover every row.

Defined results: a null or empty text has no likelihood and is judged by the other evidence; rows without any evidence
get the commonest language; a null url has host "" and suffix ""; null and repeated ids keep their rows; empty tables
give no rows; without labelled documents there are no languages and lang is null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .html import extract

SAMPLE = 8_000
BUCKETS = 1 << 16
#: Characters of evidence that a text can bring at most; trigrams overlap, so a long text is not as sure as it sums up.
EVIDENCE_CHARS = 120
#: Weight, in texts, of what stands above in the hierarchy.
SUFFIX_SMOOTHING, HOST_SMOOTHING, DECLARED_SMOOTHING = 50.0, 10.0, 2.0
UNKNOWN = "-"


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the lower-case text; white space and digits are folded."""
    plain = " " + " ".join(text.lower().split()) + " "
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where((c >= 48) & (c <= 57), 48, c)
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


class TextModel:
    """Log-likelihood of hashed trigrams under each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
        self.table = np.ascontiguousarray(np.log(p).T.astype(np.float32))

    def likelihood(self, text: str) -> np.ndarray:
        """Mean log-likelihood times the evidence a text of its length has."""
        t = trigrams(text)
        if not len(t) or not text.strip():
            return np.zeros(len(self.languages))
        counts = np.bincount(t, minlength=BUCKETS) if len(t) > BUCKETS else None
        total = counts @ self.table if counts is not None else self.table[t].sum(axis=0, dtype=np.float64)
        return total / len(t) * min(len(t), EVIDENCE_CHARS)


def fit(docs: DataFrame) -> TextModel:
    """The text model from docs (text, lang): counts of a bounded sample, summed in Spark."""
    sample = work.bounded_sample(docs.where("lang is not null and text is not null"), SAMPLE, "doc_id", "text").select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, c in sums.items():
            some = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": c[some]})

    rows = sample.mapInPandas(work.tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    for k, lang in enumerate(languages):
        of = rows[rows["lang"] == lang]
        counts[k, of["bucket"].to_numpy()] = of["n"].to_numpy()
    return TextModel(languages, counts)


def declared_language(html):
    """The primary tag of the language that the markup declares, or UNKNOWN."""
    tag = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    meta = F.lower(F.regexp_extract(html, r"(?is)<meta\b[^>]*?http-equiv\s*=\s*[\"']?content-language[\"']?[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))
    return F.when(tag != "", tag).when(meta != "", meta).otherwise(UNKNOWN)


def softmax(logs: np.ndarray) -> np.ndarray:
    """Probabilities from logs, row by row."""
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


FOUND = "k long, m boolean, is_page boolean, declared string, suffix string, host string, ll array<double>, p array<double>"
FUSED = "k long, m boolean, is_page boolean, declared string, ll array<double>, posterior array<double>"


def evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (id columns, declared, suffix, host, text, is_page) with ll, log-likelihoods in the order of the languages,
    and p, the probabilities they stand for."""

    def run(batches):
        for batch in batches:
            if len(batch):
                ll = np.array([model.likelihood(extract(text, None)[0] if page else text) for text, page in zip(batch["text"], batch["is_page"], strict=True)])
                yield batch[["k", "m", "is_page", "declared", "suffix", "host"]].assign(ll=list(ll), p=list(softmax(ll)))

    return rows.mapInPandas(work.tidy(run), FOUND)


def fuse(found: DataFrame, languages: list[str], folder: str) -> DataFrame:
    """The rows of found (FOUND) with posterior: probabilities in the order of the languages (FUSED).

    The sums by host are written first, so that their number is known: a bounded number of hosts is broadcast without
    moving the texts' rows; more are joined by sorting, where Spark splits the rows of a hot host.
    """
    n = len(languages)
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    array = lambda name: F.array(*[F.round(F.col(f"s{i}"), 6) for i in range(n)]).alias(name)
    hosts = work.written(found.groupBy("host", "suffix").agg(*sums), f"{folder}/hosts")
    suffixes = work.written(hosts.groupBy("suffix").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]).select("suffix", array("suffix_sum")), f"{folder}/suffixes")
    declared = work.written(found.groupBy("declared").agg(*sums).select("declared", array("declared_sum")), f"{folder}/declared")
    whole = np.array([float(x or 0) for x in declared.select(*[F.sum(F.col("declared_sum")[i]) for i in range(n)]).first()])
    out = found.join(work.small(hosts.select("host", "suffix", array("host_sum"))), ["host", "suffix"]).join(work.small(suffixes), "suffix").join(work.small(declared), "declared")

    def weigh(batches):
        total = max(whole.sum(), 1e-9)
        overall = (whole + 1) / (total + n)
        for batch in batches:
            if not len(batch):
                continue
            ll, own, host, suffix, said = (np.stack(batch[c].to_numpy()) for c in ("ll", "p", "host_sum", "suffix_sum", "declared_sum"))
            size = lambda x: x.sum(axis=1, keepdims=True)
            suffix_prior = (suffix + SUFFIX_SMOOTHING * overall) / (size(suffix) + SUFFIX_SMOOTHING)
            others = np.maximum(host - own, 0)  # a text doesn't vouch for itself
            host_prior = (others + HOST_SMOOTHING * suffix_prior) / (size(others) + HOST_SMOOTHING)
            # P(declared | language): the language's texts that declare this, smoothed towards what all declare
            declares = (said + DECLARED_SMOOTHING * size(said) / total) / (whole + DECLARED_SMOOTHING)
            posterior = softmax(ll + np.log(host_prior) + np.log(declares))
            yield batch[["k", "m", "is_page", "declared", "ll"]].assign(posterior=list(posterior))

    return out.select("k", "m", "is_page", "declared", "ll", "p", "host_sum", "suffix_sum", "declared_sum").mapInPandas(work.tidy(weigh), FUSED)


def identify(spark: SparkSession, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for each document (doc_id) and page (page_id): lang, probability, the text's own guess and declaration.

    A document's host is its source; its labelled language is only a label to fit on, never evidence.
    """
    folder = work.work_folder(spark, "language")
    model = fit(docs)
    key, page = F.col("doc_id").cast("long"), F.col("page_id").cast("long")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    d = docs.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().alias("m"), F.lit(False).alias("is_page"), F.lit(UNKNOWN).alias("declared"), F.lit("").alias("suffix"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    html = F.coalesce("html", F.lit(""))
    g = pages.select(F.coalesce(page, F.lit(0)).alias("k"), page.isNull().alias("m"), F.lit(True).alias("is_page"), declared_language(html).alias("declared"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), host.alias("host"), html.alias("text"))
    rows = d.unionByName(g)
    key = F.when(~F.col("m"), F.col("k"))
    ids = [F.when(~F.col("is_page"), key).alias("doc_id"), F.when(F.col("is_page"), key).alias("page_id"), F.when(F.col("is_page"), "page").otherwise("document").alias("kind")]
    if not model.languages:
        return rows.select(*ids, *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"))], "declared")
    found = work.written(evidence(rows, model), f"{folder}/evidence")
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    fused = fuse(found, model.languages, folder)
    certain = F.array_max("ll") > F.array_min("ll") if len(model.languages) > 1 else F.lit(True)
    return fused.select(*ids, best(F.col("posterior")).alias("lang"), F.round(F.array_max("posterior"), 6).alias("probability"), F.when(certain, best(F.col("ll"))).alias("text_lang"), "declared")
