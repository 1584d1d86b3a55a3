"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to its character 4-grams, then 3-, 2-
and 1-grams: the longest length of which any gram is known counts, discounted by a factor for each step down.

The model is fitted on a bounded sample of labelled texts (`sample_rows`, chosen by a hash of the id) and keeps at most
WORDS words and GRAMS grams of each length in each of at most LANGUAGES languages, those with most labelled rows (others
are never predicted), and ROWS of both in all, so it can be broadcast whatever the corpus. Words above LONG letters give
no grams.
Null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learned.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches, tidy

SAMPLE_ROWS, WORDS, GRAMS, LANGUAGES, LONGEST, LONG = 20_000, 60_000, 40_000, 256, 4, 64
#: Words and grams of all languages together, some 100 bytes each.
ROWS = 2_500_000
DISCOUNT = 0.4
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, n, token, count): n is 0 for words, else the grams' length; grams are weighted by their words' counts."""

    def run(batches):
        for pdf in batches:
            for lang, own in pdf.groupby("lang")["text"]:
                words = Counter()
                for t in own:
                    words.update(tokens(t))
                rows = [(lang, 0, w, c) for w, c in words.items()]
                for n in range(1, LONGEST + 1):
                    grams = Counter()
                    for w, c in words.items():
                        if len(w) <= LONG:
                            for g in grams_of(w, n):
                                grams[g] += c
                    rows += [(lang, n, g, c) for g, c in grams.items()]
                yield pd.DataFrame(rows, columns=["lang", "n", "token", "count"])

    found = docs.filter(F.col("lang").isin(languages) & F.col("text").isNotNull()).select("lang", "text").mapInPandas(run, "lang string, n int, token string, count long")
    return found.groupBy("lang", "n", "token").agg(F.sum("count").alias("count"))


def most_frequent(counted: DataFrame, limits: dict[bool, int]) -> list:
    """The most frequent tokens of each (lang, n), at most a limit each: a cut-off count from the histogram of counts, so no task sorts a language."""
    counted = counted.persist()
    histogram = defaultdict(list)
    for r in counted.groupBy("lang", "n", "count").agg(F.count("*").alias("tokens")).collect():
        histogram[r["lang"], r["n"]].append((r["count"], r["tokens"]))
    least = []
    for (lang, n), hist in histogram.items():
        total, cut = 0, max(c for c, _ in hist) + 1
        for c, k in sorted(hist, reverse=True):
            if (total := total + k) > limits[n == 0]:
                break
            cut = c
        least.append((lang, n, cut))
    if not least:
        counted.unpersist()
        return []
    cuts = counted.sparkSession.createDataFrame(least, "lang string, n int, least long")
    kept = counted.join(F.broadcast(cuts), ["lang", "n"]).filter("count >= least").select("lang", "n", "token", "count").collect()
    counted.unpersist()
    return kept


class Model:
    """Log probabilities: one row of the matrix for each known word or gram, one column for each language."""

    def __init__(self, rows, languages: list[str], priors: list[float]):
        self.languages, self.priors = languages, np.log(np.array(priors)) if priors else np.zeros(0)
        at = {x: i for i, x in enumerate(languages)}
        by: list[dict[str, dict[int, int]]] = [defaultdict(dict) for _ in range(LONGEST + 1)]
        totals = np.zeros((LONGEST + 1, len(languages)))
        for lang, n, token, count in rows:
            by[n][token][at[lang]] = count
            totals[n, at[lang]] += count
        self.index: list[dict[str, int]] = []
        parts = []
        for n in range(LONGEST + 1):
            size = len(by[n]) + 1
            block = np.full((len(by[n]), len(languages)), 0.5)
            for i, own in enumerate(by[n].values()):
                for k, c in own.items():
                    block[i, k] += c
            parts.append(np.log(block) - np.log(totals[n] + 0.5 * size))
            self.index.append({t: i for i, t in enumerate(by[n])})
        self.words, self.grams = parts[0].astype(np.float32), [p.astype(np.float32) for p in parts]
        self.cache: dict[str, np.ndarray] = {}

    def unseen(self, word: str) -> np.ndarray:
        found = self.cache.get(word)
        if found is None:
            found = np.zeros(len(self.languages), np.float32)
            for step, n in enumerate(range(LONGEST, 0, -1)):
                ids = [i for g in grams_of(word, n) if (i := self.index[n].get(g)) is not None]
                if ids:
                    found = self.grams[n][ids].sum(0) / n * np.float32(DISCOUNT**step)
                    break
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = tokens(text) if text else []
        if not self.languages or not any(c.isalpha() for w in words for c in w):
            return "und", 0.0
        get = self.index[0].get
        ids = np.array([get(w, -1) for w in words])
        total = self.words[ids[ids >= 0]].sum(0, dtype=np.float64)
        for i in np.flatnonzero(ids < 0).tolist():
            total = total + self.unseen(words[i])
        total += self.priors
        top = int(total.argmax())
        share = np.exp((total - total[top]) / math.sqrt(len(words)))
        return self.languages[top], float(1 / share.sum())


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from (doc_id, text, lang); rows without text or lang are left out."""
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = [r["lang"] for r in known]
    if not languages:
        return Model([], [], [])
    each = ROWS // (len(languages) * (LONGEST + 1))
    rows = most_frequent(counts(bounded_sample(docs, "doc_id", sample_rows, "langid"), languages), {True: min(WORDS, each), False: min(GRAMS, each)})
    total = sum(r["count"] for r in known)
    return Model([tuple(r) for r in rows], languages, [r["count"] / total for r in known])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for pdf in batches:
            found = [m.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows whose crc32(doc_id) mod 5 is not 0."""
    model = fit(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id"), 5) != 0))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
