"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters) and matched against the lexicon
by an Aho-Corasick automaton. An entry is a whole word or a beginning of words. Exception phrases (two words, one of
them in the lexicon, seen in harmless texts only) cancel the matches inside them. The sum of the matches' weights,
divided by the logarithm of the length, goes through a logistic curve.

The lexicon is learned from a bounded sample of labelled rows (`sample_rows`): an entry's share of toxic texts must be
too high to be chance among all candidate entries (a binomial bound). Entries have 3 to 40 letters; at most ENTRIES and as many phrases
are kept. A small list of insults is always in. Null and empty texts get the score of a text without matches.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, small_batches

SAMPLE_ROWS, ENTRIES, THRESHOLD = 40_000, 5_000, 0.7
SEED_WORDS = "idiot moron stupid pathetic worthless scum loser disgusting imbecile".split()
SEED_EXCEPTIONS = ["idiot proof", "stupid simple", "sore loser board"]
PREFIXES = (3, 4, 5, 6)

_LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнαβεικνορτυχγı", "aeopcyxijsdhkmtbhabeiknoptuxyi")) | dict(zip("0134578@$", "oieastbas"))
_WORD = re.compile(r"[^\W\d_]+")


class _Fold(dict):
    def __missing__(self, code):
        c = chr(code)
        out = _LOOKALIKES.get(c)
        if out is None:
            out = "".join(_LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c).lower())
        self[code] = out
        return out


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Lower case; letters of other scripts, digits and signs turned into the letters they imitate. Accents stay: they tell words apart."""
    return (text or "").lower().translate(_FOLD)


def entries_of(words: list[str]) -> list[str]:
    """Each word and its beginnings, as often as they occur."""
    return words + [f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n]


def specific(found: list[tuple[str, int]]) -> set[str]:
    """Of (entry, toxic texts), those without a longer entry inside them that accounts for nearly all their toxic texts."""
    best: dict[str, int] = {}
    for e, pos in found:
        stem = e.rstrip("*")
        for n in range(1, len(stem) + (not e.endswith("*"))):
            best[stem[:n]] = max(best.get(stem[:n], 0), pos)
    return {e for e, pos in found if not e.endswith("*") or best.get(e[:-1], 0) < 0.85 * pos}


class Lexicon:
    """Weights of entries ('word' or 'beginning*'), exception phrases, and the logistic curve's two numbers."""

    def __init__(self, weights: dict[str, float], phrases: list[str] = (), curve: tuple[float, float] = (-3.0, 4.0)):
        self.weights, self.phrases, self.curve = weights, list(phrases), curve
        self._machine = None

    def __getstate__(self):
        return self.weights, self.phrases, self.curve

    def __setstate__(self, state):
        (self.weights, self.phrases, self.curve), self._machine = state, None

    def machine(self):
        if self._machine is None:
            m = ahocorasick.Automaton()
            by: dict[str, list] = {}
            for e, w in self.weights.items():
                by.setdefault(e.rstrip("*"), []).append((e.endswith("*"), w))
            for p in self.phrases:
                by.setdefault(p, []).append((False, None))
            for key, own in by.items():
                m.add_word(key, (len(key), own))
            if by:
                m.make_automaton()
            self._machine = m
        return self._machine

    def matches(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) in folded text: the heaviest entry at each start, without those inside an exception phrase."""
        m = self.machine()
        if not len(m):
            return []
        found: dict[int, tuple[int, float]] = {}
        free = []
        for last, (size, own) in m.iter(text):
            start, end = last - size + 1, last + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end == len(text) or not text[end].isalpha()
            for prefix, weight in own:
                if weight is None:
                    if closed:
                        free.append((start, end))
                elif (prefix != closed or prefix) and (start not in found or found[start][1] < weight):
                    found[start] = (end, weight)
        return [(s, e, w) for s, (e, w) in found.items() if not any(a <= s and e <= b for a, b in free)]

    def evidence(self, text: str | None) -> float:
        f = folded(text)
        return sum(w for _, _, w in self.matches(f)) / math.log2(8 + f.count(" "))

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * self.evidence(text)))))


def _significant(pos: int, neg: int, base: float, candidates: int) -> bool:
    """Whether so high a share of toxic texts is not to be expected by chance in any of the candidates."""
    n, p = pos + neg, pos / (pos + neg)
    if p <= base or pos < 3:
        return False
    kl = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
    return n * kl > math.log(2 * max(candidates, 1))


_COUNTS = ("pos", "neg", "tpos", "tneg")


def _counted(rows: DataFrame, find) -> DataFrame:
    """(entry, pos, neg, tpos, tneg): in how many toxic and harmless texts each of find(folded text) occurs, and how often."""

    def run(batches):
        for pdf in batches:
            c = [Counter() for _ in range(4)]
            for t, y in zip(pdf["text"], pdf["toxic"]):
                own = Counter(find(folded(t)))
                c[1 - int(y)].update(own.keys())
                c[3 - int(y)].update(own)
            yield pd.DataFrame([(k, *(x[k] for x in c)) for k in c[0] | c[1]], columns=["entry", *_COUNTS])

    return rows.mapInPandas(run, "entry string, " + ", ".join(f"{x} long" for x in _COUNTS)).groupBy("entry").agg(*(F.sum(x).alias(x) for x in _COUNTS))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """Learn from (doc_id, text) and (doc_id, toxic). Without rows of both kinds the built-in words and curve are all there is.

    The labels are sampled first: at most about `sample_rows` small rows are broadcast, and no text is shuffled.
    """
    small_batches(docs.sparkSession)
    seeds = dict.fromkeys(SEED_WORDS, 2.0)
    labels = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = bounded_sample(labels, "doc_id", sample_rows, "toxicity")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").persist()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        rows.unpersist()
        return Lexicon(seeds, SEED_EXCEPTIONS)
    base = pos / (pos + neg)
    counted = _counted(rows, lambda t: entries_of([w for w in _WORD.findall(t) if 3 <= len(w) <= 40])).filter("pos + neg >= 3").persist()
    candidates = counted.count()
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    likely = counted.filter((F.col("pos") >= 3) & (share > max(2 * base, 0.3))).orderBy(F.desc(F.col("pos") - F.col("neg")), "entry").limit(2 * ENTRIES).collect()
    counted.unpersist()
    likely = [r for r in likely if _significant(r["pos"], r["neg"], base, candidates)]
    kept = specific([(r["entry"], r["pos"]) for r in likely])
    weights = seeds | {r["entry"]: math.log((r["tpos"] + 0.5) / (pos + 1)) - math.log((r["tneg"] + 0.5) / (neg + 1)) for r in likely if r["entry"] in kept}
    weights = dict(list(weights.items())[:ENTRIES])
    lexicon = Lexicon(weights)

    def around(t: str) -> set[str]:
        words = {t[s:e] for s, e, _ in lexicon.matches(t)}
        seq = _WORD.findall(t) if words else []
        return {f"{a} {b}" for a, b in zip(seq, seq[1:]) if a in words or b in words}

    phrases = [r["entry"] for r in _counted(rows, around).filter("pos = 0 and neg >= 3").orderBy(F.desc("neg"), "entry").limit(ENTRIES).collect()]
    lexicon = Lexicon(weights, [*SEED_EXCEPTIONS, *phrases])

    def binned(batches):
        for pdf in batches:
            yield pd.DataFrame({"bin": [min(400, round(20 * lexicon.evidence(t))) for t in pdf["text"]], "y": pdf["toxic"], "c": 1}).groupby(["bin", "y"], as_index=False).sum()

    hist = rows.mapInPandas(binned, "bin int, y int, c long").groupBy("bin", "y").agg(F.sum("c").alias("c")).collect()
    rows.unpersist()
    return Lexicon(weights, lexicon.phrases, _curve([(max(0, r["bin"]) / 20, r["y"], r["c"]) for r in hist]))


def _curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic regression on one number, with a slight pull towards slope 4 and intercept -3."""
    x, y, c = (np.array(v, float) for v in zip(*points))
    at, prior = np.array([-3.0, 4.0]), np.array([-3.0, 4.0])
    m = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
        grad = m.T @ (c * (y - p)) - 0.5 * (at - prior)
        hess = (m.T * (c * p * (1 - p))) @ m + 0.5 * np.eye(2)
        at = at + np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(at[0]), float(max(at[1], 0.1))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = sent.value
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": [lex.score(t) for t in pdf["text"]]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    lexicon = fit(docs, labels.select("doc_id", "toxic").filter(fold(F.col("doc_id"), 3) != 1))
    return score(docs, lexicon).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
