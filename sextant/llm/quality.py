"""Quality by hierarchical empirical Bayes.

A logistic classifier on a text's shape gives each document evidence. Grouped sums of that evidence give each host and
each path of a host a posterior: a path shrinks to its host, a host to the global prior, the more the fewer documents
it has, with strengths estimated from the spread between groups (method of moments). A document's posterior adds the
log odds of its path, relative to the global prior, to its own evidence.

The classifier is fitted on a bounded sample of labelled rows (`sample_rows`); sums of evidence cover all documents.
Null hosts and paths are groups of their own. Null and empty texts are rejected. Without labels of both kinds, weights
that were fitted on ordinary prose hold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bounded_sample, hold, small_batches, small_enough, tidy

SAMPLE_ROWS, THRESHOLD = 20_000, 0.5
#: Paths and hosts whose posteriors may be broadcast.
BROADCAST_GROUPS = 100_000
#: How far a group's log odds may move a document's: a site's record never outvotes clear evidence.
REACH = 1.5
FEATURES = ("bias", "log_words", "upper", "symbols", "pipes", "repeated", "repeated_lines", "word_length", "digits", "top_word", "no_stop")
DEFAULT = (4.0, 0.1, -6.0, -20.0, -20.0, -3.0, -1.0, 0.0, -4.0, -8.0, 0.0)
_SYMBOLS = "!#$%&*<>=~^\\{}"


def features(text: str | None) -> list[float]:
    """Shares in [0, 1] and logarithms that describe a text's shape."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    size = len(text)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    upper = sum(map(str.isupper, words))
    letters = sum(map(len, words))
    return [
        1.0,
        math.log1p(n) / 5,
        upper / n,
        min(1.0, sum(map(text.count, _SYMBOLS)) / n),
        min(1.0, text.count("|") / n),
        (1 - len(counts) / n) ** 2,
        1 - len(set(lines)) / len(lines),
        min(4.0, letters / n / 5),
        sum(map(text.count, "0123456789")) / size,
        max(counts.values()) / n if n >= 20 else 0.0,
        1.0 if n < 20 else 0.0,
    ]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Logistic weights from (doc_id, text) and (doc_id, quality). The sampled labels, at most about `sample_rows`, are broadcast."""
    small_batches(docs.sparkSession)
    labels = labels.filter("quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known = bounded_sample(labels, "doc_id", sample_rows, "quality")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t) for t in pdf["text"]], "y": pdf["quality"]})

    # of rows that share a labelled doc_id one counts, so no more rows than labels reach the driver
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).mapInPandas(run, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows], float)
    prior = np.array(DEFAULT)
    if len(set(y)) < 2:
        return prior
    x = np.array([r["x"] for r in rows])
    w = prior.copy()
    for _ in range(60):  # Newton's method, pulled lightly towards the default
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.05 * (w - prior)
        hess = (x.T * (p * (1 - p))) @ x + 0.05 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w


def evidence(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """The columns of `rows` but the last, which is a text, and p: the classifier's probability of good quality from the text alone."""
    small_batches(rows.sparkSession)
    w = np.asarray(weights)
    schema = StructType([*rows.schema.fields[:-1], StructField("p", DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([features(t) for t in texts]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            p[[not (t and t.strip()) for t in texts]] = 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], schema.names)
        tidy()

    return rows.mapInArrow(run, schema)


def _strength(groups: list) -> float:
    """Pseudo-count of a beta prior from (n, sum of p): between-group variance by the method of moments, between 2 and 1000."""
    n, total, squares, k = groups
    if not n or k < 2:
        return 50.0
    mean = total / n
    within = mean * (1 - mean)
    between = squares / k - within * (k / n if n else 0)
    return min(1000.0, max(2.0, within / between - 1)) if between > 1e-6 else 1000.0


def posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, shift) from (host, path, p), and the global prior: shift is the path's log odds less the global ones."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = hold(paths, "paths")
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    prior = min(0.999, max(0.001, (s + 1) / (n + 2))) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    moments = lambda df, n, s, to: df.agg(F.sum(n), F.sum(s), F.sum(F.pow(F.col(s) / F.col(n) - to, F.lit(2))), F.count("*")).first()
    kh = _strength(moments(hosts, "hn", "hs", F.lit(prior)))
    hosts = hosts.withColumn("h", (F.col("hs") + kh * prior) / (F.col("hn") + kh))
    both = paths.join(hosts.select(F.col("host").alias("host_"), "h"), F.col("host").eqNullSafe(F.col("host_")))
    kp = _strength(moments(both, "n", "s", F.col("h")))
    post = (F.col("s") + kp * F.col("h")) / (F.col("n") + kp)
    odds = lambda x: F.log(x / (1 - x))
    shift = odds(F.greatest(F.least(post, F.lit(0.999)), F.lit(0.001))) - F.lit(math.log(prior / (1 - prior)))
    return both.select("host", "path", "h", post.alias("path_posterior"), F.greatest(F.least(shift, F.lit(REACH)), F.lit(-REACH)).alias("shift")), prior


def _scored(docs: DataFrame, labels: DataFrame, host: Column | None, path: Column | None, keep: list[str]) -> DataFrame:
    """The columns `keep` as c0, c1 ..., with p, h, path_posterior and score. Texts are read once: evidence is written beside what is kept."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    weights = fit(docs, labels)
    rows = docs.select(*(F.col(k).alias(f"c{i}") for i, k in enumerate(keep)), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").alias("text"))
    rows = hold(evidence(rows, weights), "evidence")
    groups, prior = posteriors(rows.select("host", "path", "p"))
    groups = hold(groups.select(F.col("host").alias("gh"), F.col("path").alias("gp"), "h", "path_posterior", "shift"), "posteriors")
    groups = F.broadcast(groups) if small_enough(groups, BROADCAST_GROUPS) else groups
    joined = rows.join(groups, F.col("host").eqNullSafe(F.col("gh")) & F.col("path").eqNullSafe(F.col("gp")), "left")
    p = F.least(F.greatest(F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12))
    total = 1 / (1 + F.exp(-(F.log(p / (1 - p)) + F.coalesce("shift", F.lit(0.0)))))
    return joined.withColumn("score", F.when(F.col("p") == 0, 0.0).otherwise(total))


def score(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row (doc_id by default), then evidence, host_posterior, path_posterior, score.

    host defaults to `source` and path to `lang` within it, as documents have no URL.
    """
    keep = keep or ["doc_id"]
    out = _scored(docs, labels, host, path, keep)
    return out.select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(keep)), F.col("p").alias("evidence"), F.col("h").alias("host_posterior"), "path_posterior", "score")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, kept of every row."""
    return score(docs, labels).withColumn("kept", F.col("score") >= THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score reaches the threshold."""
    out = _scored(docs, labels, host, path, docs.columns).filter(F.col("score") >= threshold)
    return out.select(*(F.col(f"c{i}").alias(k) for i, k in enumerate(docs.columns)))
