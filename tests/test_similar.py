"""Nearest vectors and numbered rows against brute force."""

import numpy as np
from pyspark.sql import functions as F

from sextant.operators import order, similar


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = {k: rng.standard_normal(8).tolist() for k in range(200)} | {300: [0.0] * 8, 301: None}
    vectors[50] = vectors[40]
    rows = spark.createDataFrame(list(vectors.items()), "row_id long, vector array<double>")
    asked = rows.filter("row_id < 30 or row_id >= 300").withColumnRenamed("row_id", "query_id")
    got = {}
    for r in similar.nearest(asked, rows, k=5, block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"], round(r["similarity"], 6)))
    m = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors.items() if v and any(v)}
    for q in range(30):
        best = sorted(((-round(float(m[q] @ m[k]), 6), k) for k in m))[:5]
        assert sorted(got[q]) == [(i + 1, k, -s + 0.0) for i, (s, k) in enumerate(best)]
    assert set(got) == set(range(30))


def test_nearest_without_queries(spark):
    none = spark.createDataFrame([], "query_id long, vector array<double>")
    assert similar.nearest(none, spark.createDataFrame([(1, [1.0])], "row_id long, vector array<double>")).count() == 0


def test_numbered(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert sorted((r["x"], r["n"]) for r in order.numbered(rows, "n", "x", start=1).collect()) == [(k, k + 1) for k in range(500)]
    assert order.numbered(rows.limit(0), "n", "x").count() == 0
