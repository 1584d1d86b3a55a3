"""Exact nearest vectors by cosine: blocks of queries against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are sent to all tasks at once.
BLOCK = 2000


def _unit(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, float) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, row_id, similarity, rank): the k best rows of each query, ties to the smaller id.

    `queries` is (query_id, vector), `rows` (row_id, vector). Every block of queries goes over all rows as a matrix
    product; a batch of rows passes on k candidates for each query. Null vectors and those of length 0 match nothing.
    """
    queries = queries.filter("vector is not null")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not own:
            continue
        sent = rows.sparkSession.sparkContext.broadcast(([r["query_id"] for r in own], _unit([r["vector"] for r in own])))

        def run(batches, sent=sent):
            ids, q = sent.value
            for pdf in batches:
                if len(pdf):
                    found = np.nan_to_num(np.round(q @ _unit(pdf["vector"]).T, 6) + 0.0, nan=-2.0)
                    order = np.lexsort((np.broadcast_to(pdf["row_id"].to_numpy(), found.shape), -found))[:, :k]
                    i = np.repeat(np.arange(len(ids)), order.shape[1])
                    out = pd.DataFrame({"query_id": np.array(ids)[i], "row_id": pdf["row_id"].to_numpy()[order.ravel()], "similarity": found[i, order.ravel()]})
                    yield out[out["similarity"] > -2]

        part = rows.filter("vector is not null").select("row_id", "vector").mapInPandas(run, "query_id long, row_id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, row_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "row_id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
