"""Relevance assessment: parsing stored documents, grading by similarity of embeddings or by a model's reply.

Embedding and grading models are callables over batches, so any can be put in; none is bundled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_chars, strip
from ..functions.vectors import cosine, grade_of, grade_of_reply


def _between(content: Column, tag: str) -> Column:
    """The stripped text of the first element; null if there is none, empty if it is empty."""
    return F.when(content.rlike(rf"(?s)<{tag}>.*?</{tag}>"), strip(F.regexp_extract(content, rf"(?s)<{tag}>(.*?)</{tag}>", 1)))


def wrapped(content: Column) -> list[Column]:
    """docno, title and text of a stored document's content."""
    return [_between(content, t).alias(n) for t, n in (("DOCNO", "docno"), ("HEAD", "title"), ("TEXT", "text"))]


def assessable(docs: DataFrame) -> DataFrame:
    """Documents with both a title and a text."""
    return docs.filter((F.col("title") != "") & (F.col("text") != ""))


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list], column: str = "embedding") -> DataFrame:
    """The rows with the embedding of a text column, by a model that takes a batch of texts."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed([t or "" for t in batch])])

    return df.withColumn(column, run(text))


def assessed(pairs: DataFrame, query: str = "query", title: str = "title", text: str = "text") -> DataFrame:
    """The rows with `similarity` and `grade`, from the embeddings of query, title and text."""
    a, b = cosine(F.col(query), F.col(title)), cosine(F.col(query), F.col(text))
    return pairs.withColumn("similarity", (a + b) / 2).withColumn("grade", grade_of(a, b))


def graded_by_model(pairs: DataFrame, ask: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    """(query, url, title, content) with `grade` from the JSON replies of a model that takes a batch of rows; contents are cut to 1000 characters."""

    @F.pandas_udf("string")
    def run(query: pd.Series, url: pd.Series, title: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(ask(pd.DataFrame({"query": query, "url": url, "title": title, "content": content})))

    return pairs.withColumn("grade", grade_of_reply(run("query", "url", "title", first_chars(F.col("content")))))


def sampled(scored: DataFrame, k: int = 210, seed: str = "") -> DataFrame:
    """At most k documents of each query, chosen by a hash: a shuffle that is the same for the same seed."""
    order = Window.partitionBy("query_id").orderBy(F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    return scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")
