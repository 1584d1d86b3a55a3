"""Tables merged by key: documents with sets of links, in-links alone, last row wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import not_blank

SETS = ("inlinks", "outlinks", "authors")
CRAWL = "url string, content string, inlinks array<string>, outlinks array<string>, authors array<string>"


def union_of(a: Column, b: Column) -> Column:
    """The sorted distinct members of two arrays, either of which may be null."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the last by `order`."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last")).select(key, "last.*")


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first by `order`."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(key, "first.*")


def by_id(stored: DataFrame, *ids: str, key: str = "url") -> DataFrame:
    """The stored documents with the given ids; none for unknown ones. The filter reaches the scan."""
    return stored.filter(F.col(key).isin(*ids))


def documents(stored: DataFrame | None, new: DataFrame, key: str = "docno", text: str = "text") -> DataFrame:
    """New documents in place of stored ones with the same key; those with blank text are skipped."""
    new = new.filter(not_blank(F.col(text))).dropDuplicates([key])
    if stored is None:
        return new
    return stored.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def pages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Crawl documents: links and authors of both rows united, content of the new one if it has any. One shuffle."""
    sets = [c for c in SETS if c in stored.columns]
    both = stored.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1)), allowMissingColumns=True)
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in sets]
    others = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("side"))).alias(c) for c in stored.columns if c not in (*sets, "url")]
    return both.filter("url is not null").groupBy("url").agg(*others, *united).select(*stored.columns)


def inlinks(stored: DataFrame, edges: DataFrame) -> DataFrame:
    """In-links from edges (src, dst) added to the stored pages; a page that isn't stored yet becomes a row without content."""
    new = edges.groupBy(F.col("dst").alias("url")).agg(F.collect_set("src").alias("more"))
    joined = stored.join(new, "url", "full_outer").withColumn("inlinks", union_of(F.col("inlinks"), F.col("more")))
    return joined.select(*stored.columns)


def with_content(stored: DataFrame) -> DataFrame:
    """Without the rows that only hold in-links."""
    return stored.filter("content is not null")
