"""Connected components of a graph given as a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, release


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of (a, b) the smallest node that links reach from it.

    Alternates large-star and small-star: every node's larger neighbours are linked to its smallest neighbour, then its
    smaller ones. Each half shrinks paths, so the number of rounds grows with the logarithm of a component's diameter.
    Every round is written to the shared folder. Self links are dropped; nodes without links aren't returned.
    """
    now = hold(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger=True)
        small = hold(_star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger=False), "links")
        release(now)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Link u's neighbours v (those above u, or those below it and u itself) to the smallest of u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = links.join(least, F.col("u") == F.col("k"))
    if larger:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    rest = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.filter("k <> m").select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
