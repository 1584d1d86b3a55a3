"""Command line: `python -m sextant pagerank|hits|search ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph, rank
from .sources import readers, writers


def pagerank(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The best pages of a link graph, from lists of in-links or from a written crawl."""
    lists = readers.link_table(spark, args.links) if args.crawl else readers.link_lists(spark, args.links)
    vertices, edges = graph.from_inlinks(lists)
    edges = graph.cleaned(vertices, edges)
    return graph.top_pages(graph.pagerank(vertices, edges), graph.degrees(vertices, edges), args.top)


def hits(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The best hubs and authorities around the pages of a written crawl that answer the query."""
    stored = spark.read.parquet(args.links)
    pages = stored.filter("content is not null").select(F.col("url").alias("doc_id"), F.col("content").alias("text"))
    asked = spark.createDataFrame([(1, args.query)], "query_id int, text string")
    root = rank.top(rank.search(pages, asked, ["bm25"]), "bm25").select(F.col("doc_id").alias("url"))
    vertices, edges = graph.from_inlinks(readers.link_table(spark, args.links))
    edges = graph.cleaned(vertices, edges)
    scores = graph.hits(graph.base_set(root, edges), edges).persist()
    best = lambda c: graph.best(scores.select("url", F.col(c).alias("score")), args.top).select(F.lit(c).alias("kind"), "url", "score")
    return best("hub").unionByName(best("authority"))


def search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Run lines of the best documents of a tagged corpus for a file of numbered queries."""
    docs = readers.corpus(spark, args.corpus, last_wins=True).withColumnRenamed("docno", "doc_id")
    asked = readers.numbered_queries(spark, args.queries).withColumnRenamed("query_text", "text")
    return writers.run_lines(rank.top(rank.search(docs, asked, [args.model]), args.model, args.top))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sextant", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("pagerank", pagerank), ("hits", hits), ("search", search)):
        own = commands.add_parser(name, help=run.__doc__)
        own.add_argument("--out", help="folder to write to as Parquet; printed without it")
        own.add_argument("--top", type=int, default=1000 if run is search else graph.TOP)
        own.set_defaults(run=run)
        if run is search:
            own.add_argument("corpus")
            own.add_argument("queries")
            own.add_argument("--model", default="bm25", choices=sorted(rank.MODELS))
        else:
            own.add_argument("links")
        if run is pagerank:
            own.add_argument("--crawl", action="store_true", help="the links are a written crawl")
        if run is hits:
            own.add_argument("--query", default="sports")
    args = parser.parse_args(argv)
    found = args.run(SparkSession.builder.appName("sextant").getOrCreate(), args)
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
    else:
        found.show(args.top, truncate=False)


if __name__ == "__main__":
    main()
