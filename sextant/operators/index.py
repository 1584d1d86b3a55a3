"""Positional inverted index as tables: postings, statistics of terms, documents and the corpus, dictionaries, merging.

A posting is (term, doc_id, tf, positions), positions from 1 over the tokens that remain after stop words. A posting is
local to its document: a document's tokens are sorted and cut into postings where they are, so postings take no shuffle
unless an id is repeated, and statistics of terms take one, by term. Texts are tokenised once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stem import stem as stem_of
from ..functions.text import tokens
from .order import numbered

#: Distinct terms whose stems may be broadcast, at some 20 bytes each.
BROADCAST_TERMS = 200_000
#: Documents that Python reads at once, of up to some 20,000 tokens each, and postings that it sends at once.
READ_ROWS, SENT_ROWS = 1000, 100_000


def token_rows(docs: DataFrame, stop: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, position) of every token."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col), stop)).alias("p", "term"))
    return found.select("doc_id", "term", (F.col("p") + 1).alias("position"))


def stemmed(rows: DataFrame, algorithm: str, keep: Column | None = None) -> DataFrame:
    """The rows with `term` stemmed, once for each distinct term; where `keep` is true the term stays."""
    stems = rows.select("term").distinct().select("term", stem_of("term", algorithm).alias("stem"))
    stems = F.broadcast(stems) if stems.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else stems
    stem = F.col("stem") if keep is None else F.when(keep, F.col("term")).otherwise(F.col("stem"))
    return rows.join(stems, "term").withColumn("term", stem).drop("stem")


def postings(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions) from token rows."""
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("positions"))


def repeated(docs: DataFrame, id_col: str) -> bool:
    """Whether any id names more than one row. Ids alone are shuffled."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def cut_runs(rows: DataFrame, positions: bool = False) -> tuple[DataFrame, Column]:
    """From rows with a sorted array `t`, of terms or of structs (term, position): the rows with what the column needs, and the column.

    It holds an array of (term, tf), with positions if asked for, and null if `t` is empty. Explode it itself: of a
    column of the rows Spark would infer a filter and evaluate `t` again for each element.
    """
    term = (lambda i: F.get("t", i)["term"]) if positions else (lambda i: F.get("t", i))
    n = F.size("t")
    begins = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (term(i) != term(i - 1)))
    rows = rows.withColumn("a", begins).withColumn("b", F.concat(F.slice("a", 2, F.size("a")), F.array(n)))

    def posting(x):
        size = x["b"] - x["a"]
        return F.struct(term(x["a"]).alias("term"), size.cast("long").alias("tf"), *([F.slice("t", x["a"] + 1, size)["position"].alias("positions")] if positions else []))

    return rows, F.when(n > 0, F.transform(F.arrays_zip("a", "b"), posting))


def _local(docs: DataFrame, stop: Iterable[str] | None, id_col: str, text_col: str, positions: bool) -> DataFrame:
    """(term, doc_id, tf), with positions if asked for, of each row by itself: whole batches of token lists are sorted by document and term at once."""
    conf, size = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(size)) <= READ_ROWS:
        conf.set(size, str(READ_ROWS))

    def run(batches):
        for batch in batches:
            ids, lists = batch.columns
            own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            words = lists.flatten().dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(own * len(words.dictionary) + code, kind="stable")
            own, code = own[order], code[order]
            new = np.ones(len(order), bool)
            new[1:] = (own[1:] != own[:-1]) | (code[1:] != code[:-1])
            begins = np.flatnonzero(new)
            offsets = np.append(begins, len(order)).astype(np.int32)
            out = {"term": words.dictionary.take(pa.array(code[begins])), "doc_id": ids.take(pa.array(own[begins])), "tf": pa.array(np.diff(offsets).astype(np.int64))}
            if positions:
                first = np.searchsorted(own, np.arange(batch.num_rows))
                out["positions"] = pa.ListArray.from_arrays(offsets, pa.array((order - first[own] + 1).astype(np.int32)))
            whole = pa.RecordBatch.from_pydict(out)
            for a in range(0, len(begins), SENT_ROWS):
                yield whole.slice(a, SENT_ROWS)

    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col), stop).alias("t"))
    return rows.mapInArrow(run, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, tf long" + (", positions array<int>" if positions else ""))


def postings_of(docs: DataFrame, stop: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf, positions) of a corpus: without a shuffle, unless ids are repeated."""
    if repeated(docs, id_col):
        return postings(token_rows(docs, stop, id_col, text_col))
    return _local(docs, stop, id_col, text_col, True)


def counted(docs: DataFrame, stop: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id, tf) without positions."""
    if not repeated(docs, id_col):
        return _local(docs, stop, id_col, text_col, False)
    return token_rows(docs, stop, id_col, text_col).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, ttf): documents that have the term, and its occurrences."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def doc_stats(docs: DataFrame, stop: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_len) of every document, 0 for those without tokens. No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text_col), stop)).cast("long").alias("doc_len"))


def corpus_stats(posts: DataFrame) -> DataFrame:
    """One row: documents with tokens, distinct terms, tokens, and the mean length, exact and rounded half to even."""
    terms = posts.groupBy("term").agg(F.sum("tf").alias("ttf")).agg(F.count("*").alias("vocabulary"), F.sum("ttf").alias("tokens"))
    docs = posts.select("doc_id").distinct().agg(F.count("*").alias("docs"))
    return _numbers(docs, terms)


def _numbers(docs: DataFrame, terms: DataFrame) -> DataFrame:
    mean = F.try_divide(F.col("tokens").cast("double"), F.col("docs"))
    return docs.crossJoin(terms).select("docs", "vocabulary", "tokens", mean.alias("mean_len"), F.bround(mean).cast("long").alias("rounded_len"))


def vocabulary_size(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct terms, exact or by HyperLogLog."""
    return posts.agg((F.approx_count_distinct("term") if approximate else F.count_distinct("term")).alias("vocabulary"))


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(column, id): dense ids from 0 in order of the value."""
    return numbered(values.select(column).filter(F.col(column).isNotNull()).distinct(), "id", column)


def format_postings(posts: DataFrame, by_tf: bool = False) -> DataFrame:
    """(term, line): `doc,p1,p2 doc,p1`, by doc_id, or by falling tf and doc_id."""
    part = F.concat_ws(",", F.col("doc_id").cast("string"), F.array_join(F.col("positions").cast("array<string>"), ","))
    order = F.struct((-F.col("tf")).alias("o"), "doc_id", part.alias("part")) if by_tf else F.struct("doc_id", part.alias("part"))
    return posts.groupBy("term").agg(F.sort_array(F.collect_list(order)).alias("all")).select("term", F.array_join(F.col("all.part"), " ").alias("line"))


def parse_postings(lines: DataFrame) -> DataFrame:
    """The inverse: (term, doc_id as string, tf, positions) from (term, line); empty parts are skipped."""
    entries = lines.select("term", F.explode(F.filter(F.split("line", " "), lambda x: x != "")).alias("entry"))
    cells = entries.select("term", F.split("entry", ",").alias("c"))
    positions = F.transform(F.filter(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x: x != ""), lambda x: x.cast("int"))
    return cells.select("term", F.get("c", 0).alias("doc_id"), F.size(positions).cast("long").alias("tf"), positions.alias("positions"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two partial indexes as one. Of a document in both the shorter list wins, the right one where they are as long."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(0)))
    best = F.min_by(F.struct("tf", "positions"), F.struct("tf", "side"))
    return both.groupBy("term", "doc_id").agg(best.alias("m")).select("term", "doc_id", "m.*")


@dataclass
class Index:
    """The tables of one index."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    corpus: DataFrame

    def term(self, *terms: str) -> DataFrame:
        """Postings of the given terms; the filter reaches the scan of a written index, which is sorted by term."""
        return self.postings.filter(F.col("term").isin(*terms))


def build(docs: DataFrame, stop: Iterable[str] | None = None, stem: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Postings and statistics of a corpus; a repeated id counts as one document. Persist or `write` before using it more than once."""
    posts = postings(stemmed(token_rows(docs, stop, id_col, text_col), stem)) if stem else postings_of(docs, stop, id_col, text_col)
    lengths = doc_stats(docs, stop, id_col, text_col).groupBy("doc_id").agg(F.sum("doc_len").alias("doc_len"))
    return Index(posts, term_stats(posts), lengths, corpus_stats(posts))


def write(index: Index, folder: str, codec: str = "zstd", partitions: int | None = None) -> None:
    """The index as Parquet: postings in ranges of terms and documents, so a term's lookup reads a few row groups and no task takes all of a frequent term."""
    n = partitions or int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = index.postings.persist(StorageLevel.DISK_ONLY)  # the ranges' bounds are sampled from it first
    held.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", codec).parquet(f"{folder}/postings")
    held.unpersist()
    spark = index.postings.sparkSession
    for name, table in (("terms", term_stats(spark.read.parquet(f"{folder}/postings"))), ("docs", index.docs)):
        table.write.mode("overwrite").option("compression", codec).parquet(f"{folder}/{name}")
    docs = spark.read.parquet(f"{folder}/docs").filter("doc_len > 0").agg(F.count("*").alias("docs"))
    terms = spark.read.parquet(f"{folder}/terms").agg(F.count("*").alias("vocabulary"), F.sum("ttf").alias("tokens"))
    _numbers(docs, terms).write.mode("overwrite").option("compression", codec).parquet(f"{folder}/corpus")


def read(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{n}") for n in ("postings", "terms", "docs", "corpus")))


def build_or_read(spark: SparkSession, folder: str, docs: DataFrame, **options) -> Index:
    """The index in the folder; built and written first if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/corpus/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        write(build(docs, **options), folder)
    return read(spark, folder)


def variant(folder: str, stem: str | None, codec: str) -> str:
    """Where the variant of an index with a stemmer and a codec is."""
    return f"{folder}/stem={stem or 'none'}/codec={codec}"


def write_variants(docs: DataFrame, folder: str, stems: Iterable[str | None] = (None, "porter"), codecs: Iterable[str] = ("zstd", "none"), **options) -> None:
    """An index for each stemmer and codec, each built once and written with every codec."""
    for stem in stems:
        built = build(docs, stem=stem, **options)
        for codec in codecs:
            write(built, variant(folder, stem, codec), codec)
