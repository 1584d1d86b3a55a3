"""Readers: tagged corpora, word lists, queries, runs, judgements, link lists, assessments, robots rules.

Every reader is a scan with column expressions, so files are split among tasks however large they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip

RUN = "query_id string, q0 string, doc_id string, rank int, score double, tag string"
ASSESSMENT = "QueryID string, AssessorID string, DocID string, `Auto Grade` string, Grade string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, place): place orders the lines of all files."""
    rows = spark.read.text(path)
    return rows.select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"))


def _last(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows with the same key the one that comes last."""
    rest = [c for c in df.columns if c not in (*keys, "place")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "place").alias("last")).select(*keys, "last.*")


def docno(record: Column) -> Column:
    """The text of the line with the DOCNO tag; null if there is none."""
    cut = F.split(record, "<DOCNO>", 2)
    line = F.concat(F.substring_index(F.get(cut, 0), "\n", -1), F.lit("<DOCNO>"), F.substring_index(F.get(cut, 1), "\n", 1))
    return F.when(record.contains("<DOCNO>"), strip(F.replace(F.replace(line, F.lit("<DOCNO>"), F.lit("")), F.lit("</DOCNO>"), F.lit(""))))


def record_text(record: Column, strip_lines: bool = False) -> Column:
    """The lines strictly between the lines with TEXT tags, of all blocks, joined by one space.

    A block is taken down to its end tag, and the line of that tag is dropped after the split: a pattern that looks for
    the line's beginning reads each line once for each of its characters.
    """
    blocks = F.regexp_extract_all(record, F.lit(r"(?s)<TEXT>[^\n]*+\n(.*?)</TEXT>(?:[^\n]*</TEXT>)?"), F.lit(1))
    lines = F.flatten(F.transform(F.transform(blocks, lambda b: F.split(b, "\n")), lambda x: F.slice(x, 1, F.size(x) - 1)))
    return F.array_join(F.transform(lines, strip) if strip_lines else lines, " ")


def corpus(spark: SparkSession, path: str, strip_lines: bool = False, last_wins: bool = False) -> DataFrame:
    """(docno, text) of a folder of tagged files. The end tag separates records, so a file needs not fit in memory.

    Hidden files are skipped and bytes that aren't UTF-8 dropped. `last_wins` keeps one row for each docno, and drops
    records without one.
    """
    rows = spark.read.option("lineSep", "</DOC>").text(path)
    value = F.replace(F.col("value"), F.lit("�"), F.lit(""))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    found = rows.select(value.alias("value"), place.alias("place")).filter(F.col("value").contains("<DOC>"))
    out = found.select(docno(F.col("value")).alias("docno"), record_text(F.col("value"), strip_lines).alias("text"), "place")
    return _last(out.filter("docno is not null"), "docno") if last_wins else out.drop("place")


def words(spark: SparkSession, path: str) -> list[str]:
    """A list of words (stop words, say), separated by white space of any kind; meant for lists a driver can hold."""
    found = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).filter("w <> ''").distinct()
    return sorted(r["w"] for r in found.collect())


def doc_list(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id) of the lines `flag id` whose flag isn't 0."""
    parts = F.split("value", " ")
    return spark.read.text(path).filter(F.get(parts, 0) != "0").select(F.get(parts, 1).alias("doc_id")).filter("doc_id is not null")


def numbered_queries(spark: SparkSession, path: str, stop=None) -> DataFrame:
    """(query_id, query_text) from `number. text`, cleaned; of a repeated number the last line holds."""
    value = strip(F.col("value"))
    rows = _lines(spark, path).filter(value.contains("."))
    at = F.instr(value, ".")
    return _last(rows.select(F.substring(value, F.lit(1), at - 1).alias("query_id"), clean_text(F.substring(value, at + 1, F.length(value)), stop).alias("query_text"), "place"), "query_id")


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, place) of every line, blank ones included, without white space at the ends."""
    return _lines(spark, path).select(strip(F.col("value")).alias("line"), "place")


def _fields(spark: SparkSession, path: str, least: int) -> DataFrame:
    rows = _lines(spark, path).select(F.split(strip(F.col("value")), r"\s+").alias("f"), "place")
    return rows.filter(F.size("f") >= least)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade, num_rel): of a document judged twice the last grade holds, while num_rel sums all lines of its query."""
    rows = _fields(spark, path, 4).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].try_cast("double").alias("grade"), "place").filter("grade is not null")
    totals = rows.groupBy("query_id").agg(F.sum("grade").alias("num_rel"))
    return _last(rows, "query_id", "doc_id").join(totals, "query_id")


def qrels_stream(spark: SparkSession, path: str) -> DataFrame:
    """`qrels` of files in which line ends mean no more than blanks: every four words of a file are a judgement.

    Words are numbered by sums of the lines' sizes, within a block of a file and over its blocks, so no file is held whole.
    """
    found = F.filter(F.split("value", r"\s+"), lambda w: w != "")
    lines = _lines(spark, path).select(found.alias("w"), F.col("place.file_path").alias("file"), F.col("place.file_block_start").alias("block"), F.col("place.n").alias("n")).filter(F.size("w") > 0)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum(F.size("w")).alias("size")).withColumn("begins", F.coalesce(F.sum("size").over(before("file").orderBy("block")), F.lit(0)))
    blocks = blocks.select("file", "block", "begins", F.dense_rank().over(Window.orderBy("file")).alias("f"))  # one row for each block
    at = F.col("begins") + F.coalesce(F.sum(F.size("w")).over(before("f", "block").orderBy("n")), F.lit(0))
    cells = lines.join(F.broadcast(blocks), ["file", "block"]).select("f", at.alias("at"), "w").select("f", "at", F.posexplode("w").alias("i", "word"))
    cells = cells.select("f", F.expr("(at + i) div 4").alias("record"), ((F.col("at") + F.col("i")) % 4).alias("k"), "word")
    rows = cells.groupBy("f", "record").agg(*(F.max(F.when(F.col("k") == k, F.col("word"))).alias(c) for k, c in ((0, "query_id"), (2, "doc_id"), (3, "g"))))
    rows = rows.select("query_id", "doc_id", F.col("g").try_cast("double").alias("grade"), F.struct("f", "record").alias("place")).filter("grade is not null")
    return _last(rows, "query_id", "doc_id").join(rows.groupBy("query_id").agg(F.sum("grade").alias("num_rel")), "query_id")


def run(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): ranked by falling score and doc_id. `distinct` keeps the last line of a document instead of all."""
    rows = _fields(spark, path, 6).select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[4].try_cast("double").alias("score"), "place").filter("score is not null")
    rows = _last(rows, "query_id", "doc_id") if distinct else rows.drop("place")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def link_lists(spark: SparkSession, path: str) -> DataFrame:
    """(url, inlinks) from `url in1 in2 ...`; blank lines are skipped, of a repeated url the last line holds."""
    rows = _fields(spark, path, 1).filter("f[0] <> ''")
    return _last(rows.select(F.col("f")[0].alias("url"), F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))).alias("inlinks"), "place"), "url")


def assessments(spark: SparkSession, path: str) -> DataFrame:
    """The columns of an assessment file, as strings; a blank grade stays an empty string."""
    return spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").schema(ASSESSMENT).csv(path)


def link_table(spark: SparkSession, path: str) -> DataFrame:
    """(url, inlinks, outlinks) of a written crawl; rows without url are left out, missing arrays are empty."""
    none = F.array().cast("array<string>")
    rows = spark.read.parquet(path).filter("url is not null")
    return rows.select("url", *(F.coalesce(F.col(c) if c in rows.columns else none, none).alias(c) for c in ("inlinks", "outlinks")))


def scalars(spark: SparkSession, path: str) -> dict[str, int]:
    """A statistics file of `NAME = integer` lines."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(-?\d+)\s*$", 1).alias("k"), F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(-?\d+)\s*$", 2).alias("v"))
    return {r["k"]: int(r["v"]) for r in found.filter("k <> ''").collect()}
