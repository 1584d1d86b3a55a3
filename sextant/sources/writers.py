"""Writers: runs, judgements, scores, statistics, and tables that are merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_lines(ranked: DataFrame, tag: str = "Exp") -> DataFrame:
    """(value) `query Q0 doc rank score tag` from (query_id, doc_id, rank, score)."""
    text = [F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(tag)]
    return ranked.select(F.concat_ws(" ", *text).alias("value"))


def with_docnos(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """Dense ids in a ranking replaced by the names of (doc_id, docno); unknown ids go."""
    return ranked.join(names.select("doc_id", "docno"), "doc_id").withColumn("doc_id", F.col("docno")).drop("docno")


def write_run(ranked: DataFrame, path: str, tag: str = "Exp", mode: str = "append") -> None:
    """Run lines in order of query and rank within each file."""
    ranked.repartition("query_id").sortWithinPartitions("query_id", "rank").transform(run_lines, tag).write.mode(mode).text(path)


def ranked_without_blanks(scored: DataFrame, k: int = 1000) -> DataFrame:
    """Rank by falling score and doc_id over the ids without a space."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.filter(~F.col("doc_id").cast("string").contains(" ")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def qrels_lines(assessed: DataFrame) -> DataFrame:
    """(value) `query assessor doc grade` from an assessment table; a blank grade leaves three fields and a blank."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return assessed.select(F.concat_ws(" ", cell("QueryID"), cell("AssessorID"), cell("DocID"), F.trim(cell("Grade"))).alias("value"))


def write_qrels(assessed: DataFrame, path: str, mode: str = "overwrite") -> None:
    qrels_lines(assessed).write.mode(mode).text(path)


def assessments_of(qrels: DataFrame) -> DataFrame:
    """The inverse of `qrels_lines`, from (query_id, assessor, doc_id, grade)."""
    return qrels.select(F.col("query_id").alias("QueryID"), F.col("assessor").alias("AssessorID"), F.col("doc_id").alias("DocID"), F.lit("").alias("Auto Grade"), F.col("grade").cast("string").alias("Grade"))


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """`url<TAB>score` lines from (url, score)."""
    scores.select("url", "score").write.mode(mode).option("sep", "\t").csv(path)


def write_scalars(spark: SparkSession, values: dict[str, int], path: str) -> None:
    """`NAME = integer` lines."""
    spark.createDataFrame([(f"{k} = {v}",) for k, v in values.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_batches(df: DataFrame, path: str, batches: int = 12) -> None:
    """Append in so many equal batches, written in parallel; fewer rows make fewer batches."""
    df.repartition(batches).write.mode("append").parquet(path)


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table of the given schema, in place of what is there."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a table; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replace(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table that `df` may have been read from: written beside it, then put in its place.

    The old table is moved aside first and deleted last, so at every moment one whole table is there under `path`, or
    under `path`.old if the move was cut off.
    """
    space = spark._jvm.org.apache.hadoop.fs
    new, old, aside = (space.Path(p) for p in (f"{path}.new", path, f"{path}.old"))
    store = old.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    if store.exists(old):
        store.delete(aside, True)
        if not store.rename(old, aside):
            raise OSError(f"{path} can't be moved")
    if not store.rename(new, old):
        raise OSError(f"{path}.new can't be moved")
    store.delete(aside, True)
    spark.catalog.refreshByPath(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
