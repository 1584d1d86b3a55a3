"""Evaluation of ranked runs against relevance judgements, as windows and conditional sums.

Two conventions are offered. `graded`: ties by rising doc_id, every retrieved document counts, average precision doesn't
multiply by the grade. `trec`: ties by falling doc_id, at most 1000 documents, average precision does multiply. Grades
are summed, so precision can exceed 1. Queries without relevant documents are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS, TREC_CUTS, DEPTH = (5, 10, 20, 50, 100), (5, 10, 15, 20, 30, 100, 200, 500, 1000), 1000
LEVELS = tuple(x / 10 for x in range(11))


def totals(qrels: DataFrame) -> DataFrame:
    """(query_id, num_rel): the sum of grades, of queries where it isn't 0. A `num_rel` column, which counts repeated lines, comes first."""
    total = F.max("num_rel") if "num_rel" in qrels.columns else F.sum("grade")
    return qrels.groupBy("query_id").agg(total.cast("double").alias("num_rel")).filter("num_rel <> 0")


def judged(run: DataFrame, qrels: DataFrame, trec: bool = False) -> DataFrame:
    """The run's rows with rank, rel, num_rel, rel_before and rel_ret: the grades before and up to each rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id") if trec else F.asc("doc_id"))
    ranked = run.select("query_id", "doc_id", "score").withColumn("rank", F.row_number().over(order))
    if trec:
        ranked = ranked.filter(F.col("rank") <= DEPTH)
    rows = ranked.join(totals(qrels), "query_id").join(qrels.select("query_id", "doc_id", F.col("grade").cast("double").alias("grade")), ["query_id", "doc_id"], "left")
    rows = rows.withColumn("rel", F.coalesce("grade", F.lit(0.0))).drop("grade")
    so_far = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("rel_ret", F.sum("rel").over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.withColumn("rel_before", F.col("rel_ret") - F.col("rel"))


def _within(k) -> Column:
    """Sum of the grades down to rank k, whether or not so many were retrieved."""
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0.0))


def at_cuts(rows: DataFrame, cuts: Iterable[int] = CUTS) -> DataFrame:
    """(query_id, k, precision, recall, f1)."""
    cuts = list(cuts)
    sums = rows.groupBy("query_id").agg(F.max("num_rel").alias("num_rel"), F.array(*(F.struct(F.lit(k).alias("k"), _within(k).alias("r")) for k in cuts)).alias("all"))
    each = sums.select("query_id", "num_rel", F.inline("all"))
    p, r = F.col("r") / F.col("k"), F.col("r") / F.col("num_rel")
    return each.select("query_id", "k", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def average_precision(rows: DataFrame, trec: bool = False) -> DataFrame:
    """(query_id, average_precision)."""
    gain = F.when(F.col("rel") > 0, (F.col("rel_before") + 1) / F.col("rank") * (F.col("rel") if trec else F.lit(1.0))).otherwise(0.0)
    return rows.groupBy("query_id").agg((F.sum(gain) / F.max("num_rel")).alias("average_precision"))


def r_precision(rows: DataFrame) -> DataFrame:
    """(query_id, r_precision): precision at as many documents as are relevant, between two ranks if that is a fraction."""
    whole = F.floor("num_rel")
    sums = rows.groupBy("query_id").agg(
        F.max("num_rel").alias("num_rel"), F.max("rank").alias("retrieved"), F.sum("rel").alias("all"), _within(whole).alias("low"), _within(whole + 1).alias("high")
    )
    share = F.col("num_rel") - whole
    low, high = F.coalesce(F.try_divide(F.col("low"), whole.cast("double")), F.lit(0.0)), F.col("high") / (whole + 1)
    value = F.when(F.col("num_rel") > F.col("retrieved"), F.col("all") / F.col("num_rel")).otherwise((1 - share) * low + share * high)
    return sums.select("query_id", value.alias("r_precision"))


def interpolated(rows: DataFrame, levels: Iterable[float] = LEVELS) -> DataFrame:
    """(query_id, level, precision): the best precision from the first rank on that reaches each recall level; 0 if none does."""
    below = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    best = rows.withColumn("best", F.max(F.col("rel_ret") / F.col("rank")).over(below)).withColumn("recall", F.col("rel_ret") / F.col("num_rel"))
    found = [F.struct(F.lit(x).alias("level"), F.coalesce(F.max(F.when(F.col("recall") >= x, F.col("best"))), F.lit(0.0)).alias("precision")) for x in levels]
    return best.groupBy("query_id").agg(F.array(*found).alias("all")).select("query_id", F.inline("all"))


def _dcg(rank: Column, rel: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)).otherwise(0.0))


def ndcg(rows: DataFrame, qrels: DataFrame, cuts: Iterable[int] = CUTS) -> DataFrame:
    """(query_id, k, ndcg): against the best order of all judged documents; 0 if nothing is relevant."""
    cuts = list(cuts)
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).filter(F.col("place") <= max(cuts))
    ideal = best.groupBy("query_id").agg(F.array(*(F.struct(F.lit(k).alias("k"), _dcg(F.col("place"), F.col("grade").cast("double"), k).alias("ideal")) for k in cuts)).alias("all"))
    own = rows.groupBy("query_id").agg(F.array(*(F.struct(F.lit(k).alias("k"), _dcg(F.col("rank"), F.col("rel"), k).alias("dcg")) for k in cuts)).alias("all"))
    both = own.select("query_id", F.inline("all")).join(ideal.select("query_id", F.inline("all")), ["query_id", "k"])
    return both.select("query_id", "k", F.coalesce(F.try_divide("dcg", "ideal"), F.lit(0.0)).alias("ndcg"))


def metrics(run: DataFrame, qrels: DataFrame, trec: bool = False, cuts: Iterable[int] | None = None) -> DataFrame:
    """(query_id, metric, k, value) of all metrics; k is -1 where a metric has none, and recall levels are tenths."""
    rows = judged(run, qrels, trec).persist()
    cuts = cuts or (TREC_CUTS if trec else CUTS)
    row = lambda m, k, v: [F.col("query_id"), F.lit(m).alias("metric"), F.lit(k).alias("k") if isinstance(k, int) else k.cast("int").alias("k"), F.col(v).alias("value")]
    at = at_cuts(rows, cuts)
    out = [average_precision(rows, trec).select(*row("average_precision", -1, "average_precision")), r_precision(rows).select(*row("r_precision", -1, "r_precision"))]
    out += [at.select(*row(m, F.col("k"), m)) for m in ("precision", "recall", "f1")]
    out.append(ndcg(rows, qrels, cuts).select(*row("ndcg", F.col("k"), "ndcg")))
    if trec:
        out.append(interpolated(rows).select(*row("interpolated", F.round(F.col("level") * 10), "precision")))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def macro(measured: DataFrame) -> DataFrame:
    """(metric, k, value, queries): means over queries."""
    return measured.groupBy("metric", "k").agg(F.avg("value").alias("value"), F.count("*").alias("queries"))


def counts(run: DataFrame, qrels: DataFrame, trec: bool = False) -> DataFrame:
    """One row: queries, retrieved, relevant and relevant retrieved documents."""
    each = judged(run, qrels, trec).groupBy("query_id").agg(F.count("*").alias("retrieved"), F.max("num_rel").alias("relevant"), F.sum("rel").alias("rel_ret"))
    return each.agg(F.count("*").alias("queries"), F.sum("retrieved").alias("retrieved"), F.sum("relevant").alias("relevant"), F.sum("rel_ret").alias("rel_ret"))


def report(measured: DataFrame, digits: int = 4) -> DataFrame:
    """(query_id, line): one printable line for each metric, the means under `all`."""
    every = measured.unionByName(macro(measured).select(F.lit("all").alias("query_id"), "metric", "k", "value")) if dict(measured.dtypes)["query_id"] == "string" else measured.withColumn("query_id", F.col("query_id").cast("string")).unionByName(macro(measured).select(F.lit("all").alias("query_id"), "metric", "k", "value"))
    name = F.when(F.col("k") < 0, F.col("metric")).otherwise(F.concat(F.col("metric"), F.lit("@"), F.col("k").cast("string")))
    return every.select("query_id", F.format_string(f"%-24s %.{digits}f", name, F.col("value")).alias("line"))
