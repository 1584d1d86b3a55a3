"""Numbering rows in a total order without bringing them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, *keys: Column | str, start: int = 0) -> DataFrame:
    """The rows with `name`: their place, from `start`, in the order of `keys`, which should tell all rows apart.

    Rows are dealt into ranges of the keys; each range is numbered by itself, and one count for each range gives the offsets.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *keys).withColumn("part__", F.spark_partition_id()).persist()
    sizes = {r["part__"]: r["count"] for r in parts.groupBy("part__").count().collect()}
    firsts, total = [], start
    for p in sorted(sizes):
        firsts.append((p, total))
        total += sizes[p]
    offsets = spark.createDataFrame(firsts, "part__ int, first__ long")
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*keys)) - 1
    return parts.withColumn("own__", own).join(F.broadcast(offsets), "part__").withColumn(name, F.col("first__") + F.col("own__")).drop("part__", "first__", "own__")
