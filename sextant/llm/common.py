"""What the operators of this package share: reading, hashing folds, shared storage, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts are long, so the default of 10,000 would hold too much at once.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids hash as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one is made only in local mode, where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sextant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that `hold` has written and nobody has released.
_HELD: list[str] = []


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a cut of lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _HELD.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*held: DataFrame) -> None:
    """Delete what `hold` has written and no later step reads."""
    for df in held:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


def hold_only(make: Callable[[], DataFrame], name: str, *before: DataFrame) -> DataFrame:
    """`hold` what `make` gives, and release `before` and all that was held on the way."""
    first = len(_HELD)
    out = hold(made := make(), name)
    for folder in _HELD[first:-1]:
        _delete(made.sparkSession, folder)
    del _HELD[first:-1]
    release(*before)
    return out


def tidy() -> None:
    """Give a Python worker's unused memory back when its task ends: the next stage's workers share the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL(None).malloc_trim(0)


def hashed_share(column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the value and the seed only."""
    return (F.xxhash64(F.lit(seed), column).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, key: str, rows: int, seed: str) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of `key`: the same rows for the same table, without a sort or a single task."""
    total = df.count()
    return df if total <= rows else df.filter(hashed_share(F.col(key), seed) < rows / total)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most `rows` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


#: Parts into which a vector is cut to be summed by as many tasks.
CHUNKS = 64


def cut_vector(vector: np.ndarray) -> pd.DataFrame:
    """A vector as rows (chunk, part) for `sum_vectors`."""
    return pd.DataFrame([(k, vector[k::CHUNKS].astype(np.float64).tobytes()) for k in range(min(CHUNKS, len(vector)))], columns=["chunk", "part"])


def sum_vectors(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of vectors of `size` numbers, each given by `cut_vector`: every task adds up one part of all vectors as they come."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, part in zip(pdf["chunk"], pdf["part"]):
                found = np.frombuffer(part)
                sums[k] = sums[k] + found if k in sums else found
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["chunk", "part"])

    out = np.zeros(size)
    for r in parts.repartitionById(CHUNKS, F.col("chunk")).mapInPandas(total, "chunk int, part binary").collect():
        out[r["chunk"] :: CHUNKS] = np.frombuffer(r["part"])
    return out
