"""Streams: documents into an index, pages into a merged table, URLs without repeats, and a politeness timer for each domain."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import index, upsert
from ..sources.writers import exists


def index_stream(docs: DataFrame, folder: str, checkpoint: str, stop: Iterable[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Append the postings and document lengths of each batch of (doc_id, text) under the batch's own folder, which a repeated batch replaces."""
    stop = list(stop or ())

    def add(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        posts = index.postings_of(batch, stop)
        posts.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        index.doc_stats(batch, stop).write.mode("overwrite").parquet(f"{folder}/docs/batch={number}")
        batch.unpersist()

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streamed_index(spark: SparkSession, folder: str) -> index.Index:
    """The index of all batches so far. Statistics are sums over batches, which is all that merging takes."""
    posts = spark.read.parquet(f"{folder}/postings").drop("batch")
    return index.Index(posts, index.term_stats(posts), spark.read.parquet(f"{folder}/docs").drop("batch"), index.corpus_stats(posts))


#: Parts of a merged table, by a hash of the url.
PARTS = 64


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions of a merged table, newest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [f.getPath().getName() for f in store.listStatus(root)]
    done = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return sorted(done, reverse=True)


def _folders(spark: SparkSession, path: str, version: int) -> dict[int, str]:
    """Where each part of a version is."""
    return {r["part"]: f"{path}/{r['folder']}" for r in spark.read.schema("part int, folder string").parquet(f"{path}/version={version}").collect()}


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table that `upsert_stream` merges."""
    found = _versions(spark, path)
    folders = sorted(_folders(spark, path, found[0]).values()) if found else []
    return spark.read.schema(upsert.CRAWL).parquet(*folders) if folders else spark.createDataFrame([], upsert.CRAWL)


def upsert_stream(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merge each batch of crawl documents into a table by url; doing a batch twice changes nothing.

    A batch rewrites the parts its urls belong to, in a folder of its own, and then writes a version that names the folder
    of each part: readers see the version before or after, never one in between. Folders of older versions stay until
    `vacuum`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, path)
        if found and found[0] >= number:
            return
        none = spark.createDataFrame([], upsert.CRAWL)
        folders = _folders(spark, path, found[0]) if found else {}
        part = F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")
        batch = batch.select(*none.columns).filter("url is not null").persist()
        touched = [r["part"] for r in batch.select(part.alias("part")).distinct().collect()]  # at most PARTS
        known = sorted(folders[k] for k in touched if k in folders)
        stored = spark.read.schema(upsert.CRAWL).parquet(*known) if known else none
        fresh = upsert.pages(upsert.pages(none, stored), batch).withColumn("part", part)
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")
        folders = {k: v.removeprefix(f"{path}/") for k, v in folders.items()} | {k: f"batch={number}/part={k}" for k in touched}
        spark.createDataFrame(sorted(folders.items()), "part int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")
        batch.unpersist()

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def vacuum(spark: SparkSession, path: str) -> None:
    """Delete what the newest version of a merged table doesn't need. Readers of older versions must be done."""
    found = _versions(spark, path)
    if not found:
        return
    kept = {*_folders(spark, path, found[0]).values(), f"{path}/version={found[0]}"}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for top in store.listStatus(root):
        name = top.getPath().getName()
        if name.startswith("version=") and f"{path}/{name}" not in kept:
            store.delete(top.getPath(), True)
        elif name.startswith("batch="):
            for sub in store.listStatus(top.getPath()):
                if sub.getPath().getName().startswith("part=") and f"{path}/{name}/{sub.getPath().getName()}" not in kept:
                    store.delete(sub.getPath(), True)


def unvisited(urls: DataFrame, at: str | None = None, horizon: str = "7 days") -> DataFrame:
    """Each url once. With an event time, urls are remembered for the horizon, which bounds the state."""
    return urls.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["url"]) if at else urls.dropDuplicates(["url"])


def politeness_stream(requests: DataFrame, delay: float = 1.0, late: str = "1 hour") -> DataFrame:
    """(domain, at, wait) of a stream of (domain, at): the state of a domain is the time of its last request.

    Requests later than `late` behind the newest one are dropped, and a domain's state goes once the watermark has
    passed its last request by more than the delay, when no wait can come of it any more.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("at")
        waits = []
        for t in rows["at"]:
            now = int(t.timestamp() * 1_000_000)
            waits.append(0.0 if last is None else max(0.0, delay - (now - last) / 1e6))
            last = now if last is None else max(now, last)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(last // 1000 + int(delay * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"domain": key[0], "at": rows["at"], "wait": waits})

    kept = requests.select("domain", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return kept.groupBy("domain").applyInPandasWithState(run, "domain string, at timestamp, wait double", "last long", "append", GroupStateTimeout.EventTimeTimeout)
