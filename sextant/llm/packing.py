"""Lexical retrieval packing.

Texts are turned into subword ids once. Documents are dealt by content into shards of bounded size, each with its own
BM25 inverted index over those ids. For the dealing, a document gets two MinHash values of its pairs of adjacent ids and
two of its ids; documents are ordered by them, so that a document's copies follow it, near copies follow if their first
value agrees (with a chance of the share of pairs that they have in common), and documents that share rare phrases lie
together. Spark deals that order out in ranges, and every
task cuts its range into shards of at most SHARD_TOKENS ids as the rows come, where the first values change if it can:
memory is bounded by a shard (or one document, if it is longer), and a group of any number of copies goes to as many tasks
as it needs.

In a shard every window starts with a seed, the first unused document, and is filled greedily with the unused documents
that the index returns for all of the seed's ids; where it returns none, with the next unused ones. A document that
passes a window's end is cut there and goes on in the next window, as its seed. Only a shard's last window can be short.
A seed asks its own shard's index only: neighbours that were dealt to other shards are not seen.

Null text counts as empty: such a document is its end token alone. Rows that share a doc_id are separate documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, partitions, small_batches, tidy
from .tokens import Tokens, default_tokenizer
from .words import U, mix

WINDOW, END = 2048, 1
#: Ids of a shard at most, unless one document has more.
SHARD_TOKENS = 1 << 21
K1, B = 1.2, 0.75
#: Ids that at least one document in DENSE of a shard has are added up as whole rows of scores.
DENSE = 8


class Index:
    """BM25 over a shard of documents given as ids: postings by id, with scores ready to be added."""

    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        term = np.concatenate(words).astype(np.int64) if n else np.zeros(0, np.int64)
        most = int(term.max(initial=0)) + 1
        keys, tf = np.unique(np.repeat(np.arange(n), sizes) * most + term, return_counts=True)
        doc, term = np.divmod(keys, most)
        df = np.bincount(term, minlength=most)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(1.0, sizes.mean() if n else 1)))).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.n = n
        self.at = np.r_[0, np.cumsum(df)]
        self.doc, self.weight = doc[order], weight[order]
        self.own = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]
        self.term = term
        # a common id's scores as a row: all rows together have at most DENSE times the postings' numbers
        common = np.flatnonzero((df * DENSE >= n) & (df > 1))
        self.row = np.full(most, -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        at = self.row[term] >= 0
        self.rows[self.row[term[at]], doc[at]] = weight[at]
        self.alone = df < 2

    def neighbours(self, i: int) -> np.ndarray:
        """Documents that share an id with the seed, best first; ties by position."""
        own = self.term[self.own[i] : self.own[i + 1]]
        row = self.row[own]
        score = self.rows[row[row >= 0]].sum(0) if self.n else np.zeros(0, np.float32)
        rest = own[(row < 0) & ~self.alone[own]]
        if len(rest):
            first, size = self.at[rest], self.at[rest + 1] - self.at[rest]
            after = np.cumsum(size)
            at = np.repeat(first - (after - size), size) + np.arange(int(size.sum()))
            score = score + np.bincount(self.doc[at], self.weight[at], self.n)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(words: list[np.ndarray], lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, by sequence and offset."""
    if not words:
        return []
    index = Index(words)
    used = np.zeros(len(words), bool)
    pieces = []
    sequence = offset = first = 0
    seed, nearest, at = -1, np.zeros(0, np.int64), 0
    while True:
        i = -1
        if offset or seed >= 0:
            while at < len(nearest) and used[nearest[at]]:
                at += 1
            if at < len(nearest):
                i = int(nearest[at])
        if i < 0:
            while first < len(words) and used[first]:
                first += 1
            if first == len(words):
                break
            i = first
        used[i] = True
        if offset == 0 or seed < 0:
            seed, nearest, at = i, index.neighbours(i), 0
        start, total = 0, lengths[i]
        while start < total:
            n = min(total - start, window - offset)
            pieces.append((i, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset = sequence + 1, 0
                if start < total and seed != i:
                    seed, nearest, at = i, index.neighbours(i), 0
                elif start == total:
                    seed, nearest, at = -1, nearest[:0], 0
    return pieces


def _least(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least value of each run of `sizes` values; the greatest number for empty runs."""
    out = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.minimum.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _scattered(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint32(seed)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def order_keys(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that order documents by content: two MinHash values of a document's pairs of adjacent ids, then two of its ids."""
    flat = ids.astype(np.uint32)
    pairs = flat.copy()
    pairs[:-1] = flat[:-1] * np.uint32(0x27D4EB2F) + flat[1:] * np.uint32(0x165667B1)
    last = np.cumsum(sizes)[sizes > 0] - 1  # a document's last id has no pair
    found = []
    for values, seed in ((pairs, 0x1234567), (pairs, 0x2345678), (flat, 0x3456789), (flat, 0x4567891)):
        scattered = _scattered(values, seed)
        if values is pairs:
            scattered[last] = 0xFFFFFFFF
        found.append(_least(scattered, sizes))
    # least values of long documents are small: scattered again, they don't gather at one end of the order
    a, b, c, d = (mix(x.astype(U)) >> U(32) for x in found)
    return (a << U(32) | b).view(np.int64), (c << U(32) | d).view(np.int64)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, size, near, far, ids): each document's ids, two bytes each if the vocabulary allows, and its place in the order by content."""
    wide = "<u2" if Tokens.load(tokenizer).size <= 1 << 16 else "<u4"

    def run(batches):
        tokens = Tokens.load(tokenizer)
        for batch in batches:
            ids, sizes = tokens.encode(batch.column(1))
            near, far = order_keys(ids, sizes)
            raw = ids.astype(wide)
            at = np.r_[0, np.cumsum(sizes)] * raw.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(near), pa.array(far), packed], ["doc_id", "size", "near", "far", "ids"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, near long, far long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of (doc_id, text).

    Sequences are numbered by task, shard and place, with gaps between shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or default_tokenizer()
    wide = "<u2" if Tokens.load(path).size <= 1 << 16 else "<u4"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = hold(tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = held.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    tasks = max(min(partitions(spark), -(-total // (1 << 18))), -(-total // shard_tokens), 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(rows, base):
        ids = [np.frombuffer(x, wide) for _, x in rows]
        pieces = np.array(pack_shard(ids, [len(x) + 1 for x in ids], window), np.int64).reshape(-1, 5)
        whole = [np.append(x.astype("<u4"), np.uint32(END)) for x in ids]
        crc = [zlib.crc32(whole[d][s : s + n]) for d, s, n in pieces[:, :3].tolist()]
        lengths = np.array([len(x) for x in whole], np.int64)
        own = pa.array([rows[d][0] for d in pieces[:, 0].tolist()], pa.int64())
        columns = [own, pieces[:, 1], pieces[:, 2], np.array(crc, np.int64), lengths[pieces[:, 0]], base + pieces[:, 3], pieces[:, 4]]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    def run(batches):
        from pyspark import TaskContext

        base, shard = TaskContext.get().partitionId() << 40, 0
        rows, held, last = [], 0, None
        for batch in batches:
            for own, ids, *place in zip(*(batch.column(k).to_pylist() for k in range(4))):
                size = len(ids) // np.dtype(wide).itemsize + 1
                full = held / shard_tokens
                if rows and (held + size > shard_tokens or full > 0.8 and place[0] != last[0] or full > 0.9 and place != last):
                    yield packed(rows, base + (shard << 24))
                    rows, held, shard = [], 0, shard + 1
                last = place
                rows.append((own, ids))
                held += size
        if rows:
            yield packed(rows, base + (shard << 24))
        tidy()

    dealt = held.select("doc_id", "ids", "near", "far", "row").repartitionByRange(tasks, "near", "far", "row").sortWithinPartitions("near", "far", "row")
    return dealt.select("doc_id", "ids", "near", "far").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
