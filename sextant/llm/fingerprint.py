"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line) hashes to a wide vector: eight words of 64 bits from SHA-512, and 128 words of 32 bits that count
the paragraph's signed byte windows. A document's fingerprint is the sum of its paragraphs' vectors, modulo 2**64 and
2**32. Order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector.
The first part decides equality; the angle of the second estimates how much two texts share.

Null and empty text have the zero fingerprint. Equal texts have equal fingerprints, as have texts that differ only in
the order of their lines.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches

WIDE, LANES, WINDOW = 8, 128, 14
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_MASK64, _MASK32 = (1 << 64) - 1, (1 << 32) - 1


class Fingerprint:
    """An additive fingerprint: `whole` for equality, `lanes` for likeness."""

    __slots__ = ("lanes", "whole")

    def __init__(self, whole=(0,) * WIDE, lanes=None):
        self.whole, self.lanes = whole, np.zeros(LANES, np.int64) if lanes is None else lanes

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        if not text:
            return cls()
        parts = text.encode("utf-8", "surrogatepass").split(b"\n")
        sums = [0] * WIDE
        for p in parts:
            for i, x in enumerate(struct.unpack("<8Q", hashlib.sha512(p).digest())):
                sums[i] += x
        gap = b"\0" * (WINDOW - 1)
        data = gap.join(parts) + gap
        n = len(data) - WINDOW + 1
        if n <= 0:
            return cls(tuple(x & _MASK64 for x in sums))
        at = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        x = at[:n] * _A
        x ^= at[WINDOW - 8 : WINDOW - 8 + n] * _B
        x ^= x >> np.uint64(29)
        x *= _C
        x >>= np.uint64(56)
        counts = np.bincount(x[np.frombuffer(data, np.uint8, n) != 0].astype(np.int64), minlength=2 * LANES)
        return cls(tuple(x & _MASK64 for x in sums), counts[0::2] - counts[1::2])

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(tuple((a + b) & _MASK64 for a, b in zip(self.whole, other.whole)), self.lanes + other.lanes)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(tuple((a - b) & _MASK64 for a, b in zip(self.whole, other.whole)), self.lanes - other.lanes)

    def hex(self) -> str:
        return struct.pack("<8Q", *self.whole).hex() + (self.lanes & _MASK32).astype("<u4").tobytes().hex()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = bytes.fromhex(text)
        return cls(struct.unpack("<8Q", raw[: 8 * WIDE]), np.frombuffer(raw[8 * WIDE :], "<i4").astype(np.int64))

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal multisets; else the cosine of the lanes, at least 0."""
        if self.whole == other.whole:
            return 1.0
        a, b = self.lanes.astype(float), other.lanes.astype(float)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["t"]]
            yield pd.DataFrame({"i": pdf["i"], "n": [len(t) for t in texts], "f": [Fingerprint.of(t).hex() for t in texts]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, f"i {kind}, n long, f string").toDF(id_col, "n_chars", "fingerprint")


_LOW = -(1 << 63)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """For each of (doc_id, text) the fingerprint, the edited text's, and the likeness to both it and the next document.

    Rows are dealt into ranges of doc_id, so a text is shuffled once, compressed. The first row of a range goes as a
    sentinel to the range before it (the first of all to the last), which makes each range complete in itself. Null
    doc_ids come first; rows with the same doc_id follow each other by a hash of the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("i"), F.col("text").alias("t"))
    n = partitions(spark)
    cuts = np.unique(np.array(docs.approxQuantile("i", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else [], float))

    def first_of(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": np.searchsorted(cuts, pdf["i"].astype(float), "right"), "i": pdf["i"]}).groupby("p", as_index=False).min()

    firsts = dict(docs.select("i").mapInPandas(first_of, "p int, i long").groupBy("p").agg(F.min("i")).collect())  # one row for each range
    order = sorted(firsts)
    before = {p: order[k - 1] for k, p in enumerate(order)}

    def deal(batches):
        press = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in pdf["t"]]
            p = np.searchsorted(cuts, pdf["i"].astype(float), "right").astype(np.int32)
            out = pd.DataFrame({"p": p, "s": 0, "i": pdf["i"], "h": [hashlib.md5(t).digest()[:8] for t in texts], "z": [press.compress(t) for t in texts]})
            yield out
            lead = out[[firsts.get(a) == b for a, b in zip(p, pdf["i"])]]
            if len(lead):
                yield lead.assign(p=[before[x] for x in lead["p"]], s=1)

    def edited(text: str, following: str) -> str:
        k = len(text) // 4
        return text[: len(text) - k] + following[:k]

    def walk(batches):
        plain = zstandard.ZstdDecompressor()
        last, done = None, False
        for pdf in batches:
            rows = []
            for s, i, z in zip(pdf["s"], pdf["i"], pdf["z"]):
                if done:
                    break
                text = plain.decompress(z).decode("utf-8", "surrogatepass")
                now = (i, text, Fingerprint.of(text))
                if last is not None:
                    a, t, f = last
                    e = edited(t, text)
                    g = Fingerprint.of(e)
                    rows.append((None if a == _LOW else a, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f.hex(), g.hex(), f.likeness(g), f.likeness(now[2])))
                last, done = now, s == 1
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    dealt = docs.mapInPandas(deal, "p int, s int, i long, h binary, z binary")
    return (
        dealt.repartitionById(max(n, len(cuts) + 1), F.col("p"))
        .sortWithinPartitions("s", "i", "h")
        .mapInPandas(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
