"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages. A distributed randomised SVD of their TF-IDF matrix (document frequencies come
from all documents) gives a latent space of at most RANK dimensions. Every document is folded into it in overlapping
passages, and passages whose cosine to a benchmark passage reaches COSINE are candidates. So is, whatever its cosine,
each place where a document has a run of RUN words of a benchmark passage (every RUN-th word begins one, and the last
RUN words are one), so no passage that is there word for word depends on the cosine. A candidate is a leak if the
longest common subsequence of words covers VERBATIM of the benchmark passage, or PARAPHRASE of it with ANSWER_SHARE of the words of the
answer present: the item's `answer` where the table has such a column, else its most informative words, those that occur
in any document first (a word that a paraphrase has replaced may be rare just because of that).

Words are cut at white space and compared lower-cased, letters and digits only, by 64-bit hashes; each word of the
benchmark has a row of its own. Words in more than COMMON of all documents carry no weight in the latent space, unless a
benchmark passage has fewer than RARE others. Texts are cut into words once: the rows of the benchmark's words are written
to the shared folder, two or four bytes a word, and counted and searched from there. Memory grows with the benchmark's
words (one row of the latent space each), not with the documents; passages are searched in blocks of at most about BLOCK.

Null and empty texts and passages of fewer than MIN_WORDS words match nothing; an empty benchmark matches nothing. Equal
items are all reported; rows that share a doc_id are each searched, and a document is reported once for each item.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut_vector, hold, release, small_batches, sum_vectors, tidy
from .words import BLANKS, LOWER, Table, U, content, hashes, spans

RANK, OVERSAMPLE, POWER = 128, 16, 2
PASSAGE, HALF, MIN_WORDS, RUN = 64, 32, 5, 5
COMMON, RARE = 0.1, 5
COSINE, VERBATIM, PARAPHRASE, ANSWER_WORDS, ANSWER_SHARE = 0.4, 0.75, 0.5, 5, 0.4
BLOCK = 2048
#: Words whose vectors are gathered at once.
GATHER = 30_000


#: ASCII letters and digits, blanks, and all bytes of other characters.
_KEEP = BLANKS.copy()
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: White space beyond ASCII, and the first bytes it has in UTF-8.
_SPACES, _SPACE_LEADS = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def word_keys(column, learned: Table, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of a string column, and how many each text has; 0 stands for words without letters and digits.

    ASCII words are reduced and hashed on their bytes. For others `learned` has places in keys[0], which grows.
    """
    data, at = content(column)
    if len(data) and _SPACE_LEADS[data].any():
        data, at = content(pc.replace_substring_regex(column, _SPACES, " "))
    keep = _KEEP[data]
    at = np.r_[0, np.cumsum(keep)][at]
    low = LOWER[data[keep]]
    begins, ends = spans(BLANKS[low], at)
    found = hashes(low, begins, ends)
    wide = np.unique(np.searchsorted(begins, np.flatnonzero(low >= 128), "right") - 1)
    if len(wide):
        own = found[wide]
        place = learned.find(own)
        _, one = np.unique(own[place < 0], return_index=True)
        one = np.flatnonzero(place < 0)[one]
        if len(one):
            raw = low.tobytes()
            pairs = zip(begins[wide[one]].tolist(), ends[wide[one]].tolist())
            reduced = ["".join(filter(str.isalnum, raw[x:y].decode("utf-8", "replace").lower())).encode() for x, y in pairs]
            sizes = np.cumsum([len(x) for x in reduced])
            new = hashes(np.frombuffer(b"".join(reduced), np.uint8), np.r_[0, sizes[:-1]], sizes)
            new[np.diff(sizes, prepend=0) == 0] = 0
            order = np.argsort(own[one])
            known, values = own[one][order], new[order]
            if len(one) <= learned.left:
                learned.add(known, (len(keys[0]) + np.arange(len(known))).astype(np.int32))
                keys[0] = np.concatenate([keys[0], values])
            fresh = place < 0
            out = np.zeros(len(own), U)
            out[~fresh] = keys[0][place[~fresh]]
            out[fresh] = values[np.searchsorted(known, own[fresh])]
        else:
            out = keys[0][place]
        found[wide] = out
    return found, np.diff(np.searchsorted(begins, at))


def item_keys(text: str | None) -> np.ndarray:
    """The keys of a text's words."""
    found = word_keys(pa.array([text or ""]), Table(8), [np.zeros(0, U)])[0]
    return found[found != 0]


def cut(n: int) -> list[tuple[int, int]]:
    """Overlapping spans of at most PASSAGE words that cover n words."""
    if n <= PASSAGE:
        return [(0, n)]
    return [(a, a + PASSAGE) for a in [*range(0, n - PASSAGE, HALF), n - PASSAGE]]


def passages(benchmark: DataFrame) -> DataFrame:
    """(item_id, part, words, answer): the keys of every benchmark passage of MIN_WORDS words or more, as binary."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")

    def run(batches):
        for pdf in batches:
            rows = []
            for i, text, a in zip(pdf["item_id"].astype("Int64"), pdf["text"], pdf["answer"]):
                words = item_keys(text)
                own = np.unique(item_keys(a)).tobytes()
                rows += [(i, k, words[s:e].tobytes(), own) for k, (s, e) in enumerate(cut(len(words))) if e - s >= MIN_WORDS]
            yield pd.DataFrame(rows, columns=["item_id", "part", "words", "answer"]).astype({"item_id": "Int64"})

    kept = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))
    return kept.mapInPandas(run, "item_id long, part int, words binary, answer binary")


def vocabulary(items: DataFrame) -> np.ndarray:
    """Sorted keys of the words of any passage: a word's place here is its row."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": np.unique(np.concatenate([np.frombuffer(x, U) for x in [*pdf["words"], *pdf["answer"]]])).view(np.int64)})

    return np.sort(np.array([r["key"] for r in items.mapInPandas(run, "key long").distinct().collect()], np.int64).view(U))


def _width(size: int) -> type:
    return np.uint16 if size < 1 << 16 else np.uint32


class _Rows:
    """What a worker has for one vocabulary: the rows of its words, and what it has learned about words beyond ASCII."""

    _own: dict[bytes, _Rows] = {}

    def __init__(self, words: np.ndarray):
        self.table = Table(max(8, int(len(words)).bit_length() + 2))
        self.table.add(words, np.arange(len(words), dtype=np.int32))
        self.other = len(words)
        self.learned, self.keys = Table(19), [np.zeros(0, U)]

    @classmethod
    def of(cls, words: np.ndarray) -> _Rows:
        """Tasks of a worker share what they learn."""
        key = words.tobytes()
        if key not in cls._own:
            cls._own.clear()
            cls._own[key] = cls(words)
        return cls._own[key]

    def read(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words of a string column, `other` for words of no passage, and how many each text has."""
        keys, count = word_keys(column, self.learned, self.keys)
        rows = self.table.find(keys)
        rows[rows < 0] = self.other
        kept = keys != 0
        if kept.all():
            return rows, count
        return rows[kept], np.diff(np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(count)]])


def read(docs: DataFrame, words: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, by position as c0, c1 ..., and `words`: the benchmark's rows in the text. Written to the shared folder."""
    small_batches(docs.sparkSession)
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col("text").alias("text__"))
    schema = StructType([*rows.schema.fields[:-1], StructField("words", BinaryType())])
    sent = docs.sparkSession.sparkContext.broadcast(words)
    kind = _width(len(words) + 1)

    def run(batches):
        own = _Rows.of(sent.value)
        for batch in batches:
            found, count = own.read(batch.column(len(keep)))
            raw = found.astype(kind)
            at = np.r_[0, np.cumsum(count)] * raw.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], schema.names)
        tidy()

    return hold(rows.mapInArrow(run, schema), "words")


def _flat(column, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all read texts, one after the other, and the texts' lengths."""
    data, at = content(column)
    return np.frombuffer(data.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize


def document_frequencies(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many of the read documents each of `size` rows occurs, and the number of documents."""
    kind = _width(size + 1)

    def run(batches):
        counts = np.zeros(size, np.int64)
        n = 0
        for batch in batches:
            rows, lengths = _flat(batch.column(0), kind)
            n += len(lengths)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            known = rows < size
            counts += np.bincount(np.unique(owner[known] * size + rows[known]) % max(1, size), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], n), pa.int64())], ["row", "n"])
        tidy()

    found = docs.select("words").mapInArrow(run, "row int, n long").groupBy("row").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size)
    for r in found:
        if r["row"] >= 0:
            out[r["row"]] = r["n"]
    return out, sum(r["n"] for r in found if r["row"] < 0)


def _at(words: np.ndarray, keys: bytes) -> np.ndarray:
    """Rows of the words of a passage."""
    return np.searchsorted(words, np.frombuffer(keys, U))


def weights_of(items: DataFrame, words: np.ndarray, idf: np.ndarray, common: np.ndarray) -> np.ndarray:
    """idf, but 0 for common words that no passage needs."""

    def run(batches):
        words, common = sent.value
        needed = np.zeros(len(common), bool)
        for pdf in batches:
            for x in pdf["words"]:
                at = np.unique(_at(words, x))
                if (~common[at]).sum() < RARE:
                    needed[at] = True
        yield pd.DataFrame({"row": np.flatnonzero(needed)})

    sent = items.sparkSession.sparkContext.broadcast((words, common))
    needed = [r["row"] for r in items.mapInPandas(run, "row int").distinct().collect()]
    out = np.where(common, 0.0, idf)
    out[needed] = idf[needed]
    return out


def _gram(items: DataFrame, words: np.ndarray, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A' A x for the TF-IDF matrix A of all passages (rows of length 1): the partitions' partial products are summed in parallel."""
    sent = items.sparkSession.sparkContext.broadcast((words, idf, x))

    def product(batches):
        words, idf, x = sent.value
        out = np.zeros(x.shape)
        for pdf in batches:
            for own in pdf["words"]:
                at, tf = np.unique(_at(words, own), return_counts=True)
                a = tf * idf[at]
                norm = float(np.sqrt(a @ a))
                if norm:
                    a /= norm
                    out[at] += a[:, None] * (a @ x[at])
        yield cut_vector(out.ravel())

    return sum_vectors(items.select("words").mapInPandas(product, "chunk int, part binary"), x.size).reshape(x.shape)


def latent_space(items: DataFrame, words: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (one row for each word) by a randomised range finder with power iterations."""
    rank = min(rank, len(words))
    width = min(rank + OVERSAMPLE, len(words))
    q = np.linalg.qr(np.random.default_rng(8).standard_normal((len(words), width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(_gram(items, words, idf, q))[0]
    values, vectors = np.linalg.eigh(q.T @ _gram(items, words, idf, q))
    return (q @ vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a passage, given as bit masks of its words' places, and `words`."""
    full = open_ = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = open_ & m
            open_ = ((open_ + u) | (open_ - u)) & full
    return size - open_.bit_count()


def runs(rows: np.ndarray) -> np.ndarray:
    """A hash of the RUN rows that begin at each place, as far as there are so many."""
    x = np.zeros(max(0, len(rows) - RUN + 1), np.uint64)
    for k in range(RUN):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + rows[k : k + len(x)].astype(np.uint64) + np.uint64(1)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


@dataclass
class Model:
    """What the search of one block of passages needs."""

    weights: np.ndarray  # idf times the singular vectors
    heavy: np.ndarray  # whether a row has weight; the last place stands for words of no passage
    items: list
    vectors: np.ndarray
    masks: list
    sizes: list
    answers: list
    distinct: list  # words of each passage, and how many of its places repeat one
    spare: list
    runs: np.ndarray  # hashes of the passages' runs, sorted, with the passage and the place in it
    run_of: np.ndarray
    run_at: np.ndarray
    begins: np.ndarray  # whether a run's hash begins with these 16 bits

    @classmethod
    def of(cls, found: list, words: np.ndarray, idf: np.ndarray, gain: np.ndarray, space: np.ndarray, seen: np.ndarray) -> Model:
        weights = (space * gain[:, None]).astype(np.float32)
        heavy = np.zeros(len(gain) + 1, bool)
        heavy[: len(gain)] = gain > 0
        items, vectors, masks, sizes, answers, keys = [], [], [], [], [], []
        for r in found:
            at = _at(words, r["words"])
            own: dict[int, int] = {}
            for k, x in enumerate(at.tolist()):
                own[x] = own.get(x, 0) | 1 << k
            answer = set(_at(words, r["answer"]).tolist())
            hashes = runs(at).tolist()
            keys += [(hashes[k], len(items), k) for k in sorted({*range(0, len(hashes), RUN), len(hashes) - 1})]
            items.append(r["item_id"])
            vectors.append(weights[at].sum(0))
            masks.append(own)
            sizes.append(len(at))
            answers.append(answer or set(sorted(own, key=lambda x: (not seen[x], -idf[x], x))[:ANSWER_WORDS]))
        v = np.array(vectors, np.float32).reshape(len(found), -1)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        keys.sort()
        hashes, run_of, run_at = (np.array([k[c] for k in keys], t) for c, t in ((0, np.uint64), (1, np.int64), (2, np.int64)))
        begins = np.zeros(1 << 16, bool)
        begins[hashes >> np.uint64(48)] = True
        return cls(weights, heavy, items, v / np.where(norm > 0, norm, 1), masks, sizes, answers, [set(x) for x in masks], [n - len(x) for n, x in zip(sizes, masks)], hashes, run_of, run_at, begins)

    def folded(self, rows: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
        """Sum of the words' vectors in each of `parts`, for words in order of their part."""
        out = np.zeros((parts, self.weights.shape[1]), np.float32)
        known = np.flatnonzero(self.heavy[rows])
        at, part = rows[known], part[known]
        for a in range(0, len(at), GATHER):
            own = part[a : a + GATHER]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[starts]] += np.add.reduceat(self.weights[at[a : a + GATHER]], starts, axis=0)
        return out

    def search(self, column) -> list[dict[int, tuple[float, float, float]]]:
        """For each read text its leaks: passage number -> (share of the subsequence, share of the answer, cosine)."""
        rows, lengths = _flat(column, _width(len(self.heavy)))
        halves = -(-lengths // HALF)
        first = np.r_[0, np.cumsum(halves)]
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in lengths]
        if not first[-1] or not self.items:
            return found
        begin = np.r_[0, np.cumsum(lengths)]
        place = np.arange(len(rows)) - np.repeat(begin[:-1], lengths)
        sums = self.folded(rows, np.repeat(first[:-1], lengths) + place // HALF, int(first[-1]))
        owner = np.repeat(np.arange(len(lengths)), halves)
        both = sums.copy()
        same = np.flatnonzero(owner[1:] == owner[:-1])
        both[same] += sums[same + 1]
        norm = np.sqrt(np.einsum("ij,ij->i", both, both))
        both /= np.where(norm > 0, norm, 1)[:, None]

        def near_by(d, start, end):
            own = rows[begin[d] + max(0, start) : min(begin[d] + end, begin[d + 1])].tolist()
            return own, set(own)

        def compare(d, j, own, cosine):
            words, distinct = own
            # a subsequence has no more words than both share, counted as often as the passage has them
            if len(self.distinct[j] & distinct) + self.spare[j] < PARAPHRASE * self.sizes[j]:
                return
            share = lcs(self.masks[j], self.sizes[j], words) / self.sizes[j]
            if share < PARAPHRASE or share <= found[d].get(j, (0,))[0]:
                return
            answer = len(self.answers[j] & distinct) / len(self.answers[j])
            if share >= VERBATIM or answer >= ANSWER_SHARE:
                found[d][j] = share, answer, float(cosine)

        for a in range(0, len(both), 2048):
            near = both[a : a + 2048] @ self.vectors.T
            last = -1
            for p, j in zip(*(x.tolist() for x in np.nonzero(near >= COSINE))):
                if p != last:
                    d = int(owner[a + p])
                    b = int(a + p - first[d])
                    own, last = near_by(d, (b - 1) * HALF, (b + 3) * HALF), p
                compare(d, j, own, near[p, j])
        seen = set()
        for d, j, start in self.places(rows, lengths, place):
            if found[d].get(j, (0,))[0] < 1 and (d, j, start) not in seen:
                seen.add((d, j, start))
                compare(d, j, near_by(d, start - HALF, start + PASSAGE + HALF), both[first[d] + max(0, start) // HALF] @ self.vectors[j])
        return found

    def places(self, rows: np.ndarray, lengths: np.ndarray, place: np.ndarray):
        """(text, passage, where it would begin) wherever a text has a run of a passage."""
        hashes = runs(rows)
        at = np.flatnonzero(self.begins[hashes >> np.uint64(48)])
        text = np.repeat(np.arange(len(lengths)), lengths)[at]
        whole = place[at] + RUN <= lengths[text]
        at, text = at[whole], text[whole]
        lo, hi = (np.searchsorted(self.runs, hashes[at], side) for side in ("left", "right"))
        for k in np.flatnonzero(lo < hi).tolist():
            for m in range(lo[k], hi[k]):
                yield int(text[k]), int(self.run_of[m]), int(place[at[k]] - self.run_at[m])


def models(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> tuple[DataFrame, list]:
    """The read documents, and for each block of benchmark passages a call that makes its model. One SVD and one count of document frequencies serve all blocks."""
    items = hold(passages(benchmark), "passages")
    words = vocabulary(items)
    if not len(words):
        return docs, []
    rows = read(docs, words, keep)
    df, n = document_frequencies(rows, len(words))
    idf = np.log((n + 1) / (df + 0.5))
    gain = weights_of(items, words, idf, df > COMMON * n)
    gain = np.maximum(gain, np.where(gain > 0, 0.01, 0))
    space = latent_space(items, words, gain)
    blocks = max(1, -(-items.count() // BLOCK))

    def block(b):
        return Model.of(items.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b).collect(), words, idf, gain, space, df > 0)

    return rows, [partial(block, b) for b in range(blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, cosine: one row for each document and benchmark item that leaks into it."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"
    rows, blocks = models(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"])
    out = spark.createDataFrame([], schema)
    for make in blocks:
        sent = spark.sparkContext.broadcast(make())

        def run(batches, sent=sent):
            m = sent.value
            for batch in batches:
                found = [(i, m.items[j], *v) for i, own in zip(batch.column(0).to_pylist(), m.search(batch.column(1))) for j, v in own.items()]
                columns = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], ["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

        out = out.unionByName(rows.select("c0", "words").mapInArrow(run, schema))
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, into which no benchmark item leaks. No join: rows are dropped where they are searched."""
    spark = docs.sparkSession
    rows, blocks = models(docs, benchmark, docs.columns)
    if not blocks:
        return docs
    for make in blocks:
        sent = spark.sparkContext.broadcast(make())

        def run(batches, sent=sent):
            for batch in batches:
                own = sent.value.search(batch.column(batch.num_columns - 1))
                yield batch.filter(pa.array([not x for x in own], pa.bool_()))

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
