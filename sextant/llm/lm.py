"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside exact unigram counts.

One attention head with relative position biases reads the last subwords and predicts the class of the next one: a
frequent subword by itself, or one of CLUSTERS groups of the others, which are put together by the classes they follow.
The class has a prior given the subword before it, and a subword its share of its class given the class before it, both
from counts of all training documents; the attention model learns what they leave. Texts are cut into windows of WINDOW ids that
overlap by LEAD; each id, and one end at last, is scored once, by the window that holds at least LEAD ids before it.

The model is trained on all training documents, each read once, in windows side by side: they are dealt over the rounds by a hash of the id, in a
round every partition trains on its own documents from the same parameters, and the results are averaged by the ids they
have seen. Counts of words, subwords and pairs of them cover all training documents.

Words' counts reach the scoring tasks in two ways: at most FREQUENT words (those above a cut-off count) are broadcast;
the rest, none of which is frequent, are joined. Words are told apart by 64-bit hashes. Texts are read twice: once for the
counts of words, once for the base score and the subword ids, which are written to the shared folder and trained on and
scored from there. Null texts count as empty: the end alone is scored. Rows that share a doc_id are scored one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_vector, fold, hashed_share, hold, small_batches, sum_vectors, tidy
from .tokens import Tokens, default_tokenizer
from .words import Table, U, Words, content

WINDOW, LEAD, WIDTH = 32, 8, 16
STEP = WINDOW - LEAD
#: Classes: frequent ids, and groups of the others. Ids with an embedding of their own.
OWN, CLUSTERS, EMBEDDED = 64, 32, 4096
CLASSES = OWN + CLUSTERS
#: Pseudo-counts of the ids' shares in what follows a class.
SHRINK = 30.0
#: Windows that are read at once, which is what a processor's cache holds, and windows of a step of training.
CHUNK, BATCH = 48, 32
ROUNDS, RATE = 3, 0.08
FREQUENT, FLUSH = 200_000, 2_000_000
#: Cells of a table of counts that a task holds as a whole.
DENSE = 1 << 20


# counts


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n_all, n_train) from (train, text): kind 0 words by hash, 1 documents."""
    small_batches(docs.sparkSession)

    def rows(kind, own, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n), pa.array(n * own)], ["kind", "key", "n_all", "n_train"])

    def run(batches):
        found, held, n = ([], []), 0, [0, 0]
        for batch in chain(batches, [None]):
            if batch is not None:
                text, train = Words.of(batch.column(1)), np.array(batch.column(0).to_pylist(), bool)
                own = np.repeat(train, text.count)
                for k in (0, 1):
                    found[k].append(text.hash[own == bool(k)])
                    n[k] += int((train == bool(k)).sum())
                held += len(own)
            if batch is None or held > FLUSH:
                for k in (0, 1):
                    yield rows(0, k, *np.unique(np.concatenate([np.zeros(0, U), *found[k]]), return_counts=True))
                    found[k].clear()
                held = 0
        for k in (0, 1):
            yield rows(1, k, np.array([k]), np.array([n[k]]))
        tidy()

    kept = docs.select(F.col("train").cast("int").alias("train"), "text")
    return kept.mapInArrow(run, "kind int, key long, n_all long, n_train long").groupBy("kind", "key").agg(F.sum("n_all").alias("n_all"), F.sum("n_train").alias("n_train"))


def pair_keys(ids: np.ndarray, at: np.ndarray, before: np.ndarray, start: int, end: int, after: np.ndarray | None = None) -> np.ndarray:
    """before[last id] * kinds + after[id] of each id of the texts and of the end that follows each; `start` comes before a text's first.

    `after` is the ids themselves by default; kinds is their number.
    """
    n = len(at) - 1
    whole = np.full(len(ids) + n, end, np.int64)
    inside = np.ones(len(whole), bool)
    inside[at[1:] + np.arange(n)] = False
    whole[inside] = ids
    own = np.full(len(whole), start, np.int64)
    own[1:] = before[whole[:-1]]
    own[at[:-1] + np.arange(n)] = start
    return own * (end + 1) + whole if after is None else own * (int(after.max()) + 1) + after[whole]


def pairs(held: DataFrame, before: np.ndarray, start: int, end: int, after: np.ndarray | None = None) -> np.ndarray:
    """Counts, as a table, of the pairs that `pair_keys` has for the read training documents. At most the table's numbers reach the driver."""

    cells = (start + 1) * (end + 1 if after is None else int(after.max()) + 1)

    def run(batches):
        keys, counts, dense = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(cells if cells <= DENSE else 0, np.int64)
        for batch in batches:
            found = pair_keys(*_flat(batch.column(0)), before, start, end, after)
            if cells <= DENSE:
                dense += np.bincount(found, minlength=cells)
                continue
            found, n = np.unique(found, return_counts=True)
            keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
        if cells <= DENSE:
            keys = np.flatnonzero(dense)
            counts = dense[keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])
        tidy()

    found = held.filter("not held_out").select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return as_table(found["key"].to_numpy(), found["n"].to_numpy(), start, end, after)


def as_table(keys: np.ndarray, counts: np.ndarray, start: int, end: int, after: np.ndarray | None = None) -> np.ndarray:
    kinds = end + 1 if after is None else int(after.max()) + 1
    return np.bincount(keys, counts, (start + 1) * kinds).reshape(start + 1, kinds)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after the other, and where each text begins."""
    data, at = content(column)
    return np.frombuffer(data.tobytes(), "<u4"), at // 4


@dataclass
class Unigrams:
    """Frequent words' hashes, sorted, with log10 probabilities and whether training texts have them; below `cut` words are joined."""

    keys: np.ndarray
    logs: np.ndarray
    known: np.ndarray
    cut: int
    total: int
    distinct: int
    ends: int

    def log10(self, c):
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def unigrams(counts: DataFrame, frequent: int = FREQUENT) -> Unigrams:
    """Totals, and the most frequent words: a cut-off from a histogram of logarithms, so nothing is sorted."""
    found = counts.filter("kind = 0")
    ends = counts.filter("kind = 1").agg(F.sum("n_train")).first()[0] or 0
    total, distinct = found.filter("n_train > 0").agg(F.sum("n_train"), F.count("*")).first()
    bins = found.groupBy(F.floor(F.log2("n_all") * 8).alias("b")).agg(F.count("*").alias("k"), F.min("n_all").alias("least")).collect()
    cut, held = None, 0
    for r in sorted(bins, key=lambda r: -r["b"]):
        if (held := held + r["k"]) > frequent:
            break
        cut = r["least"]
    if cut is None:
        cut = 1 + max((r["least"] for r in bins), default=0) * 2
    rows = found.filter(F.col("n_all") >= cut).select("key", "n_train").collect()
    keys, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    order = np.argsort(keys)
    out = Unigrams(keys[order], np.zeros(0), n[order] > 0, cut, (total or 0) + ends, (distinct or 0) + (ends > 0), ends)
    out.logs = out.log10(n[order])
    return out


# the attention model


@dataclass
class Vocabulary:
    """Of each subword id its embedding's place and its class; the logarithms of the classes' prior after each place, and of the ids' shares of their classes after each class.

    The last place stands for the start, as the last class does in `share`; `kind` has each place's class.
    """

    place: np.ndarray
    group: np.ndarray
    kind: np.ndarray
    prior: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, count) -> Vocabulary:
        """From `count`, which gives the tables of `pairs` from `before`, `start` and perhaps `after`; ids' classes are found on the way."""
        total = count(None, 1).sum(0)
        size = len(total)
        rank = np.empty(size, np.int64)
        rank[np.lexsort((np.arange(size), -total))] = np.arange(size)
        group = np.where(rank < OWN, rank, OWN + _clusters(count(np.minimum(rank, OWN), OWN + 1), total, rank))
        embedded = min(EMBEDDED, size)
        place = np.minimum(rank, embedded)
        kind = np.full(embedded + 2, CLASSES - 1)
        kind[place] = group
        kind[embedded], kind[-1] = CLASSES - 1, CLASSES
        even = (total + 0.5) / (total + 0.5).sum()
        rows = count(group, CLASSES) + SHRINK * even
        rows /= rows.sum(1, keepdims=True)
        sums = np.maximum([np.bincount(group, r, CLASSES) for r in rows], 1e-12)
        share = np.log(rows / sums[:, group]).astype(np.float32)
        prior = np.zeros((embedded + 2, CLASSES))
        found = count(place, embedded + 1, group)
        prior[:, : found.shape[1]] = found
        prior += SHRINK * sums[kind]
        prior /= prior.sum(1, keepdims=True)
        return cls(place.astype(np.int32), group.astype(np.int32), kind.astype(np.int32), np.log(prior).astype(np.float32), share)

    @property
    def embeddings(self) -> int:
        return len(self.kind)


def _clusters(own: np.ndarray, total: np.ndarray, rank: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A group for each id, by k-means on what it follows; ids that were hardly seen share the last group."""
    out = np.full(own.shape[1], CLUSTERS - 1, np.int64)
    seen = np.flatnonzero((rank >= OWN) & (rank < EMBEDDED) & (total >= 5))
    if len(seen) < CLUSTERS:
        return out
    x = np.sqrt(own[:, seen].T / total[seen, None])
    weight = np.sqrt(total[seen])
    centres = x[np.argsort(rank[seen])[np.linspace(0, len(seen) - 1, CLUSTERS - 1).astype(int)]]
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres * centres).sum(1)).argmax(1)
        for k in range(CLUSTERS - 1):
            if (near == k).any():
                centres[k] = np.average(x[near == k], axis=0, weights=weight[near == k])
    out[seen] = near
    return out


SHAPES = {"q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (WIDTH, WIDTH), "a": (WIDTH,), "bias": (WINDOW,), "u": (WIDTH, CLASSES)}
_SPAN = np.arange(WINDOW)
#: Distance from each key to each place of a window, and what keeps keys to come out.
_LAG = _SPAN[:, None] - _SPAN[None, :]
_FUTURE = np.where(_LAG < 0, -np.inf, 0).astype(np.float32)
_LAG = np.abs(_LAG)


def initial(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(7)
    p = {n: rng.standard_normal(s).astype(np.float32) * 0.25 for n, s in SHAPES.items()}
    return p | {"e": rng.standard_normal((vocabulary.embeddings, WIDTH)).astype(np.float32) * 0.5, "bias": -0.1 * np.arange(WINDOW, dtype=np.float32), "a": np.zeros(WIDTH, np.float32), "u": p["u"] * 0.1}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[n].ravel() for n in ("e", *SHAPES)])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    rest = sum(math.prod(s) for s in SHAPES.values())
    out, at = {"e": x[: len(x) - rest].reshape(-1, WIDTH).astype(np.float32)}, len(x) - rest
    for n, s in SHAPES.items():
        out[n] = x[at : at + math.prod(s)].reshape(s).astype(np.float32)
        at += math.prod(s)
    return out


def windows(ids: np.ndarray, at: np.ndarray, end: int, vocabulary: Vocabulary, lead: int = LEAD):
    """Of all texts' ids, one after the other: inputs (places), where each window begins in them, for each of a window's places but its first
    `lead` ones the id to come (-1: none), and the number of windows of each text."""
    sizes, step = np.diff(at), WINDOW - lead
    count = -(-(sizes + 1) // step)
    starts = np.r_[0, np.cumsum(count * step + lead)]
    inputs = np.full(int(starts[-1]), vocabulary.embeddings - 1, np.int32)
    nexts = np.full(int(count.sum()) * step, -1, np.int64)
    to = np.r_[0, np.cumsum(count * step)]
    within = np.arange(len(ids)) - np.repeat(at[:-1], sizes)
    last = within < np.repeat(count * step - 1, sizes)  # no window reads a place beyond its last
    inputs[(np.repeat(starts[:-1], sizes) + lead + 1 + within)[last]] = vocabulary.place[ids[last]]
    nexts[np.repeat(to[:-1], sizes) + within] = ids
    nexts[to[:-1] + sizes] = end
    first = np.repeat(starts[:-1] - to[:-1], count) + np.arange(int(count.sum())) * step
    return inputs, first, nexts.reshape(-1, step), count


class Scorer:
    """The trained model with its products prepared for reading."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary, end: int):
        e = p["e"]
        self.q, self.k, self.v, self.r = e @ p["q"] / np.float32(math.sqrt(WIDTH)), e @ p["k"], e @ p["v"], e @ p["r"] + p["a"]
        self.u, self.prior = p["u"], vocabulary.prior
        self.bias = (p["bias"][_LAG] + _FUTURE)[LEAD:].astype(np.float32)
        reach = lambda x: float(np.sqrt((x * x).sum(-1)).max())
        self.calm = reach(self.q) * reach(self.k) + float(np.abs(p["bias"]).max()) < 60 and float(np.abs(p["u"]).sum(0).max() + np.abs(self.prior).max()) < 80
        self.vocabulary, self.end = vocabulary, end
        self.room: dict[str, np.ndarray] = {}

    def logs(self, x: np.ndarray, nexts: np.ndarray) -> np.ndarray:
        """Natural logarithms of P(next) for inputs (windows, WINDOW) and nexts (windows, STEP); 0 where nothing comes."""
        s = np.matmul(self.q[x[:, LEAD:]], self.k[x].transpose(0, 2, 1), out=self._room("s", (len(x), STEP, WINDOW)))
        s += self.bias
        if not self.calm:
            s -= s.max(-1, keepdims=True)
        a = np.exp(s, out=s)
        h = a @ self.v[x]
        h /= a.sum(-1, keepdims=True)
        h += self.r[x[:, LEAD:]]
        np.tanh(h, out=h)
        known = nexts.ravel() >= 0
        ids = nexts.ravel() * known
        own = x[:, LEAD:].ravel()
        z = np.matmul(h.reshape(-1, WIDTH), self.u, out=self._room("z", (len(ids), CLASSES)))
        z += self.prior[own]
        if not self.calm:
            z -= z.max(-1, keepdims=True)
        chosen = z[np.arange(len(z)), self.vocabulary.group[ids]].astype(np.float64)
        chosen -= np.log(np.exp(z, out=z) @ np.ones(CLASSES, np.float32))
        chosen += self.vocabulary.share[self.vocabulary.kind[own], ids]
        return (chosen * known).reshape(nexts.shape)

    def _room(self, name: str, shape: tuple[int, ...]) -> np.ndarray:
        """Memory that is used again for every chunk of windows."""
        if self.room.get(name, np.empty(0)).shape != shape:
            self.room[name] = np.empty(shape, np.float32)
        return self.room[name]

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included, from all texts' ids and where each begins."""
        if len(at) < 2:
            return np.zeros(0)
        inputs, first, nexts, count = windows(ids, at, self.end, self.vocabulary)
        total = np.empty(len(first))
        for a in range(0, len(first), CHUNK):
            b = a + CHUNK
            total[a:b] = self.logs(inputs[first[a:b, None] + _SPAN], nexts[a:b]).sum(1)
        return np.add.reduceat(total, np.r_[0, np.cumsum(count)[:-1]]) / math.log(10)


def gradients(p: dict[str, np.ndarray], x: np.ndarray, nexts: np.ndarray, vocabulary: Vocabulary) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the classes of the ids that come after a window's last places (windows, places; -1: none) and its derivatives; the embeddings' as (rows, values) in `e`."""
    scale = np.float32(1 / math.sqrt(WIDTH))
    lead, size = WINDOW - nexts.shape[1], x.size
    order = np.argsort(x.ravel().astype(np.uint16), kind="stable")  # 16 bits are sorted by their digits; places are fewer
    sorted_ = x.ravel()[order]
    new = np.ones(size, bool)
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    used, back = sorted_[new], np.empty(size, np.int64)
    back[order] = np.cumsum(new) - 1
    e, products = p["e"][used], np.hstack([p["k"], p["v"], p["q"] * scale, p["r"]])
    own = np.take(e @ products, back, axis=0).reshape(*x.shape, 4 * WIDTH)
    k, v, q, r = own[..., :WIDTH], own[..., WIDTH : 2 * WIDTH], own[:, lead:, 2 * WIDTH : 3 * WIDTH], own[:, lead:, 3 * WIDTH :]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += (p["bias"][_LAG] + _FUTURE)[lead:]
    _calmed(a)
    np.exp(a, out=a)
    share = 1 / (a @ np.ones(WINDOW, np.float32))[..., None]
    found = np.matmul(a, v)
    found *= share
    h = found + r
    h += p["a"]
    np.tanh(h, out=h)
    known = nexts.ravel() >= 0
    n = np.float32(1 / max(1, int(known.sum())))
    group = vocabulary.group[nexts.ravel() * known]
    hs = h.reshape(-1, WIDTH)
    z = hs @ p["u"]
    z += np.take(vocabulary.prior, x[:, lead:].ravel(), axis=0)
    _calmed(z)
    np.exp(z, out=z)
    sums = z @ np.ones(CLASSES, np.float32)
    at = np.arange(len(z)), group
    chosen = z[at]
    loss = float((np.log(sums) - np.log(np.maximum(chosen, 1e-30)))[known].sum()) * n
    z[at] = chosen - sums  # derivatives but for a factor of each row
    factor = (known * n / sums)[:, None]
    g = {"u": (hs * factor).T @ z}
    dz = ((z @ p["u"].T) * factor).reshape(h.shape)
    dz *= 1 - h * h
    # the shares of a row add up to 1: what that takes from its derivatives is dz times what the row found
    part = dz * share
    da = np.matmul(part, v.transpose(0, 2, 1))
    da -= np.einsum("wpi,wpi->wp", part, found)[..., None]
    da *= a
    g["bias"] = np.bincount(_LAG[lead:].ravel(), da.sum(0).ravel(), WINDOW).astype(np.float32)
    d = np.zeros((*x.shape, 4 * WIDTH), np.float32) if lead else np.empty((*x.shape, 4 * WIDTH), np.float32)
    d[..., :WIDTH] = np.matmul(da.transpose(0, 2, 1), q)
    d[..., WIDTH : 2 * WIDTH] = np.matmul(a.transpose(0, 2, 1), part)
    d[:, lead:, 2 * WIDTH : 3 * WIDTH] = np.matmul(da, k)
    d[:, lead:, 3 * WIDTH :] = dz
    d = d.reshape(size, -1)
    of = np.take(e, back, axis=0).T @ d
    g |= {"k": of[:, :WIDTH], "v": of[:, WIDTH : 2 * WIDTH], "q": of[:, 2 * WIDTH : 3 * WIDTH] * scale, "r": of[:, 3 * WIDTH :], "a": dz.sum((0, 1))}
    cells = (back[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    g["e"] = used, np.bincount(cells, (d @ products.T).ravel(), len(used) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
    return loss, g


def _calmed(x: np.ndarray) -> None:
    """Keep exponentials finite, at a cost only where it is needed."""
    if x.max() > 80:
        x -= x.max(-1, keepdims=True)


class Trainer:
    """Adagrad from given parameters."""

    def __init__(self, p: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.p = {n: x.copy() for n, x in p.items()}
        self.past = {n: np.full(x.shape, 1e-4, np.float32) for n, x in p.items()}
        self.seen = 0

    def step(self, x: np.ndarray, nexts: np.ndarray) -> float:
        loss, g = gradients(self.p, x, nexts, self.vocabulary)
        for n, d in g.items():
            if n == "e":
                own, d = d
                past = self.past[n][own] + d * d
                self.past[n][own] = past
                self.p[n][own] -= RATE * d / np.sqrt(past)
            else:
                self.past[n] += d * d
                self.p[n] -= RATE * d / np.sqrt(self.past[n])
        self.seen += int((nexts >= 0).sum())
        return loss


def train(held: DataFrame, vocabulary: Vocabulary, end: int, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters averaged over partitions after each round, from the read documents' (doc_id, held_out, ids)."""
    spark = held.sparkSession
    p = initial(vocabulary)
    size = len(flat(p))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((p, vocabulary))

        def run(batches, sent=sent):
            p, vocabulary = sent.value
            trainer, rng = Trainer(p, vocabulary), np.random.default_rng(k)
            for batch in batches:
                ids, at = _flat(batch.column(0))
                if len(at) < 2:
                    continue
                inputs, first, nexts, _ = windows(ids, at, end, vocabulary, 0)
                order = rng.permutation(len(first))
                for a in range(0, len(order), BATCH):
                    own = order[a : a + BATCH]
                    trainer.step(inputs[first[own, None] + _SPAN], nexts[own])
            if trainer.seen:
                for r in pa.RecordBatch.from_pandas(cut_vector(np.append(flat(trainer.p).astype(np.float64) * trainer.seen, trainer.seen)), preserve_index=False).to_struct_array().to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int32()), pa.array([r["part"]], pa.binary())], ["chunk", "part"])
            tidy()

        own = hashed_share(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "lm")
        part = held.filter((~F.col("held_out")) & (F.floor(own * rounds) == k)).select("ids")
        total = sum_vectors(part.mapInArrow(run, "chunk int, part binary"), size + 1)
        if total[-1]:
            p = unflat(total[:-1] / total[-1])
    return p


# scoring


def read(docs: DataFrame, base: Unigrams, tokenizer: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, known, logs, rare, ids) from (doc_id, text, held_out): what frequent words add to the base score, the others' hashes, and the subword ids."""
    sent = docs.sparkSession.sparkContext.broadcast(base)

    def run(batches):
        base = sent.value
        tokens, frequent = Tokens.load(tokenizer), Table(20)
        frequent.add(base.keys.view(U), np.arange(len(base.keys), dtype=np.int32))
        end_log = float(base.log10(base.ends))
        for batch in batches:
            n = batch.num_rows
            text = Words.of(batch.column(1))
            owner = text.owner()
            at = frequent.find(text.hash)
            hit = at >= 0
            known = np.bincount(owner[hit], base.known[at[hit]], n) + (base.ends > 0)
            logs = np.bincount(owner[hit], base.logs[at[hit]], n) + end_log
            rare = np.bincount(owner[~hit], minlength=n)
            ids, sizes = tokens.encode(batch.column(1))
            places = np.r_[0, np.cumsum(sizes)] * 4
            packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(text.count + 1),
                    pa.array(known.astype(np.int64)),
                    pa.array(logs),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rare)], pa.int32()), pa.array(text.hash[~hit].view(np.int64))),
                    packed.cast(pa.binary()),
                ],
                ["doc_id", "held_out", "n_tokens", "known", "logs", "rare", "ids"],
            )
        tidy()

    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, rare array<long>, ids binary"
    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def score(docs: DataFrame, held_out, tokenizer: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of (doc_id, text); `held_out` is a column."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = hold(count(docs.withColumn("train", ~F.col("held_out"))), "counts")
    base = unigrams(counts, frequent)
    held = hold(read(docs, base, tokenizer).withColumn("row", F.monotonically_increasing_id()), "read")
    end = Tokens.load(tokenizer).size
    vocabulary = Vocabulary.of(lambda before, start, after=None: pairs(held, np.zeros(end + 1, np.int64) if before is None else before, start, end, after))
    sent = spark.sparkContext.broadcast(Scorer(train(held, vocabulary, end), vocabulary, end))

    def run(batches):
        scorer = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scorer.score(*_flat(batch.column(batch.num_columns - 1))))], [*batch.schema.names[:-1], "score"])
        tidy()

    scored = held.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double")
    c = F.col("n_train")
    rare = held.select("row", F.explode("rare").alias("key")).join(counts.filter((F.col("kind") == 0) & (F.col("n_all") < base.cut)).select("key", "n_train"), "key")
    rare = rare.groupBy("row").agg(F.sum((c > 0).cast("long")).alias("more"), F.sum(F.log10((c + 0.5) / F.lit(base.total + 0.5 * (base.distinct + 1)))).alias("rest"))
    return (
        scored.join(rare, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(base.total).cast("long").alias("train_tokens"),
            (F.col("logs") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
            "score",
        )
    )


def language_model(docs: DataFrame) -> DataFrame:
    """Scores of all rows, learned from those whose crc32(doc_id) mod 5 is not 1."""
    return score(docs, fold(F.col("doc_id"), 5) == 1)
