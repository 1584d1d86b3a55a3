"""Near-duplicate documents by circulant MinHash.

A document is its set of word shingles. One permutation of the 32-bit universe scatters the shingles, a second one,
circularly shifted k times, gives coordinate k of the signature (the least image). Bands of coordinates that agree make
candidates, and a candidate is a link only if the exact Jaccard similarity of the full sets reaches the threshold.

Equal sets are one class from the start, so groups of copies cost one row each. A member is first compared to the
smallest one of all its buckets, then, if it stayed apart, to each bucket's smallest one; components are formed each
time. Last, members of different components in one bucket are compared with each other by their full sets, in blocks of
bounded size, and only if their signatures don't rule the similarity out by DEVIATIONS. So no bucket makes all its pairs,
and none is cut short. With 40 bands of 5, a pair at 0.8 is missed with chance 1e-7, and ruled out by its signatures with
one of 1e-7. Buckets and classes of more than HOT rows are joined by broadcast, so no task gets all rows of one.

Null texts and texts without words have the empty set, which is linked with nothing; a text with fewer words than a
shingle is one shingle. Rows that share a doc_id are separate rows of the same document.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, release, small_batches, small_enough, tidy
from .components import components
from .words import Words, content

BANDS, ROWS = 40, 5
SIZE = BANDS * ROWS
#: Removed ids that may be broadcast, at 8 bytes each.
BROADCAST_IDS = 1_000_000
DEVIATIONS = 5.5
#: Members of a bucket that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1000, 16 << 20
#: Rows of one key beyond which it is joined by broadcast, and such keys at most (some 50 bytes each).
HOT, HOT_KEYS = 1000, 1_000_000
_U = np.uint64
_M1, _M2 = _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def shingles(column, width: int) -> list[np.ndarray]:
    """Of each text of a string column the sorted distinct 64-bit hashes of its shingles of `width` words."""
    words = Words.of(column)
    h, ends = words.hash, np.cumsum(words.count)

    def joined(x, own, k):
        return (x ^ (x >> _U(31))) * _M1 + own[k : k + len(x)]

    x = h[: max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        x = joined(x, h, k)
    x = _finished(x)
    out = []
    for n, end in zip(words.count.tolist(), ends.tolist()):
        if n >= width:
            out.append(np.unique(x[end - n : end - width + 1]))
            continue
        own = h[end - n : end]  # fewer words than a shingle: all as one
        one = own[:1].copy()
        for k in range(1, n):
            one = joined(one, own, k)
        out.append(_finished(one))
    return out


def _finished(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _M2
    return x ^ (x >> _U(29))


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _pi(x: np.ndarray) -> np.ndarray:
    """The second, in place: odd factors and shifts are bijections."""
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(13)
    return x


@lru_cache(1)
def _shifts() -> np.ndarray:
    return (np.arange(1, SIZE + 1, dtype=np.uint64) * _U(0x01000193) % _U(1 << 32)).astype(np.uint32)[:, None]


def signature(sh: np.ndarray) -> np.ndarray:
    """Coordinate k: the least of pi(sigma(shingle) - shift k), that is, of pi circularly shifted."""
    base = _sigma((sh & _U(0xFFFFFFFF)).astype(np.uint32) ^ (sh >> _U(32)).astype(np.uint32))
    out = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(base), 1024):
        np.minimum(out, _pi(base[None, at : at + 1024] - _shifts()).min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    s = sig.reshape(BANDS, ROWS).astype(_U)
    x = np.arange(1, BANDS + 1, dtype=_U) * _M2
    for k in range(ROWS):
        x = (x ^ (x >> _U(29))) * _M1 + s[:, k]
    x ^= x >> _U(32)
    return (x * _M2).view(np.int64)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, key, bands, sig) in one pass; sig is the signature's low 16 bits."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n", "key", "bands", "sig"]

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            ids, sets = batch.column(0).to_pylist(), shingles(batch.column(1), width)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            bands, sigs = [None] * len(ids), [None] * len(ids)
            for k, (i, s, key) in enumerate(zip(ids, sets, keys)):
                if key is not None and (key not in seen or i is None or i < seen[key]):  # a class needs its smallest row's only
                    full = signature(s)
                    bands[k], sigs[k] = band_keys(full), full.astype("<u2").tobytes()
                    if i is not None:
                        seen[key] = i
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names)
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, sig binary")


def _small(ids: DataFrame) -> DataFrame:
    """Rows of ids, broadcast if there are few: then what they are joined to isn't shuffled."""
    return F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, set) of the wanted ids: the full sorted shingle hashes."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingles(batch.column(1), width)], pa.binary())], ["doc_id", "set"])
        tidy()

    return docs.join(_small(wanted), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text").mapInArrow(run, "doc_id long, set binary")


def _joined_by(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined to `found`, which has each key once and `many`, about the number of the key's rows: hot keys' rows stay where they are."""
    hot = found.filter(F.col("many") > HOT).drop("many")
    if not small_enough(hot, HOT_KEYS):
        return rows.join(found.drop("many"), key, how)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(found.filter(F.col("many") <= HOT).drop("many"), key, how)
    return cold.unionByName(rows.join(F.broadcast(hot), key))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose full sets meet 100 * intersection >= percent * union."""
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a")

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]
        tidy()

    return joined.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long")


def _blocked_pairs(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that link different components in a bucket, likely ones first; none between what earlier pairs have linked.

    A bucket of m members is dealt into blocks of about BLOCK members and BLOCK_BYTES of sets; each pair of blocks is one
    task's work, so memory is bounded however large the bucket is. Sizes and signatures rule most pairs out; the rest are
    compared by their full sets on the spot, so only links leave the task. A pair is looked at in the first band that both
    are in.
    """
    need = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    sizes = hold(members.groupBy("band").agg(need.alias("blocks"), F.count("*").alias("many")), "blocks")
    dealt = _joined_by(members, sizes, "band").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = hold(dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "root"), "dealt")
    # sets and signatures come last, and only those of open members are moved
    open_ = _small(dealt.select("rep").distinct())
    full = reps.select("rep", "n", "sig", "bands").join(open_, "rep", "left_semi").join(sets.toDF("rep", "set").join(open_, "rep", "left_semi"), "rep")
    dealt = dealt.join(full, "rep").select("band", "lo", "hi", "own", "rep", "root", "n", "sig", "set", "bands")
    j = percent / 100
    least = SIZE * (j - DEVIATIONS * (j * (1 - j) / SIZE) ** 0.5) if 0 < j < 1 else SIZE * j

    def compare(keys, at, rep, root, n, own, sig, bands, sets, out):
        """The links of one pair of blocks, which has the rows `at`."""
        lo, hi = keys[1], keys[2]
        rep, n, own, sig, bands = rep[at], n[at], own[at], sig[at], bands[at]
        root = root[at].copy()
        before = bands[:, : int(np.flatnonzero(bands[0] == keys[0])[0])]
        for i in np.flatnonzero(own == lo).tolist():
            ok = (root != root[i]) & (own == hi) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if lo == hi:
                ok &= rep > rep[i]
            near = np.flatnonzero(ok)
            if not len(near):
                continue
            count = (sig[near] == sig[i]).sum(1)
            likely = np.flatnonzero((count >= least) & ~(before[near] == before[i]).any(1))
            for k in near[likely[np.argsort(-count[likely], kind="stable")]].tolist():
                if root[k] != root[i]:
                    x, y = sets(at.start + i), sets(at.start + k)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        out.append((min(rep[i], rep[k]), max(rep[i], rep[k])))
                        root[root == root[k]] = root[i]

    def run(batches):
        rest = None
        for batch in chain(batches, [None]):
            rows = [x for x in (rest, batch) if x is not None and x.num_rows]
            if not rows:
                continue
            rows = pa.Table.from_batches(rows).combine_chunks()
            keys = np.stack([rows[c].to_numpy() for c in ("band", "lo", "hi")], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]).tolist()
            ends = [*starts[1:], len(keys)]
            # the last pair of blocks may go on in the next batch
            rest = rows.slice(starts[-1]).combine_chunks().to_batches()[0] if batch is not None else None
            done = len(starts) - (batch is not None)
            rep, root, n, own = (rows[c].to_numpy() for c in ("rep", "root", "n", "own"))
            sig = np.frombuffer(content(rows["sig"])[0].tobytes(), "<u2").reshape(-1, SIZE)
            bands = rows["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            data, place = content(rows["set"])
            sets = lambda k, data=data, place=place: np.frombuffer(data[place[k] : place[k + 1]].tobytes(), _U)
            out: list[tuple[int, int]] = []
            for x, y in zip(starts[:done], ends[:done]):
                compare(keys[x].tolist(), slice(x, y), rep, root, n, own, sig, bands, sets, out)
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], ["a", "b"])
        tidy()

    key = ["band", "lo", "hi"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after more links: only the roots that they join are worked on."""
    ends = links
    for c in ("a", "b"):
        own = roots.toDF(c, f"root_{c}")
        ends = ends.join(own, c, "left").withColumn(f"to_{c}", F.coalesce(f"root_{c}", c))
    ends = ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b").distinct()
    more = hold(components(ends), "joined")
    moved = roots.join(more.toDF("root", "new"), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return hold(moved.unionByName(more.join(roots.select("node"), "node", "left_anti")), "roots")


def _apart(banded: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with their root, of the buckets that more than one component is in."""
    few = small_enough(roots, BROADCAST_IDS)
    known = roots.toDF("rep", "root")
    rooted = banded.join(F.broadcast(known) if few else known, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = rooted if few else hold(rooted, "rooted")  # it is read more than once
    mixed = rooted.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed"), F.count("*").alias("many")).filter("mixed").select("band", "many")
    return _joined_by(rooted, hold(mixed, "mixed"), "band")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of (doc_id, text).

    component_id is the smallest doc_id of the component, of which kept marks the rows; rows without doc_id are kept.
    A doc_id is expected to name one text: of different texts with the same doc_id, one stands for it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = hold(_signed(docs, width), "signed")
    # the smallest row of a class always has a signature; copies are put together before the shuffle
    first = F.min(F.when(F.col("sig").isNotNull(), F.struct("doc_id", "n", "sig", "bands")))
    reps = signed.filter("key is not null and doc_id is not null").groupBy("key").agg(first.alias("m"), F.count("*").alias("many"))
    reps = hold(reps.select("key", "many", F.col("m.doc_id").alias("rep"), "m.n", "m.sig", "m.bands"), "reps")
    flat = reps.select("rep", "n", F.explode("bands").alias("band"))
    shared = flat.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("many")).filter("least < most")
    banded = hold(_joined_by(flat, hold(shared.select("band", "least", "many"), "shared"), "band"), "bands")
    sets = hold(_sets(docs, banded.select(F.col("rep").alias("doc_id")).distinct(), width), "sets")
    # one link a member, to the smallest of all its buckets, joins most of a group; what it leaves apart is compared to each bucket's smallest
    stars = hold(banded.filter("rep <> least").groupBy("rep").agg(F.min("least").alias("a")).select("a", F.col("rep").alias("b")), "stars")
    roots = hold(components(hold(_verified(stars, sets, percent), "links")), "roots")
    rooted = _apart(banded, roots)
    rest = rooted.select("rep", "least", "root").join(roots.toDF("least", "other"), "least", "left").filter(F.col("root") != F.coalesce("other", "least"))
    rest = hold(rest.select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti"), "stars")
    if not rest.isEmpty():
        roots = _joined(roots, _verified(rest, sets, percent))
    more = hold(_blocked_pairs(_apart(banded, roots).select("band", "rep", "root", "n"), reps, sets, percent), "pairs")
    if not more.isEmpty():
        roots = _joined(roots, more)
    release(banded, sets)
    # rows that are alone in their class and component need no join
    found = reps.select("key", "many", "rep").join(roots.toDF("rep", "root"), "rep", "left").filter("many > 1 or root is not null")
    found = hold(found.select("key", "many", F.coalesce("root", "rep").alias("component_id")), "classes")
    rows = signed.select("doc_id", F.col("n").alias("n_shingles"), "key")
    out = _joined_by(rows.filter("key is not null"), found, "key", "left").drop("key").unionByName(rows.filter("key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one document of each component, and one row of each doc_id.

    Rows without doc_id stay. Only ids are shuffled unless doc_ids are repeated: then the repeated rows are, too.
    """
    found = hold(near_duplicates(docs, width, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "kept")
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    out = named.join(_small(found.filter("not kept").select(F.col("doc_id").alias("id"))), "id", "left_anti")
    repeated = found.filter("kept and rows > 1").select(F.col("doc_id").alias("id"))
    if not repeated.isEmpty():
        again = _small(repeated)
        one = out.join(again, "id", "left_semi").dropDuplicates(["id"])
        out = out.join(again, "id", "left_anti").unionByName(one)
    return out.select("row.*")
