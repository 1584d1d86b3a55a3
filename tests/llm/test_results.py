"""Results against brute force, exact round trips, held-out accuracy and SQL, on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant.llm import decontaminate, fingerprint, linededup, lm, minhash, packing, pii, quality, queries, toxicity
from sextant.llm.common import documents, table
from sextant.llm.components import components
from sextant.llm.tokens import Tokens, default_tokenizer


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in documents(spark, sf_dir).collect()}


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    done = {}

    def of(name):
        if name not in done:
            done[name] = queries.queries()[name](spark, sf_dir).collect()
        return done[name]

    return of


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def words(text):
    return (text or "").encode().lower().split()


def test_language_id_held_out_accuracy(found, docs):
    rows = [r for r in found("op1_language_id") if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in found("op1_language_id"))
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows]) > 0.95


def test_language_id_is_that_of_plain_counting(found, docs):
    tokens = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [x[i : i + n] for x in [f" {w} " if n > 1 else w] for i in range(len(x) - n + 1)]
    known, share = [defaultdict(Counter) for _ in range(5)], Counter()
    for i, r in docs.items():
        if fold(i, 5) and r["text"] is not None and r["lang"] is not None:
            share[r["lang"]] += 1
            for w in tokens(r["text"]):
                known[0][r["lang"]][w] += 1
                for n in range(1, 5):
                    for g in grams(w, n) if len(w) <= 64 else []:
                        known[n][r["lang"]][g] += 1
    seen = [set().union(*k.values()) for k in known]
    totals = [{x: sum(k[x].values()) for x in share} for k in known]
    log = lambda n, x, t: math.log((known[n][x][t] + 0.5) / (totals[n][x] + 0.5 * (len(seen[n]) + 1)))

    def word(w, x):
        if w in seen[0]:
            return log(0, x, w)
        n = next((n for n in (4, 3, 2, 1) if seen[n].intersection(grams(w, n))), None)
        return sum(log(n, x, g) for g in grams(w, n) if g in seen[n]) / n * 0.4 ** (4 - n) if n else 0.0

    for r in found("op1_language_id"):
        own = tokens(docs[r["doc_id"]]["text"])
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = {x: math.log(share[x] / sum(share.values())) + sum(word(w, x) for w in own) for x in share}
        best = max(total, key=total.get)
        assert r["lang_pred"] == best or total[best] - total[r["lang_pred"]] < 1e-2
        assert r["score"] == pytest.approx(1 / sum(math.exp((t - total[best]) / math.sqrt(len(own))) for t in total.values()), rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert not compare.difference(queries.queries()[name](spark, sf_dir), compare.views(sf_dir), queries.oracle_sql()[name])


def test_packing_round_trip(found, docs):
    tokenizer = Tokens.load(default_tokenizer()).tokenizer
    own, sequences = defaultdict(list), defaultdict(list)
    for r in found("op3_packing"):
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert own.keys() == docs.keys()
    for i, pieces in own.items():
        ids, at = [*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        used += at
    assert used > 0.98 * 2048 * len(sequences)


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1000 * (k % 2), 1000 * (k % 2) + 300, 100) for k in range(40)]
    pieces = packing.pack_shard(texts, [100] * 40, window=1000)
    for s in (0, 2):
        topics = Counter(d % 2 for d, _, _, q, _ in pieces if q == s)
        assert topics.most_common(1)[0][1] >= 9


def test_packing_finds_neighbours_among_many_shards(spark):
    rng = np.random.default_rng(9)
    syllables = [a + b + c for a in "bdfklmnrst" for b in "aeiou" for c in "nr"]
    texts = {}
    for k in range(600):  # 2k + 1 is a copy of 2k, every second time with 15 of 150 words changed
        own = [syllables[k % 6] + syllables[w // 100] + syllables[w % 100] for w in rng.zipf(1.3, 150) % 3000]
        texts[2 * k] = " ".join(own)
        for at in rng.choice(150, 15, replace=False) if k % 2 else []:
            own[at] = "".join(rng.choice(syllables, 4))
        texts[2 * k + 1] = " ".join(own)
    texts |= {5000 + k: "the same text for all of a large group of copies " * 10 for k in range(400)}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shard_tokens=20_000).collect()
    assert {r["doc_id"] for r in rows} == texts.keys()
    assert len({r["sequence_id"] >> 24 for r in rows}) > 20
    size = Counter()
    for r in rows:
        size[r["sequence_id"] >> 24] += r["length"]
    assert max(size.values()) <= 20_000
    place = {r["doc_id"]: r["sequence_id"] for r in rows if r["start"] == 0}
    seeds = {r["doc_id"]: r["sequence_id"] for r in sorted(rows, key=lambda r: -r["sequence_id"]) if r["offset"] == 0 and r["doc_id"] < 5000}
    shard = {i: at >> 24 for i, at in place.items()}
    copies, near = ([shard[i] == shard[i + 1] for i in range(2 * k, 1200, 4)] for k in (0, 1))
    assert np.mean(copies) > 0.9  # some lie across a border: a shard has some forty documents here
    assert np.mean(near) > 0.4  # near copies share about half of their pairs of ids, which is their chance to be dealt alike
    met = [place[i ^ 1] == at for i, at in seeds.items() if shard[i ^ 1] == at >> 24 and place[i ^ 1] >= at]
    assert len(met) > 80 and np.mean(met) > 0.9


def odd_text(rng):
    pools = [(0x20, 0x7F), (0xA0, 0x250), (0x370, 0x500), (0x300, 0x370), (0x2000, 0x2070), (0x4E00, 0x4E80), (0x1F600, 0x1F640), (0x5D0, 0x600), (0x9, 0xE), (0x1C, 0x20), (0xAC00, 0xAC40), (0x1E00, 0x1F00)]
    known = [" ", "'s", "'re ", "the ΟΔΟΣ of stone", "\n", "İ", "ŉ", "<|endoftext|>", "x" * 90 + "?!", "12.5% "]
    out = []
    for _ in range(rng.randint(0, 30)):
        a, b = rng.choice(pools[: 3 if rng.random() < 0.5 else None])
        out.append(chr(rng.randrange(a, b)) if rng.random() < 0.8 else rng.choice(known))
    return "".join(out)


@pytest.mark.parametrize("kind", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_tokenizers(kind):
    import public_tokenizers

    rng = random.Random(3)
    t = Tokens(public_tokenizers.path(kind))
    odd = ["", None, " ", "don't a\tb\r\nc d", "x<|endoftext|>y", "１２３ a.b 🙂🙂 é İ ß ﬁ", "A a AA aA 's 'T", "word, word. word", *(odd_text(rng) for _ in range(5000))]
    t.known.left = 3000  # later pieces find no room
    for a in range(0, len(odd), 500):
        ids, sizes = t.encode(pa.array(odd[a : a + 500]))
        own = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert own == [t.tokenizer.encode(x or "", add_special_tokens=False).ids for x in odd[a : a + 500]]


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(d):
    total = sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(d)))
    return 13 <= len(d) <= 19 and total % 10 == 0


def base_spans(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in BASE.items()}


def check_personal(rows, texts):
    for r in rows:
        spans = base_spans(texts[r["doc_id"]] or "")
        listed = [f"{k}:{s}:{e}" for k, own in spans.items() for s, e in own]
        assert [r[f"n_{k}"] for k in spans] == [len(own) for own in spans.values()]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r["spans"].split(",")) or not listed


def test_personal_data(found, docs):
    check_personal(found("op4_personal_data"), {i: r["text"] for i, r in docs.items()})


def test_personal_data_of_odd_texts(spark):
    texts = ["a@b.c 1.2.3.4 4111 1111 1111 1111 +1 (555) 123-4567", "🙂 x@y.zz +123456789 300.1.1.1 1.2.3.4.5", "..@a..b %%@x-.y a@b a@b.c.d@e.f", "4111-1111--1111 4111111111111111 00000000000000", None, "", "1" * 5000 + "@a.b", "1.2.3.4" * 50, "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +12-34-56-78-9", "é@é.é a@b.c\n+1234567890\t9.9.9.9"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_personal(pii.digest(pii.personal_data(df)).collect(), dict(enumerate(texts)))


def plain_secrets(text, weights, base):
    """Added spans with Python's regular expressions, one candidate at a time."""
    starts = [1 + sum(pii._LEVELS[:j]) for j in range(len(pii._LEVELS))]
    gazetteer = re.compile(rf"(?:{pii.GAZETTEER})\W{{0,4}}$", re.ASCII)
    out = []
    for m in re.finditer(pii.SECRET, text, re.ASCII):
        b, digits = text[max(0, m.start() - 24) : m.start()].lower(), sum(c in "0123456789" for c in m[0])
        upper, lower = re.search("[A-Z]", m[0]), re.search("[a-z]", m[0])
        f = [min(4, len(m[0]) // 8), digits * 4 // len(m[0]), 2 if upper and lower else 1 if upper else 0]
        f += [int(bool(x.search(b))) for x in (gazetteer, re.compile("[=:]\\s?[\"']?$", re.ASCII), re.compile("[\"']$"))]
        total = weights[0] + sum(weights[s + min(x, n - 1)] for s, n, x in zip(starts, pii._LEVELS, f))
        if total > 0 and not any(s < m.end() and m.start() < e for own in base.values() for s, e in own):
            out.append(f"secret:{m.start()}:{m.end()}")
    return out


def test_added_spans_are_those_of_plain_python(spark, sf_dir, docs):
    texts = {i: r["text"] or "" for i, r in docs.items()} | {-1: "token = 'a1b2c3d4e5f6a7b8c9d0' and item number42abcdef, password: Xy12345678Zq", -2: "mail a1@b.cc key=AKIA1234567890ABCD 4111111111111111x"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    weights, _ = pii.fit(df)
    added = 0
    for r in pii.digest(pii.personal_data(df, weights=weights)).collect():
        own = plain_secrets(texts[r["doc_id"]], weights, base_spans(texts[r["doc_id"]]))
        assert [x for x in r["spans"].split(",") if x.startswith("secret:")] == own and r["n_secret"] == len(own)
        added += len(own)
    assert added


def test_weak_labels_find_the_reliable_labeler():
    rng = np.random.default_rng(3)
    patterns = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        votes = [(1 if (rng.random() < q) == y else -1) if rng.random() < 0.9 else 0 for q in (0.95, 0.8, 0.6)]
        patterns[tuple(votes)] += 1
    _, rel = pii.em(dict(patterns))
    assert rel[0][0] > rel[1][0] > rel[2][0]


def brute_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        n = min(width, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                c = len(x & y)
                if 100 * c >= percent * (len(x) + len(y) - c):
                    u, v = sorted((top(a), top(b)))
                    root[v] = u
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates_are_those_of_brute_force(found, docs):
    expected = brute_components({i: r["text"] for i, r in docs.items()}, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found("op5_minhash")} == expected


def test_near_duplicates_in_chains_and_large_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    texts = {}
    for i in range(300):  # each differs from the one before in two words: a chain whose ends share little
        at = (2 * i) % 120
        base[at : at + 2] = [f"x{i}", f"y{i}"]
        texts[1000 - i] = " ".join(base)
    texts |= {2000 + i: "same text again and again here" for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert found == brute_components(texts, 2, 80)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(links).collect()} == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}


def test_quality_agrees_with_labels(spark, sf_dir, found):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    assert np.mean([r["kept"] == bool(labels[r["doc_id"]]) for r in found("op6_quality") if r["doc_id"] in labels]) > 0.9


def test_quality_posteriors_are_those_of_plain_sums(spark, sf_dir, found, docs):
    weights = quality.fit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    p = {i: 1 / (1 + math.exp(-np.clip(np.dot(quality.features(r["text"]), weights), -30, 30))) if (r["text"] or "").strip() else 0.0 for i, r in docs.items()}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, r in docs.items():
        paths[r["source"], r["lang"]].append(p[i])
        hosts[r["source"]].append(p[i])
    prior = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups):  # of (values, where the group shrinks to)
        n, total = sum(len(v) for v, _ in groups), sum(sum(v) for v, _ in groups)
        within = total / n * (1 - total / n)
        between = sum((sum(v) / len(v) - to) ** 2 for v, to in groups) / len(groups) - within * len(groups) / n
        return min(1000.0, max(2.0, within / between - 1)) if between > 1e-6 else 1000.0

    k = strength([(v, prior) for v in hosts.values()]) if len(hosts) > 1 else 50.0
    host = {x: (sum(v) + k * prior) / (len(v) + k) for x, v in hosts.items()}
    k = strength([(v, host[x[0]]) for x, v in paths.items()]) if len(paths) > 1 else 50.0
    path = {x: (sum(v) + k * host[x[0]]) / (len(v) + k) for x, v in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    for r in found("op6_quality"):
        d = docs[r["doc_id"]]
        own = path[d["source"], d["lang"]]
        assert (r["evidence"], r["host_posterior"], r["path_posterior"]) == pytest.approx((p[r["doc_id"]], host[d["source"]], own), rel=1e-6)
        shift = max(-1.5, min(1.5, odds(min(0.999, max(0.001, own))) - odds(prior)))
        x = min(1 - 1e-12, max(1e-12, p[r["doc_id"]]))
        expected = 1 / (1 + math.exp(-odds(x) - shift)) if p[r["doc_id"]] else 0.0
        assert r["score"] == pytest.approx(expected, rel=1e-6) and r["kept"] == (r["score"] >= 0.5)


def test_language_model_base_is_exact(found, docs):
    tokens = lambda t: [*words(t), 0]
    c = Counter(x for i, r in docs.items() if fold(i, 5) != 1 for x in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in found("op7_language_model"):
        own = tokens(docs[r["doc_id"]]["text"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 5) == 1, len(own), sum(c[x] > 0 for x in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel=1e-9)


def test_language_model_joins_what_it_does_not_broadcast(spark, found, docs):
    df = spark.createDataFrame([(i, r["text"]) for i, r in docs.items()], "doc_id long, text string")
    rows = lm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, frequent=500).collect()
    expected = {r["doc_id"]: r for r in found("op7_language_model")}
    for r in rows:
        assert r["n_known"] == expected[r["doc_id"]]["n_known"] and r["base_score"] == pytest.approx(expected[r["doc_id"]]["base_score"], rel=1e-9)


def _vocabulary(texts, end):
    ids, at = np.concatenate([np.zeros(0, np.uint32), *texts]), np.r_[0, np.cumsum([len(t) for t in texts])]

    def count(before, start, after=None):
        keys = lm.pair_keys(ids, at, np.zeros(end + 1, np.int64) if before is None else before, start, end, after)
        return lm.as_table(*np.unique(keys, return_counts=True), start, end, after)

    return lm.Vocabulary.of(count)


def _small_model():
    rng = np.random.default_rng(0)
    vocabulary = _vocabulary([(rng.zipf(1.3, 300) % 1499).astype(np.uint32) for _ in range(50)], 1499)
    return rng, vocabulary, lm.initial(vocabulary)


def _flat(texts):
    return np.concatenate([np.zeros(0, np.uint32), *texts]), np.r_[0, np.cumsum([len(t) for t in texts])]


def test_language_model_is_a_distribution():
    _, vocabulary, p = _small_model()
    scorer = lm.Scorer(p, vocabulary, 1499)
    context = np.array([3, 5, 7, 11], np.uint32)
    before = scorer.logs(*_window(context, vocabulary))[0, :4].sum()
    after = [scorer.logs(*_window(np.append(context, x).astype(np.uint32), vocabulary))[0, :5].sum() - before for x in range(1500)]
    assert np.exp(after).sum() == pytest.approx(1, abs=1e-3)


def _window(ids, vocabulary):
    inputs, first, nexts, _ = lm.windows(*_flat([ids]), 1499, vocabulary)
    return inputs[first[:, None] + np.arange(lm.WINDOW)], nexts


def plain_score(ids, end, p, v):
    """The model written out for one text, one place at a time."""
    padded = [len(v.kind) - 1] * (lm.LEAD + 1) + [int(v.place[i]) for i in ids] + [0] * lm.WINDOW
    total = 0.0
    for n, target in enumerate([*ids.tolist(), end]):
        a = n // lm.STEP * lm.STEP  # the window that scores the n-th id begins here
        seen = padded[a : n + lm.LEAD + 1]
        e = p["e"][seen].astype(float)
        q = e[-1] @ p["q"]
        weights = np.exp([q @ (x @ p["k"]) / 4 + p["bias"][len(seen) - 1 - k] for k, x in enumerate(e)])
        h = np.tanh(weights @ (e @ p["v"]) / weights.sum() + e[-1] @ p["r"] + p["a"])
        z = h @ p["u"] + v.prior[seen[-1]]
        c = v.group[target]
        total += z[c] - np.log(np.exp(z).sum()) + v.share[v.kind[seen[-1]], target]
    return total / math.log(10)


def test_language_model_scores_as_plain_attention_does():
    rng, vocabulary, p = _small_model()
    p = {k: x + rng.standard_normal(x.shape).astype(np.float32) * 0.1 for k, x in p.items()}
    texts = [rng.integers(0, 1499, n).astype(np.uint32) for n in (0, 1, 7, 23, 24, 25, 48, 130)]
    expected = [plain_score(t, 1499, p, vocabulary) for t in texts]
    assert lm.Scorer(p, vocabulary, 1499).score(*_flat(texts)) == pytest.approx(expected, rel=1e-4)


def test_language_model_scores_each_id_once_and_alone():
    rng, vocabulary, p = _small_model()
    texts = [rng.integers(0, 1499, n).astype(np.uint32) for n in (0, 1, 23, 24, 25, 200)]
    _, _, nexts, count = lm.windows(*_flat(texts), 1499, vocabulary)
    assert [int((x >= 0).sum()) for x in np.split(nexts, np.cumsum(count)[:-1])] == [len(t) + 1 for t in texts]
    scorer = lm.Scorer(p, vocabulary, 1499)
    assert scorer.score(*_flat(texts)) == pytest.approx([scorer.score(*_flat([t]))[0] for t in texts], rel=1e-5)


def test_language_model_gradients():
    rng, vocabulary, p = _small_model()
    x, nexts = _window(rng.integers(0, 1499, 60), vocabulary)
    _, g = lm.gradients(p, x, nexts, vocabulary)
    for name in ("q", "k", "v", "r", "a", "u", "bias"):
        i = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        sides = []
        for step in (2e-2, -2e-2):
            moved = {n: v.copy() for n, v in p.items()}
            moved[name][i] += step
            sides.append(lm.gradients(moved, x, nexts, vocabulary)[0])
        assert g[name][i] == pytest.approx((sides[0] - sides[1]) / 4e-2, rel=0.15, abs=2e-4)


def test_language_model_gradients_of_training_windows():
    """Windows as training cuts them, without a lead; an embedding's derivatives are summed over all its places."""
    rng, vocabulary, p = _small_model()
    inputs, first, nexts, _ = lm.windows(*_flat([rng.integers(0, 40, 90).astype(np.uint32)]), 1499, vocabulary, 0)
    x = inputs[first[:, None] + np.arange(lm.WINDOW)]
    _, g = lm.gradients(p, x, nexts, vocabulary)
    used, d = g.pop("e")
    assert used.tolist() == sorted(set(x.ravel().tolist()))
    g["e"] = np.zeros_like(p["e"])
    g["e"][used] = d
    for name, found in g.items():
        i = np.unravel_index(np.argmax(np.abs(found)), found.shape)
        sides = []
        for step in (2e-2, -2e-2):
            moved = {n: v.copy() for n, v in p.items()}
            moved[name][i] += step
            sides.append(lm.gradients(moved, x, nexts, vocabulary)[0])
        assert found[i] == pytest.approx((sides[0] - sides[1]) / 4e-2, rel=0.15, abs=2e-4)


def test_language_model_learns():
    rng = np.random.default_rng(1)
    texts = [np.tile(rng.permutation(8)[:4], 30).astype(np.uint32) for _ in range(200)]
    vocabulary = _vocabulary(texts, 100)
    trainer = lm.Trainer(lm.initial(vocabulary), vocabulary)
    inputs, first, nexts, _ = lm.windows(*_flat(texts), 100, vocabulary)
    before = lm.Scorer(trainer.p, vocabulary, 100).score(*_flat(texts[:20])).sum()
    for a in range(0, len(first), 64):
        trainer.step(inputs[first[a : a + 64, None] + np.arange(lm.WINDOW)], nexts[a : a + 64])
    assert lm.Scorer(trainer.p, vocabulary, 100).score(*_flat(texts[:20])).sum() > 0.7 * before


def test_language_model_learns_from_every_training_document(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 5 == 1, np.append(rng.integers(0, 100, 40), 100 + i)[rng.permutation(41)].astype("<u4")) for i in range(100)]  # each has one id of its own
    vocabulary = _vocabulary([x for _, out, x in rows if not out], 200)
    held = spark.createDataFrame([(i, out, x.tobytes()) for i, out, x in rows], "doc_id long, held_out boolean, ids binary")
    for before, start, after in ((np.zeros(201, np.int64), 1, None), (vocabulary.place.astype(np.int64), len(vocabulary.kind) - 1, vocabulary.group.astype(np.int64))):
        keys = lm.pair_keys(*_flat([x for _, out, x in rows if not out]), before, start, 200, after)
        assert (lm.pairs(held, before, start, 200, after) == lm.as_table(*np.unique(keys, return_counts=True), start, 200, after)).all()
    moved = (lm.train(held, vocabulary, 200)["e"] != lm.initial(vocabulary)["e"]).any(1)
    assert [bool(moved[vocabulary.place[100 + i]]) for i, _, _ in rows] == [not out for _, out, _ in rows]


def leak_words(text):
    return [w for w in ("".join(filter(str.isalnum, x.lower())) for x in (text or "").split()) if w]


def test_leaks_are_those_of_a_full_search(spark, sf_dir, found, docs):
    """Every document that holds a whole item, word for word, and none that shares few five-word runs with any."""
    items = {r["item_id"]: leak_words(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in found("op8_decontamination")}
    for i, r in docs.items():
        w = leak_words(r["text"])
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        for j, item in items.items():
            own = [tuple(item[k : k + 5]) for k in range(len(item) - 4)]
            share = sum(x in runs for x in own) / len(own)
            if share > 0.95:
                assert (i, j) in got
            elif share < 0.2:
                assert (i, j) not in got


def test_paraphrases_are_found_and_clean_texts_are_not(spark):
    rng = np.random.default_rng(2)
    common = [f"common{k}" for k in range(30)]
    word = lambda: common[rng.integers(30)] if rng.random() < 0.5 else f"rare{rng.integers(100_000)}"
    items = [[word() for _ in range(40)] for _ in range(30)]
    texts = {}
    for k in range(400):
        texts[k] = [word() for _ in range(rng.integers(5, 400))]
    for k in range(30):  # every fifth word replaced, one dropped
        own = [word() if i % 5 == 4 else x for i, x in enumerate(items[k])]
        del own[7]
        texts[1000 + k] = texts[k][:50] + own + texts[k][50:]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in texts.items()], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, benchmark).collect()} == {(1000 + k, k) for k in range(30)}


@pytest.fixture(scope="module")
def searched(spark, sf_dir):
    """The texts' rows and the model, as a task has them."""
    rows, makers = decontaminate.models(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    table_ = rows.toArrow()
    return table_["c0"].to_pylist(), table_["words"].combine_chunks(), [make() for make in makers]


def test_the_cosine_loses_nothing_that_a_full_search_finds(searched, monkeypatch):
    """The search against the same checks on every place of every text for every passage."""
    _, texts, models = searched
    for m in models:
        found = m.search(texts)
        monkeypatch.setattr(decontaminate, "COSINE", -2.0)
        every = m.search(texts)
        monkeypatch.undo()
        assert [{j: v[:2] for j, v in x.items()} for x in found] == [{j: v[:2] for j, v in x.items()} for x in every] and any(every)


@pytest.mark.parametrize("replaced", [0.2, 0.3])
def test_recall_of_paraphrases(spark, sf_dir, replaced):
    """Items with so many of their words replaced, inside documents of the table."""
    rng = np.random.default_rng(8)
    base = [r["text"] for r in documents(spark, sf_dir).filter("text is not null").orderBy("doc_id").limit(60).collect()]
    items = {r["item_id"]: r["text"].split() for r in table(spark, sf_dir, "benchmark").collect()}
    rows = []
    for i, words_ in items.items():
        own = [rng.choice(base[i % 60].split() or ["x"]) if rng.random() < replaced else w for w in words_]
        host = base[(7 * i) % 60].split()
        rows.append((i, " ".join(host[:80] + own + host[80:160])))
    every = documents(spark, sf_dir).select((-1 - F.col("doc_id")).alias("doc_id"), "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(every, table(spark, sf_dir, "benchmark")).collect()}
    assert np.mean([(i, i) in found for i in items]) >= 0.9


def test_verbatim_passages_of_any_cosine_are_found(spark):
    rng = np.random.default_rng(12)
    texts = [[f"w{x}" for x in rng.zipf(1.2, 400) % 20_000] for _ in range(300)]
    items = [t[200 : 205 + i % 20] for i, t in enumerate(texts)]  # short items of long documents
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    assert {(i, i) for i in range(300)} <= {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, benchmark).collect()}


def test_copies_of_a_page_are_not_boilerplate(spark):
    page = "\n".join(f"line {k} of a page that was copied many times over" for k in range(8))
    rows = [(k, page if k % 3 == 0 else f"menu of the site\nwords of page {k} only\nand {k * k} more", "s") for k in range(90)]
    kept = linededup.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {i: t.removeprefix("menu of the site\n") for i, t, _ in rows}
    assert [r["doc_id"] for r in minhash.deduplicated(kept).collect() if r["text"] == page] == [0]


def test_lcs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 20)).tolist(), rng.integers(0, 8, rng.integers(0, 30)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert decontaminate.lcs(masks, len(a), b) == t[-1, -1]


def test_fingerprints(found, docs):
    rows = {r["doc_id"]: r for r in found("op9_fingerprint")}
    order = sorted(docs)
    for k, i in enumerate(order):
        text, after = docs[i]["text"] or "", docs[order[(k + 1) % len(order)]]["text"] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = rows[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.Fingerprint.of(text).hex() and r["edited_fingerprint"] == fingerprint.Fingerprint.of(edited).hex()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.5 > np.mean([r["near_next"] for r in rows.values()])


def plain_fingerprint(text):
    """(sums of SHA-512 words, signed counts of byte windows) with integers, one window at a time."""
    if not text:
        return (0,) * 8, [0] * 128
    whole, counts = [0] * 8, [0] * 256
    parts = text.encode().split(b"\n")
    for part in parts:
        d = hashlib.sha512(part).digest()
        whole = [(w + int.from_bytes(d[8 * k : 8 * k + 8], "little")) % 2**64 for k, w in enumerate(whole)]
    data = (b"\0" * 13).join(parts) + b"\0" * 13
    for k in range(len(data) - 13):
        if data[k]:
            x = int.from_bytes(data[k : k + 8], "little") * 0x9E3779B97F4A7C15 % 2**64
            x ^= int.from_bytes(data[k + 6 : k + 14], "little") * 0xC2B2AE3D27D4EB4F % 2**64
            counts[((x ^ x >> 29) * 0xD6E8FEB86659FD93 % 2**64) >> 56] += 1
    return tuple(whole), [a - b for a, b in zip(counts[0::2], counts[1::2])]


def test_fingerprints_and_likeness_are_those_of_plain_sums(found, docs):
    order = sorted(docs)
    rows = {r["doc_id"]: r for r in found("op9_fingerprint")}
    small = [k for k, i in enumerate(order) if len(docs[i]["text"] or "") < 3000][:25]
    for k in small:
        i, after = order[k], docs[order[(k + 1) % len(order)]]["text"] or ""
        text = docs[i]["text"] or ""
        cut = len(text) // 4
        own, edited, following = (plain_fingerprint(t) for t in (text, text[: len(text) - cut] + after[:cut], after))
        parsed = fingerprint.Fingerprint.parse(rows[i]["fingerprint"])
        assert (parsed.whole, parsed.lanes.tolist()) == own

        def likeness(a, b):
            if a[0] == b[0]:
                return 1.0
            norm = math.sqrt(sum(x * x for x in a[1]) * sum(x * x for x in b[1]))
            return min(1.0, max(0.0, sum(x * y for x, y in zip(a[1], b[1])) / norm)) if norm else 0.0

        assert (rows[i]["near_edited"], rows[i]["near_next"]) == pytest.approx((likeness(own, edited), likeness(own, following)), abs=1e-9)


def test_fingerprints_are_homomorphic():
    f = fingerprint.Fingerprint
    a, b, both = f.of("one line"), f.of("another\nand more"), f.of("and more\none line\nanother")
    assert (a + b).hex() == both.hex() and (both - b).hex() == a.hex() and f.parse(both.hex()).hex() == both.hex()
    assert f.of("").hex() == f.of(None).hex() and f.of("x").hex() != f.of("y").hex()


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest tables have too few held-out labels
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    rows = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in queries.op10_toxicity(spark, sf_dir).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x, _ in rows if x for b, y, _ in rows if not y]
    assert np.mean(pairs) > 0.8 and all(p == (s >= 0.7) for s, _, p in rows)


def test_toxicity_folds_and_excepts():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum*": 2.0}, ["idiot proof"])
    base = lexicon.score("a quiet day")
    assert lexicon.score("you 1d10t") > base and lexicon.score("уou іdіоt") > base and lexicon.score("scummy") > base
    assert lexicon.score("an idiot proof design") == base == lexicon.score("idiotic") and lexicon.score(None) == lexicon.score("")


def plain_matches(lexicon, text):
    """(start, end, weight) by trying every entry and phrase at every place."""
    free, best = [], {}
    for at in range(len(text)):
        if at and text[at - 1].isalpha():
            continue
        for p in lexicon.phrases:
            if text.startswith(p, at) and not text[at + len(p) : at + len(p) + 1].isalpha():
                free.append((at, at + len(p)))
        for e, w in lexicon.weights.items():
            stem = e.rstrip("*")
            closed = not text[at + len(stem) : at + len(stem) + 1].isalpha()
            if text.startswith(stem, at) and (e.endswith("*") or closed) and (at not in best or best[at][1] < w):
                best[at] = at + len(stem), w
    return sorted((s, e, w) for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in free))


def test_toxicity_matches_and_scores_are_those_of_plain_search(spark, sf_dir, found, docs):
    lexicon = toxicity.Lexicon({"ab": 1.0, "abc*": 2.5, "b*": 0.5, "bca": 3.0, "c": 0.25}, ["ab ca", "bca bca"])
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))
        assert sorted(lexicon.matches(text)) == plain_matches(lexicon, text)
    labels = table(spark, sf_dir, "labels")
    learned = toxicity.fit(documents(spark, sf_dir), labels.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    a, b = learned.curve
    rows = {r["doc_id"]: r for r in found("op10_toxicity")}
    for i in sorted(docs)[:60]:
        text = toxicity.folded(docs[i]["text"])
        evidence = sum(w for _, _, w in plain_matches(learned, text)) / math.log2(8 + text.count(" "))
        expected = 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * evidence))))
        assert rows[i]["score"] == pytest.approx(expected, rel=1e-9) and rows[i]["predicted"] == (rows[i]["score"] >= 0.7)


def test_pipeline_stages(spark, sf_dir, docs):
    import corpus_pipeline

    df = documents(spark, sf_dir)
    given, seen = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, sf_dir).persist()
        assert given.columns == df.columns, name
        seen.append({r["doc_id"]: r["text"] for r in given.collect()})
    poor, lines, copies, leaks = seen
    assert copies.keys() <= lines.keys() == poor.keys() <= docs.keys() and leaks.keys() <= copies.keys()
    assert all(set(lines[i].split("\n")) <= set((poor[i] or "").split("\n")) for i in lines if lines[i])
    expected = brute_components(lines, 5, 80)
    assert copies.keys() == {i for i, (_, root) in expected.items() if root == i}
    packed = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == leaks.keys()
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == leaks.keys()
