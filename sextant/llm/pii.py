"""Personal data by weak supervision, in DataFrame functions only.

Four kinds (email, ip, card, phone) are defined by patterns and always reported. Other tokens that mix letters and
digits are candidates for secrets: labelers by pattern, gazetteer (the word before) and context (a sign of assignment,
quotes) vote on each, or abstain. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is; its posteriors train a logistic span classifier on shape and context, which decides on every candidate.
Counts of patterns are all that reaches the driver: at most 3**labelers times the feature cells.

Offsets are code points, ends exclusive. Null texts count as empty. Spans of one kind don't overlap; added spans that
overlap one of the four kinds are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the patterns: the same matches without Java's recursion on long runs. \G allows a match to start where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{10,}+"
GAZETTEER = "password|passwd|passphrase|pwd|secret|token|apikey|api_key|access_key|credential|auth|bearer|key"
_STEP = 512


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, m>>: start and text of the matches; the starts are the lengths of the gaps and matches before, summed in two levels."""
    found = "array<struct<s:bigint,m:string>>"
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())

    def inner(base, part):
        none = F.struct(base.cast("long").alias("p"), F.array().cast(found).alias("o"))

        def add(a, x):
            start = a["p"] + F.length(x["g"])
            return F.struct((start + F.length(x["m"])).alias("p"), F.concat(a["o"], F.array(F.struct(start.alias("s"), x["m"].alias("m")))).alias("o"))

        return F.aggregate(part, none, add)

    def outer(z):
        none = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast(f"array<{found}>").alias("o"))

        def add(a, c):
            r = inner(a["p"], F.slice(z, c * _STEP + 1, _STEP))
            return F.aggregate(F.array(r), a, lambda b, x: F.struct(x["p"].alias("p"), F.concat(b["o"], F.array(x["o"])).alias("o")))

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor(F.size(z) / _STEP).cast("int")), none, add)["o"])

    # one value for the lambda's free variable, so the regular expressions run once
    return F.flatten(F.transform(F.array(pairs), outer))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    back = F.reverse(d)

    def add(a, i):
        x = F.substring(back, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return a + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    d = _digits(m)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> list[Column]:
    """For each kind the valid spans; each pattern runs only over texts that hold a character it needs."""
    none = F.array().cast("array<struct<s:bigint,m:string>>")
    digit = text.rlike("[0-9]")
    needs = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    keep = lambda kind: lambda x: _valid(kind, x["m"])
    return [F.filter(F.when(needs[k], _spans(text, p)).otherwise(none), keep(k)).alias(k) for k, p in zip(KINDS, (EMAIL, IP, CARD, PHONE))]


def candidates(text: Column) -> Column:
    """array<struct<s, m, b>>: tokens of letters and digits with the 24 characters before them and the one after."""
    none = F.array().cast("array<struct<s:bigint,m:string>>")
    found = F.when(text.rlike("[0-9]"), _spans(text, SECRET)).otherwise(none)
    before = lambda x: F.substring(text, F.greatest(F.lit(1), x["s"] - 23).cast("int"), F.least(F.lit(24), x["s"]).cast("int"))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), F.lower(before(x)).alias("b")))


#: Labelers: 1 for a secret, -1 against, 0 abstains.
def votes(c: Column) -> list[Column]:
    m, b = c["m"], c["b"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    return [
        vote(m.rlike("^(?:AKIA[0-9A-Z]{12,}|[0-9a-f]{16,}|[0-9A-F]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,})$"), m.rlike("^[A-Za-z]+[0-9]{1,2}$")),
        vote(b.rlike(rf"(?:{GAZETTEER})\W{{0,4}}$"), b.rlike(r"[a-z]{2,}[.,]?\s$") & ~m.rlike("^[A-Z0-9]+$|^[0-9a-f]+$")),
        vote(b.rlike("[=:]\\s?[\"']?$"), b.rlike("[/@]$")),
        vote(F.length(F.regexp_replace(m, "[^0-9]", "")) * 4 >= F.length(m), F.length(F.regexp_replace(m, "[^0-9]", "")) * 8 < F.length(m)),
    ]


def features(c: Column) -> list[Column]:
    """Small whole numbers: length, share of digits, case, the word before, assignment, quote."""
    m, b = c["m"], c["b"]
    return [
        F.least(F.lit(4), F.floor(F.length(m) / 8)).cast("int"),
        F.floor(F.length(F.regexp_replace(m, "[^0-9]", "")) * 4 / F.length(m)).cast("int"),
        F.when(m.rlike("[A-Z]") & m.rlike("[a-z]"), 2).when(m.rlike("[A-Z]"), 1).otherwise(0),
        b.rlike(rf"(?:{GAZETTEER})\W{{0,4}}$").cast("int"),
        b.rlike("[=:]\\s?[\"']?$").cast("int"),
        b.rlike("[\"']$").cast("int"),
    ]


_LEVELS = (5, 5, 3, 2, 2, 2)


def em(patterns: dict[tuple, float], rounds: int = 100) -> tuple[dict[tuple, float], list[tuple[float, float]]]:
    """Posterior of each vote pattern, and each labeler's chance to be right on secrets and on others, when it votes."""
    if not patterns:
        return {}, []
    k = len(next(iter(patterns)))
    post = {v: min(0.95, max(0.05, 0.5 + 0.25 * sum(v))) for v in patterns}
    rel: list[tuple[float, float]] = []
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (sum(n * post[v] for v, n in patterns.items()) + 1) / (total + 2)
        rel = []
        for j in range(k):
            yes = [sum(n * post[v] for v, n in patterns.items() if v[j] == s) for s in (1, -1)]
            no = [sum(n * (1 - post[v]) for v, n in patterns.items() if v[j] == s) for s in (1, -1)]
            rel.append(((yes[0] + 4) / (sum(yes) + 5), (no[1] + 4) / (sum(no) + 5)))  # labelers are presumed better than chance
        new = {}
        for v in patterns:
            odds = math.log(prior / (1 - prior))
            for j, s in enumerate(v):
                a, b = rel[j]
                odds += math.log(a / (1 - b)) if s == 1 else math.log((1 - a) / b) if s == -1 else 0
            new[v] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
        moved = max(abs(new[v] - post[v]) for v in patterns)
        post = new
        if moved < 1e-9:
            break
    return post, rel


def train(cells: list[tuple[tuple, float, float]], rounds: int = 300) -> list[float]:
    """Logistic weights (bias, then one for each level of each feature) from (features, soft label, count) cells."""
    width = 1 + sum(_LEVELS)
    w = [0.0] * width
    starts = [1 + sum(_LEVELS[:j]) for j in range(len(_LEVELS))]
    rows = [([0] + [s + min(x, n - 1) for s, n, x in zip(starts, _LEVELS, f)], y, c) for f, y, c in cells]
    total = sum(c for _, _, c in rows) or 1
    for _ in range(rounds):
        grad = [-0.001 * x for x in w]
        for at, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] for i in at)))))
            for i in at:
                grad[i] += c / total * (y - p)
        w = [a + 2.0 * g for a, g in zip(w, grad)]
    return w


def fit(docs: DataFrame, text_col: str = "text") -> tuple[list[float], list[tuple[float, float]]]:
    """The span classifier's weights and the labelers' reliabilities, from all candidates of all texts."""
    c = docs.select(F.explode(candidates(F.col(text_col))).alias("c"))
    cells = c.select(F.array(*votes(F.col("c"))).alias("v"), F.array(*features(F.col("c"))).alias("f")).groupBy("v", "f").count().collect()
    patterns: dict[tuple, float] = {}
    for r in cells:
        patterns[tuple(r["v"])] = patterns.get(tuple(r["v"]), 0) + r["count"]
    post, reliabilities = em(patterns)
    return (train([(tuple(r["f"]), post[tuple(r["v"])], r["count"]) for r in cells]) if cells else []), reliabilities


def personal_data(docs: DataFrame, text_col: str = "text", weights: list[float] | None = None) -> DataFrame:
    """The rows of `docs` as (doc_id, email, ip, card, phone, secret): arrays of (s, e, m)."""
    weights = fit(docs, text_col)[0] if weights is None else weights
    text = F.coalesce(F.col("t"), F.lit(""))
    docs = docs.select("doc_id", F.col(text_col).alias("t"))
    if weights:
        starts = [1 + sum(_LEVELS[:j]) for j in range(len(_LEVELS))]
        table = F.array(*(F.lit(float(w)) for w in weights))

        def chosen(c):
            total = F.lit(float(weights[0]))
            for s, n, f in zip(starts, _LEVELS, features(c)):
                total = total + F.element_at(table, (F.least(f, F.lit(n - 1)) + s + 1).cast("int"))
            return total > 0

        secret = F.filter(candidates(text), chosen)
    else:
        secret = F.array().cast("array<struct<s:bigint,m:string,b:string>>")
    docs = docs.select("doc_id", *base_spans(text), secret.alias("secret"))
    ends = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), x["m"].alias("m"))).alias(k)
    docs = docs.select("doc_id", *(ends(k) for k in KINDS), ends("secret"))
    taken = F.concat(*KINDS)
    return docs.withColumn("secret", F.filter("secret", lambda x: ~F.exists(taken, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts, the hash of the four kinds' spans, and all spans as kind:start:end, by kind and start."""
    listed = lambda k: F.transform(k, lambda x: F.concat(F.lit(f"{k}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    base = [listed(k) for k in KINDS]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(*base, listed("secret")), ",").alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
    )
