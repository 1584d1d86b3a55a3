import random

import pytest

#: Names that the operators use themselves.
CLASHING = "score host path row key band p h n rep root t i line lines kept c0 shard own salt held_out train batch total sig bands host__ path__ id__ gone__ again__ n_lines__ n_dropped__ host____ own____ kept____ text__ domain__ many near far size component_id least root_a bad left x key_ gh gp c1 label rows"


def sentence(rng, n, words="river stone light market winter garden letter engine planet copper silver window bridge forest candle market".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "er", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal texts, and extra columns with clashing names."""
    rng = random.Random(1)
    rows = [(k, sentence(rng, 60), "en", f"s{k % 3}", 0) for k in range(30)]
    rows += [(100, None, "en", "s0", 0), (101, "", None, None, None), (102, " \n\t ", "en", "s1", 3), (103, "12 34 ... !!", "en", "s1", 3)]
    rows += [(104, rows[0][1], "en", "s2", 0), (5, rows[5][1], "en", "s2", 0), (None, "no id here but some words", "en", "s0", 9), (105, "one", "en", None, 3)]
    rows += [(106, sentence(rng, 20_000), "de", "s0", 0), (107, "x" * 50_000, "de", "s0", 0), (108, "a\n" * 2_000, None, "s0", 0), (109, "zero\0byte 🙂 İé", "fr", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING.split():
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df.persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(20)] + [(21, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark(spark, odd_docs):
    texts = {r["doc_id"]: r["text"] for r in odd_docs.filter("doc_id < 30").collect()}
    return spark.createDataFrame([(0, " ".join(texts[3].split()[5:45])), (1, None), (2, ""), (3, "too short"), (None, "an item without a number and words of its own")], "item_id long, text string")
