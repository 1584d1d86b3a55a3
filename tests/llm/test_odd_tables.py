"""Each operator on a table of odd rows and on an empty one: rows in, rows out, defined results."""

import pytest

from sextant.llm import decontaminate, fingerprint, langid, linededup, lm, minhash, packing, pii, quality, toxicity

PER_ROW = {
    "language": lambda d, l, b: langid.language_id(d),
    "lines": lambda d, l, b: linededup.line_dedup(d),
    "personal": lambda d, l, b: pii.digest(pii.personal_data(d)),
    "minhash": lambda d, l, b: minhash.near_duplicates(d, width=2),
    "quality": lambda d, l, b: quality.quality(d, l),
    "lm": lambda d, l, b: lm.language_model(d),
    "fingerprint": lambda d, l, b: fingerprint.with_neighbours(d),
    "toxicity": lambda d, l, b: toxicity.toxicity(d, l),
}
STAGES = {
    "packing": lambda d, l, b: packing.pack(d),
    "leaks": lambda d, l, b: decontaminate.leaks(d, b),
    "accepted": lambda d, l, b: quality.accepted(d, l),
    "cleaned": lambda d, l, b: linededup.cleaned(d),
    "deduplicated": lambda d, l, b: minhash.deduplicated(d),
    "decontaminated": lambda d, l, b: decontaminate.decontaminate(d, b),
}


@pytest.fixture(scope="module")
def results(odd_docs, labels, benchmark):
    found = {}

    def of(name):
        if name not in found:
            df = (PER_ROW | STAGES)[name](odd_docs, labels, benchmark)
            found[name] = df.columns, df.collect()
        return found[name]

    return of


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each_row(results, odd_docs, name):
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in odd_docs.select("doc_id").collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in results(name)[1]) == ids


@pytest.mark.parametrize("name", sorted(PER_ROW | STAGES))
def test_empty_table(no_docs, labels, benchmark, name):
    assert (PER_ROW | STAGES)[name](no_docs, labels, benchmark).count() == 0


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_language(results):
    rows = by_id(results("language")[1])
    for k in (100, 101, 102, 103):
        assert (rows[k]["lang_pred"], rows[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_lines(results, odd_docs):
    rows, texts = by_id(results("lines")[1]), by_id(odd_docs.collect())
    assert rows[100]["text"] is None and rows[100]["n_lines"] == 0 and rows[101]["text"] == ""
    assert rows[106]["text"] == texts[106]["text"]


def test_minhash(results):
    rows = by_id(results("minhash")[1])
    assert (rows[100]["n_shingles"], rows[101]["n_shingles"], rows[102]["n_shingles"], rows[105]["n_shingles"]) == (0, 0, 0, 1)
    assert rows[104]["component_id"] == 0 and not rows[104]["kept"] and rows[0]["kept"] and rows[None]["kept"] and rows[None]["component_id"] is None


def test_quality(results):
    rows = by_id(results("quality")[1])
    assert all(not rows[k]["kept"] for k in (100, 101, 102)) and all(0 <= r["score"] <= 1 for r in rows.values())


def test_lm(results):
    rows = by_id(results("lm")[1])
    assert rows[100]["n_tokens"] == rows[101]["n_tokens"] == 1 and rows[107]["n_tokens"] == 2
    assert rows[100]["score"] == rows[101]["score"] and all(r["score"] < 0 for r in rows.values())


def test_toxicity(results):
    rows = by_id(results("toxicity")[1])
    assert rows[100]["score"] == rows[101]["score"] and all(0 <= r["score"] <= 1 for r in rows.values())


def test_packing(results, odd_docs):
    rows = results("packing")[1]
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.select("doc_id").collect()}
    assert all(r["doc_tokens"] == 1 for r in rows if r["doc_id"] in (100, 101, 102))


def test_leaks(results):
    assert {(r["doc_id"], r["item_id"]) for r in results("leaks")[1]} == {(3, 0)}
    assert 3 not in by_id(results("decontaminated")[1]) and len(results("decontaminated")[1]) == 41


@pytest.mark.parametrize("name", ["accepted", "cleaned", "deduplicated", "decontaminated"])
def test_stages_keep_columns_and_values(results, odd_docs, name):
    columns, rows = results(name)
    assert columns == odd_docs.columns
    given = {tuple(r)[2:4] + tuple(r)[5:] for r in odd_docs.collect()}
    assert {tuple(r)[2:4] + tuple(r)[5:] for r in rows} <= given


def test_one_of_repeated_rows_stays(results):
    ids = [r["doc_id"] for r in results("deduplicated")[1]]
    assert ids.count(5) == 1 and 104 not in ids and None in ids and {100, 101, 102} <= set(ids)


def test_quality_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(odd_docs, none).count() == odd_docs.count()
    assert toxicity.toxicity(odd_docs, none).count() == odd_docs.count()


def test_empty_benchmark(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd_docs, none).count() == 0
    assert decontaminate.decontaminate(odd_docs, none).count() == odd_docs.count()
