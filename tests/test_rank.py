"""Scores and evaluation of a corpus of four documents, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sextant.operators import evaluate, index, rank

STOP = ["the", "a", "is"]
DOCS = [(1, "The cat sat. A cat is 9.5 kg"), (2, "dog and cat"), (3, "the bird"), (4, "Dog dog DOG")]
EXPECTED = {
    "okapi_tf": {1: 0.400000, 2: 0.666667, 4: 0.600000},
    "tfidf": {1: 0.277259, 2: 0.462098, 4: 0.415888},
    "bm25": {1: 0.680595, 2: 1.175573, 4: 0.923665},
    "bm25_literal": {1: 1.804167, 2: 3.116289, 4: 2.448513},
    "laplace": {1: -3.871201, 2: -3.218876, 4: -3.218876},
    "jelinek_mercer": {1: -2.420615, 2: -2.502844, 4: -2.545742},
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").persist()


@pytest.fixture(scope="module")
def scored(spark, docs):
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    return {r["doc_id"]: r for r in rank.search(docs, queries, list(EXPECTED), STOP).collect()}


@pytest.mark.parametrize("model", sorted(EXPECTED))
def test_models(scored, model):
    assert {k: round(r[model], 6) for k, r in scored.items()} == EXPECTED[model]


def test_index_gives_the_same_scores(spark, docs, scored, tmp_path):
    folder = f"file://{tmp_path}/index"
    built = index.build_or_read(spark, folder, docs, stop=STOP)
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    found = {r["doc_id"]: r for r in rank.search_index(built, queries, list(EXPECTED)).collect()}
    assert all(abs(found[k][m] - scored[k][m]) < 1e-9 for k in scored for m in EXPECTED)
    assert [r.asDict() for r in built.term("cat").select("doc_id", "positions").orderBy("doc_id").collect()] == [{"doc_id": 1, "positions": [1, 3]}, {"doc_id": 2, "positions": [3]}]


def test_ties_go_to_the_smaller_id(spark, docs):
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    best = rank.top(rank.search(docs, queries, ["laplace"], STOP), "laplace", 2).orderBy("rank").collect()
    assert [r["doc_id"] for r in best] == [2, 4]


def test_no_queries_and_unknown_terms(spark, docs):
    none = spark.createDataFrame([], "query_id string, text string")
    assert rank.search(docs, none, ["bm25"]).count() == 0
    odd = spark.createDataFrame([("q", "zebra"), ("r", None), ("s", "zebra cat")], "query_id string, text string")
    assert {(r["query_id"], r["doc_id"]) for r in rank.search(docs, odd, ["jelinek_mercer"], STOP).collect()} == {("s", 1), ("s", 2)}


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([("q", "cat")], "query_id string, text string")
    assert rank.search(none, queries, ["bm25", "laplace"]).count() == 0
    assert index.corpus_stats(index.counted(none)).first()["docs"] == 0


def test_statistics(spark, docs):
    posts = index.postings(index.token_rows(docs, STOP)).persist()
    one = index.corpus_stats(posts).first()
    assert (one["docs"], one["vocabulary"], one["tokens"], one["mean_len"]) == (4, 7, 12, 3.0)
    stats = {r["term"]: (r["df"], r["ttf"]) for r in index.term_stats(posts).collect()}
    assert stats["cat"] == (2, 3) and stats["dog"] == (2, 4) and stats["9.5"] == (1, 1)
    lengths = {r["doc_id"]: r["doc_len"] for r in index.doc_stats(docs, STOP).collect()}
    assert lengths == {1: 5, 2: 3, 3: 1, 4: 3}


def test_merging_partial_indexes_gives_the_whole(spark, docs):
    build = lambda d: index.postings(index.token_rows(d, STOP))
    whole = sorted(map(tuple, build(docs).select("term", "doc_id", "tf").collect()))
    merged = index.merge(build(docs.filter("doc_id < 3")), build(docs.filter("doc_id >= 3")))
    assert sorted(map(tuple, merged.select("term", "doc_id", "tf").collect())) == whole


def test_dictionary_is_dense_and_sorted(spark, docs):
    found = sorted((r["id"], r["term"]) for r in index.dictionary(index.token_rows(docs), "term").collect())
    assert [i for i, _ in found] == list(range(len(found))) and [t for _, t in found] == sorted(t for _, t in found)


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_pairs_of_query_and_document_take_no_shuffle(spark, docs):
    """F1, F3 to F9, F13, F21, F22: postings are dealt by document once; rows of queries times documents are not shuffled."""
    queries = spark.createDataFrame([("q", "cat dog"), ("r", "bird dog")], "query_id string, text string")
    asked = rank.query_terms(queries)
    for df in (rank.search(docs, queries, list(rank.MODELS)), rank.candidates(asked, rank.matching_postings(docs, asked)), rank.summed_hits(rank.met(rank.matching_postings(docs, asked), asked).withColumn("score", F.col("tf")))):
        assert not [x for x in _exchanges(df) if "query_id" in x and "doc_id" in x]


def test_tasks_of_pairs_are_bounded(spark, monkeypatch):
    """F8, F9, F13: twice the documents make twice the tasks, not larger ones."""
    monkeypatch.setattr(rank, "TASK_ROWS", 100)
    asked = spark.createDataFrame([(q, "cat", 1) for q in range(10)], "query_id long, term string, qtf long")
    tasks = lambda n: rank.met(spark.range(n).select(F.lit("cat").alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("doc_len"), F.lit(1).alias("tf")), asked).rdd.getNumPartitions()
    assert (tasks(200), tasks(400)) == (20, 40)


def test_repeated_ids_are_one_document(spark, docs):
    queries = spark.createDataFrame([("q", "cat dog")], "query_id string, text string")
    parts = spark.createDataFrame([(1, "The cat sat. A cat"), (1, "is 9.5 kg"), *DOCS[1:]], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rank.search(parts, queries, list(EXPECTED), STOP).collect()}
    assert {m: {k: round(r[m], 6) for k, r in found.items()} for m in EXPECTED} == EXPECTED


def test_postings_filtered_by_groups_of_documents(spark, docs):
    """the wanted pairs name a group of documents, so there is no table of queries' terms times documents."""
    asked = rank.query_terms(spark.createDataFrame([(11, "cat dog"), (12, "and")], "query_id long, text string"))
    posts = rank.matching_postings(docs, asked).withColumn("last", F.pmod("doc_id", F.lit(10)))
    found = rank.filtered(posts, asked.select("term", F.pmod("query_id", F.lit(10)).alias("last")), ["term", "last"])
    assert {(r["term"], r["doc_id"], r["tf"]) for r in found.collect()} == {("cat", 1, 2), ("and", 2, 1)}


# evaluation


@pytest.fixture(scope="module")
def run(spark):
    return spark.createDataFrame([("q", d, s) for d, s in [("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 7.0), ("e", 1.0)]], "query_id string, doc_id string, score double")


@pytest.fixture(scope="module")
def qrels(spark):
    return spark.createDataFrame([("q", "a", 2), ("q", "c", 1), ("q", "e", 1), ("q", "z", 1), ("none", "a", 0)], "query_id string, doc_id string, grade int")


def _values(df, key, value):
    return {r[key]: round(r[value], 6) for r in df.collect()}


def test_graded_metrics(run, qrels):
    rows = evaluate.judged(run, qrels)
    assert [r["doc_id"] for r in rows.orderBy("rank").collect()] == ["a", "b", "c", "d", "e"]
    cuts = evaluate.at_cuts(rows).persist()
    assert _values(cuts, "k", "precision") | {50: 0.08, 100: 0.04} == {5: 0.8, 10: 0.4, 20: 0.2, 50: 0.08, 100: 0.04}
    assert set(_values(cuts, "k", "recall").values()) == {0.8}
    f1 = _values(cuts, "k", "f1")
    assert (f1[5], f1[10], f1[20]) == (0.8, 0.533333, 0.32)
    assert evaluate.average_precision(rows).first()["average_precision"] == pytest.approx(0.56)
    assert evaluate.r_precision(rows).first()["r_precision"] == pytest.approx(0.8)
    assert _values(evaluate.ndcg(rows, qrels), "k", "ndcg")[5] == 0.852080


def test_trec_metrics(run, qrels):
    rows = evaluate.judged(run, qrels, trec=True)
    assert [r["doc_id"] for r in rows.orderBy("rank").collect()] == ["a", "b", "d", "c", "e"]
    assert evaluate.average_precision(rows, trec=True).first()["average_precision"] == pytest.approx(0.71)
    levels = [r["precision"] for r in evaluate.interpolated(rows).orderBy("level").collect()]
    assert levels == pytest.approx([2, 2, 2, 2, 2, 0.8, 0.8, 0.8, 0.8, 0, 0])


def test_queries_without_relevant_documents_are_left_out(spark, qrels):
    run = spark.createDataFrame([("none", "a", 1.0)], "query_id string, doc_id string, score double")
    assert evaluate.judged(run, qrels).count() == 0


def test_fractional_r_precision(spark, run):
    qrels = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 0.5)], "query_id string, doc_id string, grade double")
    assert evaluate.r_precision(evaluate.judged(run, qrels)).first()["r_precision"] == pytest.approx(0.5 * 1.0 + 0.5 * 0.75)


def test_both_conventions_agree_on_binary_grades(spark):
    run = spark.createDataFrame([("q", f"d{i:02}", 100.0 - i) for i in range(30)], "query_id string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", f"d{i:02}", int(i % 3 == 0)) for i in range(40)], "query_id string, doc_id string, grade int")
    a = evaluate.average_precision(evaluate.judged(run, qrels)).first()["average_precision"]
    b = evaluate.average_precision(evaluate.judged(run, qrels, True), True).first()["average_precision"]
    assert a == pytest.approx(b)
    assert evaluate.report(evaluate.metrics(run, qrels)).filter(F.col("query_id") == "all").count() > 0


def test_a_frequent_term_of_a_written_index_is_shared_among_tasks(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the the x"), F.col("id").cast("string")).alias("text"))
    index.write(index.build(docs), str(tmp_path / "index"))
    found = index.read(spark, str(tmp_path / "index")).term("the")
    files = {r["f"]: r["n"] for r in found.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sum(files.values()) == 2000 and len(files) > 1


def test_postings_of_odd_documents(spark):
    """Batches of documents, empty ones among them, against token rows that are grouped."""
    texts = [None, "", "b a b", " ", "a" * 3000, "Ä ä x.y x y", *(" ".join(f"w{i * j % 7}" for j in range(i % 40)) for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "tf", F.concat_ws(",", F.col("positions").cast("array<string>"))).collect()))
    assert rows(index.postings_of(docs, ["w3"])) == rows(index.postings(index.token_rows(docs, ["w3"])))
    assert index.counted(docs.filter("text = ''")).isEmpty()
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r["doc_id"] for r in index.counted(named).filter("term = 'b'").collect()} == {"d2"}
