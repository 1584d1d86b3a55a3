"""Ranked retrieval: eight scoring models in one pass over the postings of all queries' terms.

Queries are rows (query_id, term, qtf). Every model is a sum of one weight for each matched term and a number for each
document, so no table of candidates times terms is made: what a missing term adds to a language model depends on the
document's length alone and is added in closed form.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .index import cut_runs, repeated

#: Rows of query terms that may be broadcast.
BROADCAST_ROWS = 500_000
#: Distinct query terms that may be part of a plan.
LITERAL_TERMS = 20_000
#: Postings times the queries that ask for them, in one task.
TASK_ROWS = 4_000_000
K1, B, K2, LAMBDA, LEAST = 1.2, 0.75, 100.0, 0.21, 0.1
DIGITS = 6


def _n(column: str) -> Column:
    return F.col(column).cast("double")


def _okapi() -> Column:
    return _n("tf") / (_n("tf") + 0.5 + 1.5 * _n("doc_len") / _n("mean_len"))


def _saturated() -> Column:
    return (_n("tf") + K1 * _n("tf")) / (_n("tf") + K1 * ((1 - B) + B * _n("doc_len") / _n("mean_len")))


def _repeats() -> Column:
    return (_n("qtf") + K2 * _n("qtf")) / (_n("qtf") + K2)


def _rarity() -> Column:
    return F.ln((_n("docs") + 0.5) / (_n("df") + 0.5))


def _outside() -> Column:
    """The collection's tokens without the document's."""
    return F.greatest(_n("tokens") - _n("doc_len"), F.lit(1.0))


def _rest(frequency: Column) -> Column:
    """What the collection without the document gives a term."""
    return (1 - LAMBDA) * F.greatest(frequency, F.lit(LEAST)) / _outside()


def _nothing() -> Column:
    return F.lit(0.0)


#: name: (weight of a matched term, number for the document), as functions: columns need a session.
MODELS: dict[str, tuple[Callable[[], Column], Callable[[], Column]]] = {
    "okapi_tf": (_okapi, _nothing),
    "tfidf": (lambda: _okapi() * F.ln(_n("docs") / _n("df")), _nothing),
    "bm25": (lambda: _n("qtf") * _rarity() * _saturated(), _nothing),
    "bm25_k2": (lambda: _rarity() * _saturated() * _repeats(), _nothing),
    "bm25_literal": (lambda: F.ln(_n("docs") + 0.5 / _n("df") + 0.5) * _saturated() * _repeats(), _nothing),
    "laplace": (lambda: F.ln(_n("tf") + 1), lambda: -_n("n_distinct") * F.ln(_n("doc_len") + _n("vocabulary"))),
    "laplace_repeated": (lambda: _n("qtf") * F.ln(_n("tf") + 1), lambda: -_n("n_terms") * F.ln(_n("doc_len") + _n("vocabulary"))),
    "jelinek_mercer": (
        lambda: F.ln(LAMBDA * _n("tf") / _n("doc_len") + _rest(_n("ttf") - _n("tf"))) - F.ln(_rest(_n("ttf"))),
        lambda: _n("missing") - _n("n_distinct") * F.ln(_outside()),
    ),
}


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text", stop: Iterable[str] | None = None) -> DataFrame:
    """(query_id, term, qtf) from texts."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(F.col(text_col), stop)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _merged(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): rows of a repeated id are one document."""
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text")) if repeated(docs, "doc_id") else docs


def _matched(docs: DataFrame, terms: DataFrame, stop: Iterable[str] | None) -> DataFrame | None:
    """(doc_id, doc_len, t) of every document of (doc_id, text): its sorted tokens of the given terms. None if the terms are more than LITERAL_TERMS."""
    literal = [r["term"] for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
    if len(literal) > LITERAL_TERMS:
        return None
    known = "t in ({})".format(", ".join(f"'{t}'" for t in literal)) if literal else "false"  # tokens hold no quotes; one string is parsed faster than many literals are made
    every = docs.select("doc_id", tokens(F.col("text"), stop).alias("all"))
    return every.select("doc_id", F.size("all").alias("doc_len"), F.expr(f"sort_array(filter(all, t -> {known}))").alias("t"))


def _joined(docs: DataFrame, terms: DataFrame, stop: Iterable[str] | None) -> DataFrame:
    """(term, doc_id, doc_len, tf) of however many terms."""
    rows = docs.select("doc_id", tokens(F.col("text"), stop).alias("all"))
    rows = rows.select("doc_id", F.size("all").alias("doc_len"), F.explode("all").alias("term"))
    return rows.join(_small(terms.select("term").distinct()), "term", "left_semi").groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("tf"))


def _exploded(rows: DataFrame, cut: Column | str = "x") -> DataFrame:
    return rows.select("doc_id", "doc_len", F.explode(cut).alias("x")).select("x.term", "doc_id", "doc_len", "x.tf")


def matching_postings(documents: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text", stop: Iterable[str] | None = None) -> DataFrame:
    """(term, doc_id, doc_len, tf) of the given terms, straight from texts and without a shuffle; more than LITERAL_TERMS are matched by a join."""
    docs = _merged(documents, id_col, text_col)
    matched = _matched(docs, terms, stop)
    return _joined(docs, terms, stop) if matched is None else _exploded(*cut_runs(matched.filter(F.size("t") > 0)))


def met(posts: DataFrame, asked: DataFrame, rows: int | None = None) -> DataFrame:
    """Postings with the queries that ask for their terms, in tasks of some TASK_ROWS rows; `rows` is how many there are, counted if not given.

    Postings are dealt by document before they meet the queries. Groups of document and query then take no other
    shuffle, and their number in a task doesn't grow with the corpus.
    """
    if rows is None:
        posts, each = posts.persist(), asked.groupBy("term").agg(F.count("*").alias("m"))
        rows = posts.groupBy("term").agg(F.count("*").alias("n")).join(each, "term").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    n = max(posts.sparkSession.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))
    return posts.repartition(n, "doc_id").join(_small(asked), "term")


def filtered(posts: DataFrame, wanted: DataFrame, on: Iterable[str] = ("term", "doc_id")) -> DataFrame:
    """The postings of the (term, doc_id) pairs that are wanted: terms that must match, in given documents. `on` can name a group of documents in place of each."""
    return posts.join(_small(wanted.select(*on).distinct()), list(on), "left_semi").select(*posts.columns)


def _numbers(sizes: DataFrame) -> DataFrame:
    """One row from documents' lengths n; the vocabulary is left open."""
    sums = sizes.filter("n > 0").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    m = F.try_divide(F.col("tokens").cast("double"), F.col("docs"))
    return sums.select("docs", "tokens", m.alias("mean_len"), F.bround(m).cast("long").alias("rounded_len"), F.lit(None).cast("long").alias("vocabulary"))


def corpus_numbers(documents: DataFrame, text_col: str = "text", stop: Iterable[str] | None = None, with_vocabulary: bool = True) -> DataFrame:
    """The one row of `index.corpus_stats`, from texts: lengths need no shuffle, the vocabulary one of distinct terms."""
    one = _numbers(documents.select(F.size(tokens(F.col(text_col), stop)).alias("n")))
    if not with_vocabulary:
        return one
    one = one.drop("vocabulary")
    distinct = documents.select(F.explode(F.array_distinct(tokens(F.col(text_col), stop))).alias("t")).distinct().agg(F.count("*").alias("vocabulary"))
    return one.crossJoin(distinct)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def scores(queries: DataFrame, posts: DataFrame, terms: DataFrame, corpus: DataFrame, models: Iterable[str] = ("bm25",), rounded_mean: bool = False) -> DataFrame:
    """(query_id, doc_id, one column for each model) of every document with a term of the query.

    `posts` has (term, doc_id, tf, doc_len), `terms` (term, df, ttf), `corpus` is one row. Query terms that no document
    has count as missing ones. `rounded_mean` uses the mean length rounded half to even.
    """
    models = list(models)
    if rounded_mean:
        corpus = corpus.withColumn("mean_len", F.col("rounded_len").cast("double"))
    known = _small(queries).join(terms, "term").select("query_id", "term", "qtf", "df", "ttf").persist()
    each = queries.join(known.select("query_id", "term", "ttf"), ["query_id", "term"], "left")
    each = each.groupBy("query_id").agg(F.sum("qtf").alias("n_terms"), F.count("*").alias("n_distinct"), F.sum(F.ln((1 - LAMBDA) * F.greatest(F.coalesce(_n("ttf"), F.lit(0.0)), F.lit(LEAST)))).alias("missing"))
    rows = met(posts, known, known.agg(F.sum("df")).first()[0] or 0).crossJoin(F.broadcast(corpus))
    summed = rows.groupBy("query_id", "doc_id").agg(F.first("doc_len").alias("doc_len"), *(F.sum(MODELS[m][0]()).alias(m) for m in models))
    if any(m.startswith(("laplace", "jelinek")) for m in models):
        summed = summed.join(_small(each), "query_id").crossJoin(F.broadcast(corpus))
    return summed.select("query_id", "doc_id", *((F.col(m) + MODELS[m][1]()).alias(m) for m in models))


def top(scored: DataFrame, model: str, k: int = 1000) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k of each query. Scores are rounded first and ties go to the smaller doc_id, so the order is the same everywhere."""
    ranked = scored.select("query_id", "doc_id", (F.round(F.col(model), DIGITS) + 0.0).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(documents: DataFrame, queries: DataFrame, models: Iterable[str] = ("bm25",), stop: Iterable[str] | None = None, rounded_mean: bool = False) -> DataFrame:
    """`scores` without an index. Texts are cut into tokens once: a document's length and its tokens of any query are kept.

    Up to LITERAL_TERMS terms are a hash set in the plan; more are matched by a join.
    """
    models = list(models)
    wanted = query_terms(queries, stop=stop).persist()
    docs = _merged(documents, "doc_id", "text")
    matched = _matched(docs, wanted, stop)
    if matched is not None:
        rows, cut = cut_runs(matched)
        matched = rows.select("doc_id", "doc_len", cut.alias("x")).persist()
        posts, corpus = _exploded(matched), _numbers(matched.select(F.col("doc_len").alias("n")))
    else:
        posts, corpus = _joined(docs, wanted, stop).persist(), corpus_numbers(docs, stop=stop, with_vocabulary=False)
    terms = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
    if any(m.startswith("laplace") for m in models):
        corpus = corpus.drop("vocabulary").crossJoin(docs.select(F.explode(F.array_distinct(tokens(F.col("text"), stop))).alias("t")).distinct().agg(F.count("*").alias("vocabulary")))
    return scores(wanted, posts, terms, corpus, models, rounded_mean)


def search_index(index, queries: DataFrame, models: Iterable[str] = ("bm25",), rounded_mean: bool = False) -> DataFrame:
    """`scores` over a built index: only the queries' terms are read."""
    wanted = query_terms(queries).persist()
    posts = index.postings.select("term", "doc_id", "tf").join(_small(wanted.select("term").distinct()), "term", "left_semi")
    return scores(wanted, posts.join(index.docs, "doc_id"), index.terms, index.corpus, models, rounded_mean)


def unknown_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Query terms that no document has."""
    return queries.join(terms, "term", "left_anti")


def candidates(queries: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, doc_id) of every document with any term of the query."""
    return met(posts, queries).select("query_id", "doc_id").distinct()


def summed_hits(hits: DataFrame) -> DataFrame:
    """The score of a service that returns one score for each (query_id, term, doc_id): their sum."""
    return hits.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
