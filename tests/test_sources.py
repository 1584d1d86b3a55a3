"""Readers and writers over files, merged tables, crawl, assessment and streams."""

import random
import re
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sextant.functions import urls as U
from sextant.operators import assess, crawl, index, rank, upsert
from sextant.sources import readers, writers
from sextant.streaming import jobs


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return f"file://{path}"


RECORDS = """<DOC>
<DOCNO> A1 </DOCNO>
<TEXT> lost
first line
  second line
</TEXT>
<TEXT>
third
</TEXT>
</DOC>
<DOC>
<TEXT>
no number
</TEXT>
</DOC>
<DOC>
<DOCNO> A2 </DOCNO>
</DOC>
trailing
"""


def test_corpus(spark, tmp_path):
    put(tmp_path / "c", "one", RECORDS.encode() + b"\xff\n")
    put(tmp_path / "c", ".hidden", "<DOC>\n<DOCNO> H </DOCNO>\n</DOC>")
    put(tmp_path / "c", "two", "<DOC>\n<DOCNO> A1 </DOCNO>\n<TEXT>\nnewer\n</TEXT>\n</DOC>\n")
    path = f"file://{tmp_path}/c"
    rows = [(r["docno"], r["text"]) for r in readers.corpus(spark, path).collect()]
    assert sorted(rows, key=str) == sorted([("A1", "first line   second line third"), (None, "no number"), ("A2", ""), ("A1", "newer")], key=str)
    last = {r["docno"]: r["text"] for r in readers.corpus(spark, path, strip_lines=True, last_wins=True).collect()}
    assert last == {"A1": "newer", "A2": ""}


def test_small_files(spark, tmp_path):
    assert readers.words(spark, put(tmp_path, "stop", "the\na  of\n\n")) == ["a", "of", "the"]
    assert [r[0] for r in readers.doc_list(spark, put(tmp_path, "list", "0 header\n1 X\n1 Y z\n")).collect()] == ["X", "Y"]
    queries = readers.numbered_queries(spark, put(tmp_path, "q", "12.   The O.L.D. mill\nnothing\n13. Old\n13. New one\n"), ["the"])
    assert {r["query_id"]: r["query_text"] for r in queries.collect()} == {"12": "old mill", "13": "new one"}
    assert [r["line"] for r in readers.query_lines(spark, put(tmp_path, "l", " a b \n\nc\n")).orderBy("place").collect()] == ["a b", "", "c"]
    links = readers.link_lists(spark, put(tmp_path, "g", "T s1 s2\n\nU\nT s3\n"))
    assert {r["url"]: r["inlinks"] for r in links.collect()} == {"T": ["s3"], "U": []}
    writers.write_scalars(spark, {"DOCS": 4, "AVG": 3}, f"file://{tmp_path}/stats")
    assert readers.scalars(spark, f"file://{tmp_path}/stats") == {"DOCS": 4, "AVG": 3}


def test_judgements_and_runs(spark, tmp_path):
    qrels = {(r["query_id"], r["doc_id"]): (r["grade"], r["num_rel"]) for r in readers.qrels(spark, put(tmp_path, "qrels", "1 0 a 1\n1 0 a 2\n1 0 b\n1  0\tc 1 more\n")).collect()}
    assert qrels == {("1", "a"): (2.0, 4.0), ("1", "c"): (1.0, 4.0)}
    path = put(tmp_path, "run", "1 Q0 b 1 2.5 T\n1 Q0 a 2 2.5 T\n1 Q0 a 3 9 T\nshort line\n")
    assert [(r["doc_id"], r["rank"]) for r in readers.run(spark, path).orderBy("rank").collect()] == [("a", 1), ("a", 2), ("b", 3)]
    assert [(r["doc_id"], r["score"]) for r in readers.run(spark, path, distinct=True).orderBy("rank").collect()] == [("a", 9.0), ("b", 2.5)]


def test_run_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([("q", "a b", 3.0), ("q", "c", 2.0), ("q", "d", 2.0)], "query_id string, doc_id string, score double")
    ranked = writers.ranked_without_blanks(scored)
    assert [(r["doc_id"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("c", 1), ("d", 2)]
    writers.write_run(ranked, f"file://{tmp_path}/out", "Exp")
    assert [(r["doc_id"], r["score"], r["rank"]) for r in readers.run(spark, f"file://{tmp_path}/out").orderBy("rank").collect()] == [("c", 2.0, 1), ("d", 2.0, 2)]


def test_assessment_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.csv", "QueryID,AssessorID,DocID,Auto Grade,Grade\n1,me,http://x, 2, 1 \n1,me,http://y,2,\n")
    rows = readers.assessments(spark, path)
    assert sorted(r[0] for r in writers.qrels_lines(rows).collect()) == ["1 me http://x 1", "1 me http://y "]
    writers.write_qrels(rows, f"file://{tmp_path}/qrels")
    assert [(r["doc_id"], r["grade"]) for r in readers.qrels(spark, f"file://{tmp_path}/qrels").collect()] == [("http://x", 1.0)]
    back = writers.assessments_of(spark.createDataFrame([("1", "me", "d", 2)], "query_id string, assessor string, doc_id string, grade int"))
    assert back.columns == ["QueryID", "AssessorID", "DocID", "Auto Grade", "Grade"]


def test_scores_and_replacing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    writers.write_scores(spark.createDataFrame([("u", 0.5)], "url string, score double"), path)
    assert spark.read.text(path).first()[0] == "u\t0.5"
    table = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(table)
    writers.replace(spark, spark.read.parquet(table).filter("id > 0"), table)
    assert spark.read.parquet(table).count() == 2 and writers.exists(spark, table) and not writers.exists(spark, table + "x")


def page(url, content, inlinks, outlinks=(), authors=()):
    return url, content, list(inlinks), list(outlinks), list(authors)


def test_merging_pages(spark):
    old = spark.createDataFrame([page("a", "old", ["x"], ["o1"], ["me"]), page("b", None, ["y"])], upsert.CRAWL)
    new = spark.createDataFrame([page("a", "new", ["z", "x"], ["o2"]), page("c", "c", [])], upsert.CRAWL)
    rows = {r["url"]: r for r in upsert.pages(old, new).collect()}
    assert (rows["a"]["content"], rows["a"]["inlinks"], rows["a"]["outlinks"], rows["a"]["authors"]) == ("new", ["x", "z"], ["o1", "o2"], ["me"])
    assert rows["b"]["content"] is None and rows["c"]["inlinks"] == []
    linked = upsert.inlinks(upsert.pages(old, new), spark.createDataFrame([("s", "a"), ("s", "new"), ("s", "a")], "src string, dst string"))
    rows = {r["url"]: r for r in linked.collect()}
    assert rows["a"]["inlinks"] == ["s", "x", "z"] and rows["new"]["inlinks"] == ["s"] and rows["new"]["content"] is None
    assert sorted(r["url"] for r in upsert.with_content(linked).collect()) == ["a", "c"]


def test_documents_skip_blank_text(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "keep")], "docno string, text string")
    new = spark.createDataFrame([("1", "new"), ("2", " \t"), ("3", None)], "docno string, text string")
    assert {r["docno"]: r["text"] for r in upsert.documents(old, new).collect()} == {"1": "new", "2": "keep"}


# crawl


def test_priority(spark):
    row = spark.createDataFrame([("http://h/baseball", "MLB league", "espn.com")], "u string, a string, d string")
    assert row.select(crawl.priority(F.col("u"), F.col("a"), F.col("d"))).first()[0] == 740
    now = F.lit("2015-10-31 08:00:00").cast("timestamp")
    age = crawl.days_since(F.lit("Wed, 21 Oct 2015 07:28:00 GMT"), now)
    assert row.select(crawl.priority(F.lit("http://h/x"), F.lit(None).cast("string"), F.lit("h"), age, F.lit(2))).first()[0] == 1000 + 100 - 50
    assert row.select(crawl.days_since(F.lit("soon"), now)).first()[0] is None


def test_robots(spark):
    links = spark.createDataFrame([("http://a/x",), ("http://a/no/y",), ("http://b/x",), (None,)], "url string")
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /no/\nCrawl-delay: 3"), ("c", None)], "domain string, robots_txt string")
    rows = {r["url"]: (r["allowed"], r["delay"]) for r in crawl.permitted(links, robots).collect()}
    assert rows == {"http://a/x": (True, 3.0), "http://a/no/y": (False, 3.0), "http://b/x": (False, 1.0), None: (False, 1.0)}


def test_fetched(spark):
    rows = spark.createDataFrame([("a", 200, "text/html; charset=x", "A"), ("b", 404, "text/html", "B"), ("c", 200, "image/png", "C"), ("d", 200, None, "D")], "url string, status int, content_type string, body string")
    assert [r["url"] for r in crawl.fetched(rows).collect()] == ["a"]


def test_frontier(spark):
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = spark.createDataFrame([(1, 5, now, "z"), (0, 9, now, "b"), (0, 9, now, "a"), (0, 9, now + timedelta(seconds=9), "0")], "wave int, priority int, next_crawl_time timestamp, url string")
    assert [r["url"] for r in crawl.ordered(rows).orderBy("place").collect()] == ["a", "b", "0", "z"]
    assert crawl.due(rows, F.lit("2024-01-01 00:00:05").cast("timestamp")).count() == 3


def test_crawl_in_waves(spark):
    pages = {"http://h/a": '<title>A</title><a href="/b">base</a><a href="/c">other</a>', "http://h/b": '<a href="/a">bat</a><a href="/d">run</a>', "http://h/c": "", "http://h/d": "<p>end</p>"}
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    start = spark.createDataFrame([("http://H:80/a#x",)], "url string")
    rows = {r["url"]: r for r in crawl.crawl(df, start).collect()}
    assert sorted(rows) == ["http://h/a", "http://h/b", "http://h/d"]
    assert rows["http://h/a"]["outlinks"] == ["http://h/b"] and rows["http://h/b"]["inlinks"] == ["http://h/a"] and rows["http://h/d"]["inlinks"] == ["http://h/b"]
    assert len(crawl.crawl(df, start, focused=False, waves=1).filter("content is not null").collect()) == 1
    denied = spark.createDataFrame([("h", "User-agent: *\nDisallow: /")], "domain string, robots_txt string")
    assert crawl.crawl(df, start, robots=denied).filter("content is not null").count() == 0


# assessment


def test_wrapped_documents(spark):
    rows = spark.createDataFrame([("<DOC><DOCNO>u</DOCNO><HEAD> T </HEAD><TEXT>a\nb</TEXT></DOC>",), ("<HEAD></HEAD>",), (None,)], "c string").select(*assess.wrapped(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("u", "T", "a\nb"), (None, "", None), (None, None, None)]


def test_models_are_plugged_in(spark):
    df = spark.createDataFrame([("q", "t", "some text"), ("q", "u", None)], "query string, title string, text string")
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    for c in ("query", "title", "text"):
        df = assess.embedded(df, c, embed, f"{c}_v")
    rows = assess.assessed(df, "query_v", "title_v", "text_v").collect()
    assert [r["grade"] for r in rows] == [2, 2] and rows[0]["similarity"] == pytest.approx((1 + (9 + 1) / (2**0.5 * 82**0.5)) / 2)
    pairs = spark.createDataFrame([("q", "u", "t", "c" * 3000)], "query string, url string, title string, content string")
    ask = lambda rows: ['{"grade": %d}' % (len(c) == 1000) for c in rows["content"]]
    assert assess.graded_by_model(pairs, ask).first()["grade"] == 1


# streams


def test_streamed_index_is_the_batch_index(spark, tmp_path):
    rows = [(k, f"cat dog {'bird ' * k}") for k in range(6)]
    for k in range(3):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    jobs.index_stream(stream, f"file://{tmp_path}/index", f"file://{tmp_path}/log").awaitTermination()
    streamed = jobs.streamed_index(spark, f"file://{tmp_path}/index")
    batch = index.build(spark.createDataFrame(rows, "doc_id long, text string"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(streamed.terms) == key(batch.terms) and key(streamed.corpus) == key(batch.corpus)
    query = spark.createDataFrame([("q", "bird")], "query_id string, text string")
    assert rank.search_index(streamed, query).count() == 5


def test_streamed_upsert_and_visited(spark, tmp_path):
    batches = [[page("a", None, ["x"])], [page("a", "text", ["y"]), page("b", "b", [])]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, upsert.CRAWL).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema(upsert.CRAWL).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    jobs.upsert_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/log").awaitTermination()
    rows = {r["url"]: r for r in jobs.merged(spark, f"file://{tmp_path}/t").collect()}
    jobs.vacuum(spark, f"file://{tmp_path}/t")
    assert {r["url"]: r for r in jobs.merged(spark, f"file://{tmp_path}/t").collect()} == rows
    assert rows["a"]["content"] == "text" and rows["a"]["inlinks"] == ["x", "y"] and "b" in rows
    once = jobs.unvisited(stream.select("url")).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/log2").trigger(availableNow=True)
    once.start(f"file://{tmp_path}/urls").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"file://{tmp_path}/urls").collect()) == ["a", "b"]


def test_a_denied_page_takes_no_place_of_the_crawl(spark):
    pages = spark.createDataFrame([("http://h/en/a", "<p>no</p>"), ("http://h/b", "<p>yes</p>"), ("http://h/c", "<p>later</p>")], "url string, html string")
    start = spark.createDataFrame([("http://h/en/a",), ("http://h/0",), ("http://h/b",), ("http://h/c",)], "url string")
    robots = spark.createDataFrame([("h", "User-agent: *\nDisallow: /en/\n")], "domain string, robots_txt string")
    got = crawl.crawl(pages, start, robots, most=1, focused=False)
    assert [r["url"] for r in got.filter("content is not null").collect()] == ["http://h/b"]


def test_command_line(spark, tmp_path):
    from sextant.__main__ import main

    links = put(tmp_path, "links", "a b c\nb a\nc a\n")
    main(["pagerank", links, "--out", f"file://{tmp_path}/ranked"])
    assert [r["url"] for r in spark.read.parquet(f"file://{tmp_path}/ranked").orderBy("score").collect()][-1] == "a"
    pages = [("http://a", "sports news", ["http://b"], ["http://b"], []), ("http://b", "other words", ["http://a"], ["http://a"], [])]
    spark.createDataFrame(pages, upsert.CRAWL).write.parquet(f"file://{tmp_path}/crawl")
    main(["hits", f"file://{tmp_path}/crawl", "--out", f"file://{tmp_path}/hubs"])
    assert {r["kind"] for r in spark.read.parquet(f"file://{tmp_path}/hubs").collect()} == {"hub", "authority"}
    put(tmp_path / "c", "one", "<DOC>\n<DOCNO> A </DOCNO>\n<TEXT>\nriver stone\n</TEXT>\n</DOC>\n<DOC>\n<DOCNO> B </DOCNO>\n<TEXT>\nforest\n</TEXT>\n</DOC>")
    main(["search", f"file://{tmp_path}/c", put(tmp_path, "q", "1. river\n"), "--out", f"file://{tmp_path}/run"])
    assert [r["value"].split()[:4] for r in spark.read.parquet(f"file://{tmp_path}/run").collect()] == [["1", "Q0", "A", "1"]]


def test_created_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writers.create(spark, path, upsert.CRAWL)
    assert spark.read.parquet(path).count() == 0 and writers.delete(spark, path) and not writers.delete(spark, path)


def test_hash(spark):
    import hashlib

    assert spark.range(1).select(U.url_hash(F.lit("http://é"))).first()[0] == hashlib.md5("http://é".encode()).hexdigest()


def test_a_long_stream_of_judgements(spark, tmp_path):
    """one file of 40,000 judgements over two lines each; the time was quadratic in a file's words."""
    (tmp_path / "qrels").write_text("".join(f"{i % 7} 0\nd{i}\t {i % 3}\n\n" for i in range(40_000)) + "8 0 lost")
    began = time.time()
    found = readers.qrels_stream(spark, f"file://{tmp_path}/qrels")
    assert found.agg(F.count("*"), F.sum("grade"), F.max("num_rel")).first()[:2] == (40_000, sum(i % 3 for i in range(40_000)))
    assert time.time() - began < 60


def test_a_stream_of_judgements_over_blocks(spark, tmp_path):
    """words are numbered over all blocks of a file."""
    (tmp_path / "qrels").write_text("".join(f"q 0 d{i}\n{i}\n" for i in range(3_000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert {(r["doc_id"], r["grade"]) for r in readers.qrels_stream(spark, f"file://{tmp_path}/qrels").collect()} == {(f"d{i}", float(i)) for i in range(3_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_records_keep_blank_lines_at_the_end(spark):
    record = spark.createDataFrame([("<DOC>\n<DOCNO> A </DOCNO>\n<TEXT>\nfirst\n\n\n</TEXT>\n</DOC>",)], "r string")
    assert record.select(readers.record_text(F.col("r")).alias("x")).first()[0] == "first  "


def test_odd_records(spark):
    """Records of random pieces against a pattern that finds each block's last line."""
    dice = random.Random(3)
    pieces = ["<TEXT>", "</TEXT>", "\n", "\n", "a", " ", "<", "<DOCNO>", "</DOCNO>", "<TEXT>\n", "\n</TEXT>\n"]
    records = ["".join(dice.choices(pieces, k=dice.randrange(25))) for _ in range(2000)]
    blocks = lambda r: re.findall(r"(?s)<TEXT>[^\n]*\n(.*?)[^\n]*</TEXT>", r)
    lines = lambda r: [x for b in blocks(r) if b for x in b[:-1].split("\n")]
    number = lambda r: next((x.replace("<DOCNO>", "").replace("</DOCNO>", "").strip() for x in r.split("\n") if "<DOCNO>" in x), None)
    rows = spark.createDataFrame([(r,) for r in records], "r string").select("r", readers.docno(F.col("r")).alias("n"), readers.record_text(F.col("r")).alias("x"))
    assert [(r["n"], r["x"]) for r in rows.collect()] == [(number(r), " ".join(lines(r))) for r in records]


def test_long_lines_are_read_once(spark):
    """A line of 400,000 characters before the number and one in the text."""
    long = F.repeat(F.lit("word "), 80_000)
    record = F.concat(F.lit("<DOC>\n"), long, F.lit("\n<DOCNO> A </DOCNO>\n<TEXT>\n"), long, F.lit("\n</TEXT>\n</DOC>"), F.col("id").cast("string"))
    began = time.monotonic()
    row = spark.range(2).select(readers.docno(record).alias("n"), F.length(readers.record_text(record)).alias("x")).first()
    assert (row["n"], row["x"]) == ("A", 400_000)
    assert time.monotonic() - began < 20
