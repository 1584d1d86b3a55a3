"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. The number of a host's pages that contain a line, divided by the host's pages, is the line's
ratio; lines above `ratio`, on at least `min_pages` pages, are boilerplate of that host and are dropped from its pages.

`cleaned` counts a line, and a host's pages, once for each different text: copies of one page don't make its lines
boilerplate. `line_dedup` counts every page, as its SQL does.

Blank lines are never dropped. Pages without a host form one group. Null texts stay null; a page of boilerplate only
becomes an empty text; no row is dropped. Lines are compared by their 64-bit hash within a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold

RATIO, MIN_PAGES = 0.02, 3
#: Boilerplate lines of all hosts that may be broadcast, at 8 bytes each.
BROADCAST_LINES = 500_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _host(column: str) -> Column:
    return F.concat(F.lit("h"), F.col(column).cast("string"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines. A host has at most (its mean lines a page / ratio) of them.

    With `by_text`, equal texts of a host count as one page.
    """
    pages = docs.select(F.coalesce(_host(host_col), F.lit("-")).alias("host"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("page"))
    count = F.count_distinct("page") if by_text else F.count("*")
    lines = pages.select("host", "page", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(F.translate(x, "\t\r\f\v", "    ")) != ""), lambda x: F.xxhash64(x)))).alias("line"))
    often = lines.groupBy("host", "line").agg(count.alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("host").agg(count.alias("total"))
    return often.join(totals, "host").filter(F.col("n") > ratio * F.col("total")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_lines(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, text) of (row, host, text): each text without its host's boilerplate, which `bad` has as (host, lines)."""
    bad = bad.toDF("own", "bad")
    rows = rows.select("row", F.coalesce(F.concat(F.lit("h"), F.col("host").cast("string")), F.lit("-")).alias("host"), "text")
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(bad), F.col("host") == F.col("own"), "left")
    else:  # the hot hosts' pages go to many tasks
        bad = bad.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = rows.join(bad, (F.col("host") == F.col("own")) & (F.col("salt") == F.col("part")), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("bad"), F.xxhash64(x)) | (F.trim(F.translate(x, "\t\r\f\v", "    ")) == "")))
    sizes = joined.select("row", "text", kept.alias("kept"), F.coalesce(F.size(lines), F.lit(0)).alias("n"))
    sizes = sizes.select("row", "text", "kept", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("kept"), F.lit(0))).cast("long").alias("left"))
    text = F.when(F.col("n_lines") > F.col("left"), F.array_join("kept", "\n")).otherwise(F.col("text"))
    return sizes.select("row", "n_lines", (F.col("n_lines") - F.col("left")).alias("n_dropped"), text.alias("text"))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of every page."""
    bad = hold(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    out = drop_lines(docs.select(F.col("doc_id").alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text")), bad)
    return out.select(F.col("row").alias("doc_id"), "n_lines", "n_dropped", "text")


def cleaned(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of `docs`, with all their columns, without their hosts' boilerplate; `n_chars`, if there is one, follows the text."""
    bad = hold(boilerplate(docs, host_col, text_col, ratio, min_pages, by_text=True), "boilerplate")
    others = [c for c in docs.columns if c != text_col]
    out = drop_lines(docs.select(F.struct(*others).alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text")), bad)
    of = {c: F.col("row").getField(c) for c in others} | {text_col: F.col("text")}
    if "n_chars" in others:
        of["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(of["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(of[c].alias(c) for c in docs.columns))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce('h' || source, '-') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT doc_id, host, unnest(ls) AS line FROM d),
c AS (SELECT host, line, count(*) AS n FROM u WHERE NOT regexp_full_match(line, '\\s*') GROUP BY host, line HAVING count(*) >= {MIN_PAGES}),
t AS (SELECT host, count(*) AS total FROM d GROUP BY host),
b AS (SELECT c.host, list(line) AS bad FROM c JOIN t ON c.host = t.host WHERE n > {RATIO} * total GROUP BY c.host),
k AS (SELECT doc_id, text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(bad, x)) END AS kept
      FROM d LEFT JOIN b ON d.host = b.host)
SELECT doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped,
       CASE WHEN len(kept) < len(ls) THEN array_to_string(kept, chr(10)) ELSE text END AS text FROM k
"""
