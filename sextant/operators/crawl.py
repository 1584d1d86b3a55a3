"""A focused crawl over a table of pages: robots rules, topical filter, priorities, politeness, frontier, waves.

Fetching is a join with pages (url, html), so a crawl is a loop over waves; each wave is one plan over all its URLs.
Clocks are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from . import upsert
from .lineage import cut
from .order import numbered

# Fixed values of the focused crawl.
KEYWORDS = ["sports", "championships", "league", "baseball", "mlb", "wbsc", "pitch", "bat", "base", "run"]
DOMAINS = ["en.wikipedia.org", "mlb.com", "wbsc.org", "espn.com"]
START, KEYWORD, DOMAIN, DAY, INLINK, DELAY = 1000, 40, 100, 10, 25, 1.0

#: Robots rules that may be broadcast.
BROADCAST_RULES = 50_000


def keyword_matches(text: Column, keywords: Iterable[str] = KEYWORDS) -> Column:
    """How many of the keywords occur in the lower-cased text, inside words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((low.contains(k).cast("int") for k in keywords), F.lit(0))


def on_topic(url: Column, anchor: Column, keywords: Iterable[str] = KEYWORDS) -> Column:
    """A keyword is a value of the URL's `q`, or occurs in the anchor text."""
    keywords = list(keywords)
    asked = F.coalesce(F.arrays_overlap(U.query_values(url, "q"), F.array(*map(F.lit, keywords))), F.lit(False))
    return asked | (keyword_matches(anchor, keywords) > 0)


def days_since(date: Column, now: Column) -> Column:
    """Whole days from an HTTP date to `now`; null if there is no such date."""
    at = F.try_to_timestamp(F.substring(date, 6, 64), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def priority(url: Column, anchor: Column, domain: Column, age_days: Column | None = None, in_links: Column | None = None, keywords: Iterable[str] = KEYWORDS, domains: Iterable[str] = DOMAINS) -> Column:
    """Less is sooner: keywords in anchor and URL, preferred domains (exactly) and in-links lower it, age raises it."""
    keywords = list(keywords)
    out = F.lit(START) - KEYWORD * (keyword_matches(anchor, keywords) + keyword_matches(url, keywords))
    out = out - F.when(F.coalesce(domain.isin(*domains), F.lit(False)), DOMAIN).otherwise(0)
    if age_days is not None:
        out = out + DAY * F.coalesce(age_days, F.lit(0))
    if in_links is not None:
        out = out - INLINK * F.coalesce(in_links, F.lit(0))
    return out.cast("long")


def _rules(text: str | None) -> RobotFileParser | None:
    if text is None:
        return None
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def _allowed(robots: pd.Series, url: pd.Series) -> pd.Series:
    parsers = {t: _rules(t) for t in robots.dropna().unique()}
    return pd.Series([bool(u is not None and (p := parsers.get(t)) and p.can_fetch("*", u)) for t, u in zip(robots, url)])


def _delay(robots: pd.Series) -> pd.Series:
    parsers = {t: _rules(t) for t in robots.dropna().unique()}
    return pd.Series([float(p.crawl_delay("*") or DELAY) if (p := parsers.get(t)) else DELAY for t in robots])


def permitted(links: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """The rows with `allowed` and `delay` by robots (domain, robots_txt). A domain without a file is denied; its delay is 1 s, as is a delay of 0."""
    rules = robots.groupBy("domain").agg(F.max("robots_txt").alias("robots_txt"))
    rules = F.broadcast(rules) if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else rules
    joined = links.withColumn("domain__", U.domain(F.col(url))).join(rules, F.col("domain__") == F.col("domain"), "left")
    out = joined.select(*links.columns, F.pandas_udf(_allowed, "boolean")("robots_txt", url).alias("allowed"), F.pandas_udf(_delay, "double")("robots_txt").alias("delay"))
    return out


def politeness(requests: DataFrame, domain: str = "domain", at: str = "at", delay: str | float = DELAY) -> DataFrame:
    """The requests with `wait`: seconds that are left of the delay since the domain's request before."""
    before = F.lag(at).over(Window.partitionBy(domain).orderBy(at))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    least = F.col(delay) if isinstance(delay, str) else F.lit(float(delay))
    return requests.withColumn("wait", F.when(before.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), least - gap / 1e6)))


def parsed(pages: DataFrame, url: str = "url", html: str = "html", parser: bool = False) -> DataFrame:
    """(url, title, text) of fetched pages; `parser` uses the standard library's instead of expressions."""
    return pages.select(F.col(url).alias("url"), H.title(F.col(html)).alias("title"), (H.parsed_text(html) if parser else H.text(F.col(html))).alias("text"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct (src, url, anchor) of the valid links of pages, absolute."""
    found = pages.select(F.col(url).alias("src"), F.explode(H.anchors(F.col(html))).alias("a"))
    absolute = found.select("src", U.resolve(F.col("src"), F.col("a.href")).alias("url"), F.col("a.anchor").alias("anchor"))
    return absolute.filter(U.is_valid(F.col("url"))).distinct()


def probed(responses: DataFrame) -> DataFrame:
    """(url, is_html) of header responses (url, content_type): what a HEAD request would tell."""
    return responses.select("url", F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)).alias("is_html"))


def fetched(responses: DataFrame) -> DataFrame:
    """(url, html) of responses (url, status, content_type, body) that are pages: status 200 and HTML."""
    return responses.filter((F.col("status") == 200) & F.coalesce(F.col("content_type").contains("text/html"), F.lit(False))).select("url", F.col("body").alias("html"))


def seeds(urls: DataFrame) -> DataFrame:
    """The frontier at the start: canonical URLs at wave 0."""
    u = U.canonical(F.col("url"))
    return urls.select(u.alias("url")).distinct().select(F.lit(0).alias("wave"), priority(F.col("url"), F.lit(""), U.domain(F.col("url"))).alias("priority"), "url")


def enqueued(visited: DataFrame, found: DataFrame, wave: int) -> DataFrame:
    """(wave, priority, url) of links (src, url, anchor) to URLs not visited yet. The page's own domain counts for the priority; of several links the best one holds."""
    u = found.withColumn("target", U.canonical(F.col("url")))
    p = priority(F.col("target"), F.col("anchor"), U.domain(F.col("src")))
    best = u.select(F.col("target").alias("url"), p.alias("p")).groupBy("url").agg(F.min("p").alias("priority"))
    return best.join(visited.select("url"), "url", "left_anti").select(F.lit(wave).alias("wave"), "priority", "url")


def ordered(frontier: DataFrame) -> DataFrame:
    """The frontier with `place`, from 1: by wave, priority, next crawl time if there is one, and URL."""
    keys = [c for c in ("wave", "priority", "next_crawl_time", "url") if c in frontier.columns]
    return numbered(frontier, "place", *keys, start=1)


def due(frontier: DataFrame, now: Column) -> DataFrame:
    """The entries whose time has come; the others stay deferred."""
    return frontier.filter(F.col("next_crawl_time") <= now)


def crawl_documents(pages: DataFrame, found: DataFrame, authors: Iterable[str] = ()) -> DataFrame:
    """Crawl documents of pages: content wrapped in tags, canonical out-links, no in-links yet."""
    out = found.groupBy("src").agg(F.array_sort(F.collect_set(U.canonical(F.col("url")))).alias("outlinks"))
    body = parsed(pages).withColumn("content", F.concat(F.lit("<DOC><DOCNO>"), F.col("url"), F.lit("</DOCNO><HEAD>"), F.col("title"), F.lit("</HEAD><TEXT>"), F.col("text"), F.lit("</TEXT></DOC>")))
    none = F.array().cast("array<string>")
    joined = body.join(out, F.col("url") == F.col("src"), "left")
    return joined.select("url", "content", none.alias("inlinks"), F.coalesce("outlinks", none).alias("outlinks"), F.array(*map(F.lit, authors)).cast("array<string>").alias("authors"))


def crawl(pages: DataFrame, start: DataFrame, robots: DataFrame | None = None, waves: int = 3, most: int = 10_000, keywords: Iterable[str] = KEYWORDS, focused: bool = True) -> DataFrame:
    """Crawl documents reached from `start` (url), with in-links, in at most so many waves and pages.

    `pages` is (url, html) with canonical URLs. A wave takes the frontier in order until `most` pages are read: URLs that
    robots rules deny, and those without a page, don't count.
    """
    web = pages.select(U.canonical(F.col("url")).alias("url"), "html").dropDuplicates(["url"])
    frontier = cut(seeds(start))
    visited = frontier.select("url")
    done, left = None, most
    for wave in range(waves):
        open_ = frontier if robots is None else permitted(frontier, robots).filter("allowed").drop("allowed", "delay")
        chosen = open_.join(web.select("url"), "url", "left_semi").orderBy("priority", "url").limit(left)
        got = cut(web.join(chosen.select("url"), "url", "left_semi"))
        left -= got.count()
        found = links(got)
        if focused:
            found = found.filter(on_topic(F.col("url"), F.col("anchor"), keywords))
        found = cut(found)
        edges = found.select(F.col("src"), U.canonical(F.col("url")).alias("dst")).distinct()
        new = crawl_documents(got, found)
        done = upsert.inlinks(new if done is None else upsert.pages(done, new), edges)
        done = cut(done)
        frontier = cut(enqueued(visited, found, wave + 1))
        visited = cut(visited.unionByName(frontier.select("url")))
        if left <= 0 or frontier.isEmpty():
            break
    return done
