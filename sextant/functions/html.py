"""HTML to text, titles and links.

The column expressions cover well-formed pages and stay inside the JVM; `parsed_text` runs the standard library's parser
over Arrow batches for pages that need one.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Elements whose content isn't text of the page.
DROPPED = ("script", "style", "iframe", "noscript", "footer", "nav", "header")
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def unescape(text: Column) -> Column:
    """The usual entities as characters; `&amp;` last, so nothing is decoded twice."""
    for entity, char in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title(html: Column) -> Column:
    """The first title element's text, empty if there is none."""
    return unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def titles(html: Column) -> Column:
    """The text of every title element."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), unescape)


def text(html: Column) -> Column:
    """Body text without the dropped elements and tags, letters, digits and white space only, runs of blanks as one."""
    body = F.when(html.rlike("(?i)<body[\\s>]"), F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body>|$)", 1)).otherwise(html)
    out = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    out = unescape(F.regexp_replace(out, r"<[^>]*>", " "))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def anchors(html: Column) -> Column:
    """array<struct<href, anchor>> of every `a` with an href that isn't a fragment alone."""
    pattern = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    hrefs = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    labels = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    pairs = F.transform(F.arrays_zip(hrefs.alias("href"), labels.alias("anchor")), lambda x: F.struct(unescape(x["href"]).alias("href"), strip(unescape(F.regexp_replace(x["anchor"], r"<[^>]*>", ""))).alias("anchor")))
    return F.filter(pairs, lambda x: ~x["href"].startswith("#"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipped, self.in_body, self.body, self.all = 0, False, [], []
        self.has_body = False

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.skipped += 1
        elif tag == "body":
            self.in_body = self.has_body = True

    def handle_endtag(self, tag):
        if tag in DROPPED and self.skipped:
            self.skipped -= 1
        elif tag == "body":
            self.in_body = False

    def handle_data(self, data):
        data = data.strip()
        if data and not self.skipped:
            self.all.append(data)
            if self.in_body:
                self.body.append(data)


def parse_text(html: str | None) -> str:
    """As `text`, by a real parser: pieces joined by one space, then everything but word characters and white space removed."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    joined = " ".join(reader.body if reader.has_body else reader.all)
    return "".join(c for c in joined if c.isalnum() or c == "_" or c.isspace())


def _parse_all(html: pd.Series) -> pd.Series:
    return html.map(parse_text)


def parsed_text(html: Column | str) -> Column:
    return F.pandas_udf(_parse_all, "string")(html)
