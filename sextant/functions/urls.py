"""URL functions as column expressions. Malformed URLs pass through instead of raising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
LONGEST = 512
DEFAULT_PORTS = ("80", "443")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, f"(?s){_PARTS}", group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def domain(url: Column) -> Column:
    """Host and port as written; empty if there is none."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def canonical(url: Column) -> Column:
    """http, host in lower case without a default port, runs of slashes in the path as one, no fragment; the path keeps its case."""
    host = F.lower(domain(url))
    port = F.regexp_extract(host, r":0*([0-9]+)$", 1)
    host = F.when(port.isin(*DEFAULT_PORTS), F.split(host, ":")[0]).otherwise(host)
    p = F.regexp_replace(path(url), "//+", "/")
    p = F.when((host != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
    query = _part(url, 4)
    query = F.when(query == "?", "").otherwise(query)
    broken = host.rlike(r":[^\]]*[^0-9\]][^\]]*$") | F.coalesce(port.try_cast("long") > 65535, F.lit(False))
    return F.when(broken, url).otherwise(F.concat(F.lit("http://"), host, p, query))


def is_valid(url: Column) -> Column:
    """A scheme, a host, and no more than 512 characters; false for null."""
    return F.coalesce((scheme(url) != "") & (domain(url) != "") & (F.length(url) <= LONGEST), F.lit(False))


def url_hash(url: Column) -> Column:
    """md5 as hex."""
    return F.md5(url.cast("binary"))


def query_values(url: Column, name: str = "q") -> Column:
    """All decoded, non-empty values of one query parameter; null if there are none."""
    found = F.regexp_extract_all(F.concat(F.lit("&"), F.substring(_part(url, 4), 2, 1 << 20)), F.lit(rf"(?<=&){name}=([^&]+)"), F.lit(1))
    decoded = F.transform(found, lambda v: F.coalesce(F.try_url_decode(v), v))
    return F.when(F.size(decoded) > 0, decoded)


def resolve(base: Column, href: Column) -> Column:
    """An href against its page's URL: absolute, scheme-relative, root-relative, query-only, or relative, with dot segments removed."""
    s, h, p = scheme(base), domain(base), path(base)
    root = F.concat(s, F.lit("://"), h)
    own_path, rest = F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.regexp_replace(p, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.when(own_path.startswith("/"), own_path).otherwise(F.concat(folder, own_path))
    absolute = F.concat(root, dotless(joined), rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(s, F.lit(":"), href))
        .when(href == "", base)
        .when(own_path == "", F.concat(root, p, F.when(rest.startswith("?"), rest).otherwise(F.concat(_part(base, 4), rest))))
        .otherwise(absolute)
    )


def dotless(p: Column) -> Column:
    """An absolute path without `.` and `..` segments."""
    segments = F.slice(F.split(p, "/"), 2, 1 << 20)
    last = F.element_at(segments, -1)

    def add(done, x):
        return F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    out = F.aggregate(segments, F.array().cast("array<string>"), add)
    out = F.when(last.isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    return F.concat(F.lit("/"), F.array_join(out, "/"))
