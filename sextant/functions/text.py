"""Text analysis as column expressions: tokens, cleaning, stop words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores, dots inside it included. Possessive, so that long runs need no stack.
TOKEN = r"[\p{L}\p{N}_]++(?:\.[\p{L}\p{N}_]++)*+"
_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^{_SPACES}+|{_SPACES}+$", "")


def not_blank(text: Column) -> Column:
    """Whether the text has anything but white space; false for null."""
    return F.coalesce(strip(text) != "", F.lit(False))


def without(words: Column, stop: Iterable[str] | None) -> Column:
    """The array without stop words. `isin` over literals becomes a hash set, so a list of any usual length costs one probe a word."""
    stop = sorted(set(stop or ()))
    return F.filter(words, lambda w: ~w.isin(stop)) if stop else words


def tokens(text: Column, stop: Iterable[str] | None = None) -> Column:
    """Lower-cased tokens in order; null text has none. `98.6` and `192.160.0.1` stay whole, `123,456` and `aunt's` fall apart."""
    return without(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), stop)


def query_tokens(line: Column, stop: Iterable[str] | None = None) -> tuple[Column, Column]:
    """(id, terms) of a raw query line: the first token that survives is the id, the rest are terms. One token alone has no terms."""
    found = tokens(line, stop)
    return F.get(found, 0), F.when(F.size(found) > 1, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def clean_text(text: Column, stop: Iterable[str] | None = None) -> Column:
    """Letters, digits and white space only (`U.S.` becomes `us`), lower-cased, without stop words, joined by one space."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}\s{_SPACES[3:-1]}]", ""))
    return F.array_join(without(F.filter(F.split(kept, rf"{_SPACES}+"), lambda w: w != ""), stop), " ")


def alnum_words(text: Column) -> Column:
    """Blank-separated words made of ASCII letters and digits only; others are dropped whole."""
    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w.rlike("^[A-Za-z0-9]+$")), " ")


def first_chars(text: Column, n: int = 1000) -> Column:
    """The text's beginning, as given to a grader."""
    return F.substring(text, 1, n)
