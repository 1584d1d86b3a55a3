"""English stemmers after the published descriptions: Porter (1980, with its author's two later departures) and Porter2.

Spark has none, so they run as Arrow-batched functions, meant for distinct terms: see `operators.index.stemmed`.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the published algorithms.
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
PORTER2_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
PORTER2_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
PORTER2_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
PORTER2_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
PORTER2_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(200_000)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (PORTER_2, PORTER_3):
        s = _longest(w, rules)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + rules[s]
    s = _longest(w, PORTER_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short_end(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def porter_fixpoint(word: str) -> str:
    """Porter again and again until nothing changes."""
    while (once := porter(word)) != word:
        word = once
    return word


_V = "aeiouy"


def _region(word: str, start: int) -> int:
    """After the first non-vowel that follows a vowel, from `start` on."""
    m = re.compile(f"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short_syllable(w: str) -> bool:
    return bool(re.search(f"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(f"[{_V}][^{_V}]", w))


@lru_cache(200_000)
def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in PORTER2_WHOLE:
        return PORTER2_WHOLE[word]
    w = word.removeprefix("'")
    w = re.sub(f"(^|[{_V}])y", r"\1Y", w)
    pre = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(pre) if pre else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}].", w[:-1]):
        w = w[:-1]
    if w in PORTER2_AFTER_1A:
        return w.lower()
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(f"[{_V}]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLE):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    s = _longest(w, PORTER2_2)
    if s and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if s == "li":
            w = stem if stem[-1:] in tuple("cdeghkmnrt") else w
        elif s != "ogi" or stem.endswith("l"):
            w = stem + PORTER2_2[s]
    s = _longest(w, PORTER2_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + PORTER2_3[s]
    s = _longest(w, PORTER2_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


STEMMERS = {"porter": porter_fixpoint, "porter2": porter2}


def stem(word: Column | str, algorithm: str = "porter2") -> Column:
    """The stem of a column of lower-cased words; null stays null."""
    one = STEMMERS[algorithm]

    def run(words: pd.Series) -> pd.Series:
        return words.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(word)
