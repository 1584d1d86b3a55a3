"""Subword ids of Arrow batches of texts, with the ids of each piece kept for reuse.

A tokenizer that drops white space and case and cuts words by PATTERN, such as the default one, is asked for each piece
once. Pieces are found on the texts' bytes: words of printable ASCII characters without apostrophes and of Latin and
Cyrillic letters are cut as the pattern does (runs of letters, single digits, runs of the rest), and only the
tokenizer's merges run on the pieces; any other word is a piece that goes through the whole tokenizer. A text with the
string of a special token, and any text under another kind of tokenizer, is encoded whole.
"""

from __future__ import annotations

import json
from itertools import chain
from pathlib import Path

import numpy as np

from .words import BLANKS, LOWER, Table, content, hashes, spans

#: Fixed value: the pattern that the word-level public vocabulary is cut by.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and whether a letter of two bytes (lead << 8 | second) is odd."""
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _OTHER
    kind[ord("'")] = _ODD
    kind[0x30:0x3A] = _DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:0xC0] = _LETTER
    kind[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1, 0xD2, 0xD3]] = _LETTER
    kind[BLANKS] = _BLANK
    odd = np.zeros(1 << 16, bool)
    for c in (0xD7, 0xF7, 0x130, 0x149, *range(0x482, 0x48A)):  # no letters, or letters whose lower case or composition is special
        first, second = chr(c).encode()
        odd[first << 8 | second] = True
    return kind, odd


_CLASS, _ODD_PAIR = _classes()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class Tokens:
    _own: dict[str, Tokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        suffix = spec["model"].get("end_of_word_suffix")
        lowered = '"Lowercase"' in json.dumps(spec.get("normalizer"))
        self.by_word = bool(suffix) and split.get("pattern", {}).get("Regex") == PATTERN and split.get("behavior") == "Removed" and lowered
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
            bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
            self.merges = Tokenizer.from_str(json.dumps(bare))
            self.letters = _byte_letters()
        self.forget()

    @classmethod
    def load(cls, path: str) -> Tokens:
        """One for each Python worker."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        """No pieces known: numbers of pieces, and the place of each number's ids in `ids`."""
        self.known = Table(21)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum())), sizes

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces, by merges alone and in one call: each piece's last id tells it from the next."""
        spelled = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.lower().encode())) for p in pieces]
        found = self.merges.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids
        ids = np.fromiter(found, np.uint32, len(found))
        at = np.flatnonzero(self.last[ids])
        return (ids, np.diff(at, prepend=-1)) if len(at) == len(pieces) else self._whole(pieces)

    def _learn(self, pieces: list[str], odd: np.ndarray) -> None:
        """Ids for new pieces, in their order."""
        ids, sizes = [self.ids], np.zeros(len(pieces), np.int64)
        order = np.argsort(odd, kind="stable").tolist()
        plain = int((~odd).sum())
        for lo, hi, encode in ((0, plain, self._merged), (plain, len(order), self._whole)):
            for a in range(lo, hi, 20_000):
                own = order[a : min(hi, a + 20_000)]
                found, n = encode([pieces[k] for k in own])
                ids.append(found)
                sizes[own] = n
        # numbers follow the order of encoding, so that ids stay one after the other
        self.ids = np.concatenate(ids)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes[order])])

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beginnings and ends of all pieces, and which are odd."""
        kind = _CLASS[data]
        lead = np.flatnonzero(data >= 0xC0)
        lead = lead[lead + 1 < len(data)]
        pair = data[lead].astype(np.int64) << 8 | data[lead + 1]
        kind[lead[_ODD_PAIR[pair]]] = _ODD
        strange = np.flatnonzero(kind == _ODD)
        if len(strange):
            begins, ends = spans(kind == _BLANK, at)
            own = np.unique(np.searchsorted(begins, strange, "right") - 1)
            size = ends[own] - begins[own]
            after = np.cumsum(size)
            kind[np.repeat(begins[own] - (after - size), size) + np.arange(int(size.sum()))] = _ODD
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        new[at[at < len(kind)]] = True
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(kind))
        inside = kind[begins] != _BLANK
        begins, ends = begins[inside], ends[inside]
        return begins, ends, kind[begins] == _ODD

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string column, one after the other, and how many each has; null texts have none."""
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_word:
            return self._whole([t or "" for t in column.to_pylist()])
        data, at = content(column)
        raw = data.tobytes()
        whole = [k for k in range(len(at) - 1) if any(s.encode() in raw[at[k] : at[k + 1]] for s in self.special)] if any(s.encode() in raw for s in self.special) else []
        begins, ends, odd = self._cut(data, at)
        low = LOWER[data]
        keys = hashes(low, begins, ends)
        numbers = self.known.find(keys).astype(np.int64)
        unknown = np.flatnonzero(numbers < 0)
        if len(unknown):
            _, one, back = np.unique(keys[unknown], return_index=True, return_inverse=True)
            one = unknown[one]
            raw = low.tobytes()
            self._learn([raw[x:y].decode() for x, y in zip(begins[one].tolist(), ends[one].tolist())], odd[one])
            base = len(self.first) - 1 - len(one)
            place = np.empty(len(one), np.int64)
            order = np.argsort(odd[one], kind="stable")
            place[order] = base + np.arange(len(one))
            numbers[unknown] = place[back]
            kept = min(len(one), self.known.left)
            self.known.add(keys[one][order], place[order].astype(np.int32))
        size = self.first[numbers + 1] - self.first[numbers]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(self.first[numbers] - (after - size), size) + np.arange(int(size.sum()))]
        if len(unknown) and kept < len(one):  # what found no room is forgotten
            self.first = self.first[: base + kept + 1].copy()
            self.ids = self.ids[: self.first[-1]].copy()
        edges = np.r_[0, after][np.searchsorted(begins, at)]
        sizes = np.diff(edges)
        if whole:
            texts = column.to_pylist()
            parts = np.split(ids, edges[1:-1])
            for k in whole:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes
