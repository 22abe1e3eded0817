"""Words and trigrams of many texts at once, for functions that run over Arrow batches and give back numbers only.

Lists of trigrams are many times as large as their texts.  What only counts
them goes through here: trigrams are numbers (three code points of 21 bits),
texts go by CHUNK characters at a time, and no list of them leaves the worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import constants as C
from . import scalar
from .text import _PLAIN, _fnv, gram_lists

#: Characters of texts that are worked on at once, one text at least.
CHUNK = 256 << 10

# over plain characters only, where \w is letters, digits and the underscore
_runs = re.compile(r"[\w.\-]+").findall
_simple = re.compile(r"[^\W_]+").findall
#: White space but for a lone blank.
_gaps = re.compile("[\\t\\n\\x0b\\f\\r][\\t\\n\\x0b\\f\\r ]*| [\\t\\n\\x0b\\f\\r ]+").sub
_LETTER, _LOWER, _UPPER, _LEFT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    """What each character is; the last entry stands for all that are never plain."""
    plain, out = re.compile(_PLAIN), np.full(0x2100, _LEFT, np.uint8)
    for i in range(len(out) - 1):
        if plain.match(c := chr(i)):
            out[i] = _LETTER * c.isalnum() + _LOWER * c.islower() + _UPPER * c.isupper()
    return out


_CLASS = _classes()


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _kinds(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text is of plain characters, and whether it may have more words than its runs of letters and digits."""
    code = _codes([t + " " for t in texts])
    kind = _CLASS[np.minimum(code, len(_CLASS) - 1)]
    letter = kind & _LETTER
    special = code == ord("_")
    special[:-1] |= ((code[:-1] == ord("-")) | (code[:-1] == ord("."))) & (letter[1:] > 0)
    special[1:] |= (code[1:] == ord("-")) & (letter[:-1] > 0)
    special[:-1] |= ((kind[:-1] & _LOWER) > 0) & ((kind[1:] & _UPPER) > 0)
    first = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return ~np.logical_or.reduceat((kind & _LEFT) > 0, first), np.logical_or.reduceat(special, first)


def chunks(texts: pa.Array, most: int = 0) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts, "" for null) of about ``most`` characters."""
    at, n, most = 0, len(texts), most or CHUNK
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    end = np.cumsum(size)
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most, side="right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


@lru_cache(1 << 16)
def _short_run(run: str) -> tuple[str, ...]:
    return tuple(scalar.spacing_words(run))


def _by_runs(text: str) -> list[str]:
    out: list[str] = []
    for run in _runs(text):
        word = run[:-1] if run[-1] == "." else run
        if word.isalnum() and (word.islower() or word[1:].islower() or word.isdigit()):
            out.append(word.lower())
        else:
            out += _short_run(run) if len(run) < 100 else scalar.spacing_words(run)
    return out


Kinds = tuple[np.ndarray, np.ndarray]


def word_lists(texts: list[str], kinds: Kinds | None = None) -> list[list[str]]:
    """``scalar.words`` of each text."""
    if not texts:
        return []
    return [scalar.words(t) if not p else _by_runs(t) if s else _simple(t.lower()) for t, p, s in zip(texts, *(kinds or _kinds(texts)))]


def squashed(texts: list[str], kinds: Kinds | None = None) -> list[str]:
    """What the trigrams of each text are taken from."""
    if not texts:
        return []
    return [_gaps(" ", t.lower()).strip(" ") if p else scalar.squash(scalar.normalize(t)) for t, p in zip(texts, (kinds or _kinds(texts))[0])]


class Grams:
    """The trigrams of texts in order, as numbers over the characters that occur: text, gram."""

    def __init__(self, texts: list[str], kinds: Kinds | None = None):
        texts = squashed(texts, kinds)
        code = _codes(texts)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.n = np.maximum(self.size - 2, 0)
        begins = np.ones(len(code), bool)
        last = np.cumsum(self.size)
        for k in (1, 2):
            begins[(last - k)[self.size >= k]] = False
        self.number = np.full(0x110000, -1, np.int32)
        self.number[code] = 0
        self.chars = np.flatnonzero(self.number == 0)
        a = self.a = len(self.chars)
        self.number[self.chars] = np.arange(a)
        small = self.number[code].astype(np.int64)
        at = begins[: max(len(code) - 2, 0)]
        self.gram = (((small[:-2] * a) + small[1:-1]) * a + small[2:])[at] if len(code) > 2 else small[:0]
        self.text = np.repeat(np.arange(len(texts)), self.n)

    def code(self, gram: np.ndarray) -> np.ndarray:
        """Three code points of 21 bits."""
        a = self.a
        return self.chars[gram // (a * a)] << 42 | self.chars[gram // a % a] << 21 | self.chars[gram % a]

    def each(self) -> list[np.ndarray]:
        """The grams of each text."""
        return np.split(self.gram, np.cumsum(self.n)[:-1]) if len(self.n) else []


#: Most numbers of a table over all possible trigrams, or of counts of texts times terms.
TABLE = 1 << 22


def gram_code(gram: str) -> int:
    """The number of a marked trigram."""
    return ord(gram[1]) << 42 | ord(gram[2]) << 21 | ord(gram[3])


class Terms:
    """Tokens that are looked for, numbered as given."""

    def __init__(self, terms: list[str]):
        grams = sorted((gram_code(t), i) for i, t in enumerate(terms) if t[:1] == C.GRAM_MARK and len(t) == 4)
        self.n = len(terms)
        self.words = {t: i for i, t in enumerate(terms) if t[:1] != C.GRAM_MARK}
        self.gram, self.gram_id = (np.array([g[k] for g in grams], np.int64) for k in (0, 1))

    def found(self, texts: list[str], different: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(text, term, tf) of the terms in each text by text and term, and of each text the number of its tokens and, if asked for, of its different ones."""
        kinds = _kinds(texts) if texts else None
        grams, n = Grams(texts, kinds), max(self.n, 1)
        total = grams.n.copy()
        distinct = np.array([len(np.unique(g)) for g in grams.each()], np.int64) if different else None
        if grams.a**3 <= TABLE:
            point = [grams.number[self.gram >> 42], grams.number[self.gram >> 21 & 0x1FFFFF], grams.number[self.gram & 0x1FFFFF]]
            known = np.minimum(np.minimum(point[0], point[1]), point[2]) >= 0
            table = np.full(max(grams.a**3, 1), -1, np.int64)
            table[((point[0].astype(np.int64) * grams.a + point[1]) * grams.a + point[2])[known]] = self.gram_id[known]
            ids = table[grams.gram]
        elif len(self.gram):
            code = grams.code(grams.gram)
            at = np.minimum(np.searchsorted(self.gram, code), len(self.gram) - 1)
            ids = np.where(self.gram[at] == code, self.gram_id[at], -1)
        else:
            ids = np.full(len(grams.gram), -1)
        hit = ids >= 0
        keys, get = [grams.text[hit] * n + ids[hit]], self.words.get
        for i, w in enumerate(word_lists(texts, kinds)):
            total[i] += len(w)
            if different:
                distinct[i] += len(set(w))
            keys.append(np.array([x for x in map(get, w) if x is not None], np.int64) + i * n)
        key = np.concatenate(keys)
        if n * len(texts) <= TABLE:
            count = np.bincount(key)
            key = np.flatnonzero(count)
            tf = count[key]
        else:
            key, tf = np.unique(key, return_counts=True)
        return key // n, key % n, tf, total, distinct


@lru_cache(1 << 16)
def is_stopword(word: str) -> bool:
    return scalar.is_stopword(word)


def content_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, number, names): the words that are no stop words of all texts in order, numbered by the names."""
    numbers: dict[str, int] = {}
    ids, sizes = [], []
    for w in word_lists(texts):
        own = [numbers.setdefault(x, len(numbers)) for x in w if not is_stopword(x)]
        ids += own
        sizes.append(len(own))
    return np.repeat(np.arange(len(texts)), sizes), np.array(ids, np.int64), pa.array(list(numbers), pa.string())


def edges(text: np.ndarray, word: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, a, b, w) both ways, in that order: the number of windows of a text's words that hold both a and b."""
    n = len(word)
    size = np.bincount(text) if n else np.zeros(0, np.int64)
    first = (np.cumsum(size) - size)[text]
    p, size = np.arange(n) - first, size[text]
    width = np.minimum(max(window, 2), size)
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    square = max(n_words, 1) ** 2
    for k in range(1, max(window, 2)):
        at = np.flatnonzero(p + k < size)
        w = np.minimum(p[at], size[at] - width[at]) - np.maximum(0, p[at] + k - width[at] + 1) + 1
        a, b = word[at], word[at + k]
        ok = (w > 0) & (a != b)
        t, a, b, w = text[at][ok] * square, a[ok], b[ok], w[ok]
        keys += [t + a * n_words + b, t + b * n_words + a]
        weights += [w, w]
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    w = np.bincount(back, weights=np.concatenate(weights), minlength=len(key))
    return key // square, key % square // max(n_words, 1), key % max(n_words, 1), w


def content_hashes(texts: list[str]) -> list[str]:
    """``scalar.content_hash`` of each text; the joined tokens don't leave the worker."""
    import pandas as pd

    if not texts:
        return []
    kinds = _kinds(texts)
    grams = pc.binary_join(gram_lists(squashed(texts, kinds)), " ").to_pylist()
    return _fnv(pd.Series([" ".join(filter(None, (" ".join(w), g))).encode("utf-8", "surrogatepass") for w, g in zip(word_lists(texts, kinds), grams)])).tolist()


class GramTotals:
    """How often each trigram stands in all texts so far."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, texts: list[str]) -> None:
        grams = Grams(texts)
        if grams.a**3 <= TABLE:
            count = np.bincount(grams.gram)
            some = np.flatnonzero(count)
            count = count[some]
        else:
            some, count = np.unique(grams.gram, return_counts=True)
        self.parts.append((grams.code(some), count))
        self.waiting += len(some)
        if self.waiting > 1 << 20:
            self.parts, self.waiting = [self.all()], 0

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        code, count = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p[k] for p in self.parts] for k in (0, 1)))
        code, back = np.unique(code, return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, back, count)
        return code, total
