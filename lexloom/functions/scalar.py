"""The text functions on Python strings: for Arrow UDFs, and the yardstick of the column functions."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex

from . import constants as C
from .segment import Segmenter, default_segmenter, fnv1a, is_dense, is_japanese, is_space

_SPACING = regex.compile(r"[\p{Alphabetic}\p{N}_.\-]")
_ALNUM = regex.compile(r"[\p{Alphabetic}\p{N}]")
_BREAK = regex.compile(r"(?w)\b", regex.V1)
_CAMEL = regex.compile(r"(?<=\p{Lowercase})(?=\p{Uppercase})", regex.V1)


def lowercase(s: str) -> str:
    """Lower case character by character, so a final sigma stays a sigma."""
    return s.lower() if "Σ" not in s else "".join(c.lower() for c in s)


def nfkc(s: str | None) -> str:
    return unicodedata.normalize("NFKC", s or "")


def normalize(s: str | None) -> str:
    return lowercase(nfkc(s))


def script_runs(s: str) -> list[tuple[str, str]]:
    """Maximal runs of (kind, text): ``dense``, ``spacing`` or ``other``."""
    out: list[tuple[str, str]] = []
    begin, kind = 0, ""
    for i, c in enumerate(s):
        k = "dense" if is_dense(c) else "spacing" if _SPACING.match(c) else "other"
        if k != kind:
            if i:
                out.append((kind, s[begin:i]))
            begin, kind = i, k
    if s:
        out.append((kind, s[begin:]))
    return out


def unicode_words(s: str) -> list[str]:
    """Pieces between Unicode word boundaries that hold a letter or number."""
    cuts = [m.start() for m in _BREAK.finditer(s)]
    edges = sorted({0, *cuts, len(s)})
    return [s[a:b] for a, b in zip(edges, edges[1:]) if _ALNUM.search(s[a:b])]


def identifier_parts(s: str) -> list[str]:
    """Lower-cased parts between ``_ - .`` and camel humps, if there are several."""
    parts = [lowercase(h) for p in regex.split(r"[_.\-]", s) if p for h in _CAMEL.split(p) if h]
    return parts if len(parts) > 1 else []


def spacing_words(run: str) -> list[str]:
    """Tokens of a spacing run: each word with its parts, then the parts of the whole run."""
    out = []
    for w in unicode_words(run):
        out.append(lowercase(w))
        out += identifier_parts(w)
    return out + identifier_parts(run)


def words(text: str | None, segmenter: Segmenter | None = None) -> list[str]:
    """Word tokens in order."""
    seg, out = segmenter or default_segmenter(), []
    for kind, run in script_runs(nfkc(text)):
        if kind == "spacing":
            out += spacing_words(run)
        elif kind == "dense":
            out += seg.words(run)
    return out


def squash(s: str) -> str:
    """White space runs as one space, none at the ends."""
    out, gap = [], False
    for c in s:
        if is_space(c):
            gap = True
        else:
            if gap and out:
                out.append(" ")
            gap = False
            out.append(c)
    return "".join(out)


def char_grams(text: str | None) -> list[str]:
    """Marked character trigrams of the normalized text."""
    s = squash(normalize(text))
    return [C.GRAM_MARK + s[i : i + 3] for i in range(len(s) - 2)]


def tokens(text: str | None) -> list[str]:
    return words(text) + char_grams(text)


def tokens_ngrams(text: str | None, n: int) -> list[str]:
    """Tokens, then windows of 2 to ``n`` words."""
    w = words(text)
    return w + char_grams(text) + [" ".join(w[i : i + k]) for k in range(2, n + 1) for i in range(len(w) - k + 1)]


def is_stopword(token: str) -> bool:
    if token in C.STOPWORDS:
        return True
    return len(token) == 2 and not all(map(is_japanese, token)) and any(c in C.FUNCTION_CHARS for c in token)


@dataclass(frozen=True)
class WeightedToken:
    token: str
    weight: float


def weighted_tokens(text: str | None, compat: bool = True) -> list[WeightedToken]:
    """Tokens with weights from the particle that follows a word.

    A trigram weighs a quarter of its heaviest character, and a character what
    the words painted over it weigh.  With ``compat`` a walk through the tokens
    stops for good at a token that the rest of its run doesn't hold (the second
    time that parts of an identifier are listed), so later characters weigh
    nothing; without, every run's own tokens are painted.
    """
    cased, seg = nfkc(text), default_segmenter()
    runs = script_runs(cased)
    groups: list[list[str]] = []
    blocked: list[bool] = []
    owner: list[int] = []
    barrier = False
    for r, (kind, run) in enumerate(runs):
        if kind == "other":
            barrier = barrier or any(c in C.BARRIERS for c in run)
            continue
        found = [spacing_words(run)] if kind == "spacing" else [[t] for t in seg.words(run)]
        for g in found:
            if g:
                groups.append(g)
                blocked.append(barrier)
                owner += [r] * len(g)
                barrier = False
    out: list[WeightedToken] = []
    for i, g in enumerate(groups):
        boost = 1.0
        if i + 1 < len(groups) and len(groups[i + 1]) == 1 and not blocked[i + 1]:
            boost = C.PARTICLES.get(groups[i + 1][0], 1.0)
        out += [WeightedToken(t, 0.0 if is_stopword(t) else boost) for t in g]
    low = lowercase(cased)
    paint = [0.0] * len(low)
    begin = at = 0
    for r, (kind, run) in enumerate(runs):
        here = lowercase(run)
        if kind != "other":
            first = at
            if compat:
                scan = 0
                while at < len(out):
                    found = here.find(out[at].token, scan)
                    if found < 0:
                        break
                    if found == scan:
                        scan += len(out[at].token)
                    at += 1
            else:
                while at < len(out) and owner[at] == r:
                    at += 1
            pos = 0
            for t in out[first:at]:
                found = here.find(t.token, pos if compat else 0)
                if found < 0:
                    continue
                for k in range(begin + found, min(begin + found + len(t.token), len(paint))):
                    paint[k] = max(paint[k], t.weight)
                if found == pos:
                    pos += len(t.token)
        begin += len(here)
    chars: list[str] = []
    weigh: list[float] = []
    for c, w in zip(low, paint):
        if is_space(c):
            if chars and chars[-1] != " ":
                chars.append(" ")
                weigh.append(0.0)
        else:
            chars.append(c)
            weigh.append(w)
    if chars and chars[-1] == " ":
        chars.pop()
        weigh.pop()
    out += [WeightedToken(C.GRAM_MARK + "".join(chars[i : i + 3]), C.TRIGRAM_FACTOR * max(weigh[i : i + 3])) for i in range(len(chars) - 2)]
    return out


def fnv1a_hex(data: bytes) -> str:
    return f"{fnv1a(data):016x}"


def content_hash(text: str | None) -> str:
    """A hash of the tokens, so of no case or white space."""
    return fnv1a_hex(" ".join(tokens(text)).encode())


def estimate_tokens(text: str | None) -> int:
    """A quarter of the characters, two thirds of those of scripts without spaces."""
    dense = sum(map(is_dense, text or ""))
    return (len(text or "") - dense) // 4 + dense * 2 // 3


def jaccard(a: str | None, b: str | None) -> float:
    x, y = set(tokens(a)), set(tokens(b))
    return len(x & y) / len(x | y) if x or y else 1.0


def sentiment(text: str | None) -> tuple[str, float, int, int]:
    """(polarity, confidence, positive words, negative words) by word lists."""
    plus = minus = 0
    w = words(text)

    def longest(token: str, en: frozenset[str], ja: frozenset[str]) -> int:
        lengths = [len(x.encode()) for x in ja if x in token or token in x]
        return max([*lengths, len(token.encode()) if token in en else 0])

    for t in w:
        p, m = longest(t, C.POSITIVE_EN, C.POSITIVE_JA), longest(t, C.NEGATIVE_EN, C.NEGATIVE_JA)
        plus += p > m
        minus += m > p
    return (*polarity(plus, minus, len(w)), plus, minus)


def polarity(plus: int, minus: int, n: int) -> tuple[str, float]:
    name = "positive" if plus > minus else "negative" if minus > plus else "neutral"
    if not n:
        return name, 0.0
    if not plus + minus:
        return name, 0.5
    return name, min(1.0, 0.5 + 0.5 * abs(plus - minus) / (plus + minus) * min(1.0, (plus + minus) / n))
