"""Segmentation of text without spaces: character classes, boundary features and the boundary model."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from functools import lru_cache

from .constants import DENSE_RANGES, default_weights

NUMERAL, HAN, HIRA, KATA, PUNCT, ASCII, DIGIT, REST = "MHIKPANO"
_NUMERALS = frozenset("一二三四五六七八九十百千万億兆")
_PUNCT = frozenset("。、！？「」『』（）・…　，")
_SPACE = frozenset(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def is_space(c: str) -> bool:
    """Unicode White_Space."""
    return c in _SPACE


def is_dense(c: str) -> bool:
    """Whether a character's script is written without spaces."""
    return c >= "ᄀ" and any(a <= ord(c) <= b for a, b in DENSE_RANGES)


@lru_cache(1 << 16)
def char_class(c: str) -> str:
    """One of eight classes, by letter."""
    o = ord(c)
    if c in _NUMERALS:
        return NUMERAL
    if c in _PUNCT or c in _SPACE or (0x21 <= o <= 0x7E and not c.isalnum()):
        return PUNCT
    if 0x3040 <= o <= 0x309F:
        return HIRA
    if 0x30A0 <= o <= 0x30FF or 0x31F0 <= o <= 0x31FF:
        return KATA
    if o == 0x3005 or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return HAN
    if o < 0x80 and c.isalpha():
        return ASCII
    if o < 0x80 and c.isdigit():
        return DIGIT
    return REST


def is_japanese(c: str) -> bool:
    return char_class(c) in "IKHM"


def features(chars: Sequence[str], i: int, prior: Sequence[str] = ()) -> list[str]:
    """The 42 keys of the gap after ``chars[i]``; ``prior`` has earlier decisions (B or O), nearest first."""
    n = len(chars)
    at = [i + k for k in range(-2, 4)]
    w = ["B" if j < 0 else "E" if j >= n else chars[j] for j in at]
    k = [char_class(chars[j]) if 0 <= j < n else "O" for j in at]
    p1, p2, p3 = (*prior[:3], "O", "O", "O")[:3]
    runs = {"B": [(1, 3), (2, 4), (3, 5)], "T": [(0, 3), (1, 4), (2, 5), (3, 6)]}
    keys = [f"UW{j + 1}:{w[j]}" for j in range(6)]
    keys += [f"BW{j}:{''.join(w[a:b])}" for j, (a, b) in enumerate(runs["B"], 1)]
    keys += [f"UC{j + 1}:{k[j]}" for j in range(6)]
    for kind in "BT":
        keys += [f"{kind}C{j}:{''.join(k[a:b])}" for j, (a, b) in enumerate(runs[kind], 1)]
    keys += [f"UP{j}:{p}" for j, p in enumerate((p1, p2, p3), 1)]
    keys += [f"BP1:{p2}{p1}", f"BP2:{p1}"]
    keys += [f"UQ{j + 1}:{k[j]}{p1}" for j in range(3)]
    keys += [f"BQ{j}:{''.join(k[a:b])}{p1}" for j, (a, b) in enumerate(runs["B"], 1)]
    keys += [f"BQ4:{k[2]}{p2}{p1}"]
    keys += [f"TQ{j}:{''.join(k[a:b])}{p1}" for j, (a, b) in enumerate(runs["T"], 1)]
    keys += [f"WC{j}:{w[a]}{k[b]}" for j, (a, b) in enumerate([(2, 2), (3, 3), (2, 3), (3, 2)], 1)]
    return keys


class Segmenter:
    """Splits Japanese runs where the summed weights of a gap's features are positive."""

    def __init__(self, weights: Mapping[str, float] | None = None, bias: float = 0.0):
        self.weights = dict(default_weights() if weights is None else weights)
        self.bias = bias

    def split(self, run: str) -> list[str]:
        """Words of a run of Japanese characters."""
        out, begin, prior = [], 0, []
        get = self.weights.get
        for i in range(len(run) - 1):
            score = self.bias
            for key in features(run, i, prior):
                score += get(key, 0.0)
            cut = score > 0
            if cut:
                out.append(run[begin : i + 1])
                begin = i + 1
            prior = ["B" if cut else "O", *prior[:2]]
        if run:
            out.append(run[begin:])
        return out

    def words(self, text: str) -> list[str]:
        """Words of a run without spaces: Japanese parts by the model, others as pairs of characters."""
        out, i = [], 0
        while i < len(text):
            ja, j = is_japanese(text[i]), i + 1
            while j < len(text) and is_japanese(text[j]) == ja:
                j += 1
            part = text[i:j]
            if len(part) == 1:
                out.append(part)
            elif ja:
                out += self.split(part)
            else:
                out += [part[a : a + 2] for a in range(len(part) - 1)]
            i = j
        return out


@lru_cache(1)
def default_segmenter() -> Segmenter:
    return Segmenter()


# -- model files

FNV_BASIS, FNV_PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
_HEAD, _ENTRY = struct.Struct("<4sHHfIQ"), struct.Struct("<Qf")


def fnv1a(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def encode_model(bias: float, weights: Mapping[str, float], data_hash: int = 0) -> bytes:
    """A model as bytes: a header, then entries in order of the hashes of their features."""
    entries = sorted((fnv1a(k.encode()), v) for k, v in weights.items())
    if len({h for h, _ in entries}) != len(entries):
        raise ValueError("two features have the same hash")
    return _HEAD.pack(b"LXSG", 1, 0, bias, len(entries), data_hash) + b"".join(_ENTRY.pack(*e) for e in entries)


class ModelFile:
    """A model read from bytes; weights are found by the hash of a feature."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size:
            raise ValueError("shorter than a header")
        magic, version, _, self.bias, n, self.data_hash = _HEAD.unpack_from(data)
        if magic != b"LXSG":
            raise ValueError("not a model")
        if version != 1:
            raise ValueError(f"version {version} isn't supported")
        if len(data) < _HEAD.size + n * _ENTRY.size:
            raise ValueError("fewer entries than declared")
        self._weights = dict(_ENTRY.iter_unpack(data[_HEAD.size : _HEAD.size + n * _ENTRY.size]))

    def __len__(self) -> int:
        return len(self._weights)

    def lookup(self, feature: str) -> float:
        return self._weights.get(fnv1a(feature.encode()), 0.0)

    def segmenter(self, names: Sequence[str]) -> Segmenter:
        """A segmenter over the named features."""
        return Segmenter({k: self.lookup(k) for k in names}, self.bias)
