"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A chunk is one byte buffer with the offsets of its documents, so that the
operators run a few numpy passes over megabytes instead of a Python loop over
documents.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 18
GRAM = U64(0x9FB21C651E98DF25)

_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> None:
    """Grow the tables of the powers of the base and of its inverse mod 2**64."""
    global _pow, _inv
    if len(_pow) >= n:
        return
    n = max(n, CHUNK_BYTES + 1024)

    def table(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    _pow, _inv = table(_P), table(pow(_P, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def char_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words ``[^\x20\x09-\x0D]+`` and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACED = char_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = char_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Chunk:
    """Bytes ``buf`` of ``n`` documents at ``off[i]:off[i+1]``; ``rows`` are their rows in the batch."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, first: int = 0):
        self.buf, self.off, self.first, self.n = buf, off, first, len(off) - 1

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.buf], self.off, self.first)

    def words(self, table: np.ndarray) -> Words:
        inside = table[self.buf]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        if len(before):
            before[0] = False
            before[self.off[:-1][self.off[:-1] < len(before)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(after):
            after[-1] = False
            cut = self.off[1:] - 1
            after[cut[(cut >= 0)]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(self, starts, ends)


class Words:
    """The words of a chunk: byte spans, and per document the index ``first[i]:first[i+1]`` of its words."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray):
        self.chunk, self.starts, self.ends = chunk, starts, ends
        self.first = np.searchsorted(starts, chunk.off)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.chunk.n), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.chunk.buf, self.starts, self.ends)


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    _powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _pow[: len(buf)], out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    if prefix is None:
        prefix = prefix_hashes(buf)
    x = (prefix[ends] - prefix[starts]) * _inv[starts]
    return mix(x ^ ((ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every window of ``n`` consecutive items (windows over the end of ``h`` are left out)."""
    m = max(0, len(h) - n + 1)
    x = np.zeros(m, np.uint64)
    for k in range(n):
        x = x * GRAM + h[k : k + m]
    return mix(x)


def inside_one(first: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which windows of ``n`` items that start at an item lie within one document."""
    m = max(0, total - n + 1)
    ok = np.ones(m, bool)
    for k in range(1, n):
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about ``most`` bytes, of at least one document each."""
    buf, off = column_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield Chunk(buf[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i+1]]``, of empty ranges 0."""
    c = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return c[first[1:]] - c[first[:-1]]
