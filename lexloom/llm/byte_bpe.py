"""Byte-level BPE with two tiers: a minimal perfect hash for pre-tokens that are in the vocabulary, heaps over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import U64, Chunk, chunks, mix, span_hashes
from .store import bounded_broadcast, freed

MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens of up to so many bytes are merged side by side, one step of each heap at a time.
SHORT = 48
#: Bytes of texts that are encoded together: the more, the fewer pieces are merged twice.
CHUNK_BYTES = 1 << 19
_NONE = np.int64(1 << 40)
STEP = U64(0x9E3779B97F4A7C15)

# classes of characters in the pattern: other, letter, number, white space
_O, _L, _N, _S = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """The class of every code point."""
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for cls, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+"), (_S, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = m.span()
            for lo, hi, shift in ((0, 0xD800, 0), (0xD800, len(text), 0x800)):
                if a < hi and b > lo:
                    out[max(a, lo) + shift : min(b, hi) + shift] = cls
    return out


def _byte_classes(chunk: Chunk, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of every byte's character, and whether the byte begins one."""
    buf = chunk.buf
    cls = classes[:256][buf]
    lead = (buf & 0xC0) != 0x80
    high = np.flatnonzero(buf >= 0xC0)
    if len(high):
        b = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
        first, tail = b[high], [b[high + k] & 0x3F for k in (1, 2, 3)]
        code = np.where(first < 0xE0, (first & 0x1F) << 6 | tail[0], np.where(first < 0xF0, (first & 0x0F) << 12 | tail[0] << 6 | tail[1], (first & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        c = classes[code]
        cls[high] = c
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        for k in (1, 2, 3):
            more = size > k
            cls[high[more] + k] = c[more]
    return cls, lead


def split(chunk: Chunk, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of a chunk begin.

    They are those of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
    ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, found by comparing the classes of
    neighbours: a run of one class is a pre-token, the last white space before
    another run stands alone, or goes with that run if it is a space; a
    contraction counts where its apostrophe begins a pre-token.
    """
    buf, n = chunk.buf, len(chunk.buf)
    if not n:
        return np.zeros(0, np.int64)
    cls, lead = _byte_classes(chunk, classes)
    begins = np.zeros(n + 1, bool)
    begins[chunk.off[:-1]] = True
    doc_start = begins[:n].copy()
    begins = begins[:n]
    begins[1:] |= cls[1:] != cls[:-1]
    begins &= lead
    # white space: its last character before another class leaves the run
    run_ends = np.flatnonzero(begins[1:] & (cls[:-1] == _S) & (cls[1:] != _S) & ~doc_start[1:]) + 1
    if len(run_ends):
        last = run_ends - 1
        for _ in range(3):
            last = np.where(lead[last], last, last - 1)
        begins[last] = True
        begins[run_ends[buf[last] == 0x20]] = False
    # contractions
    quote = np.flatnonzero((buf == 0x27) & begins)
    if len(quote):
        doc_end = chunk.off[1:][np.searchsorted(chunk.off[1:], quote, side="right")]
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        one, two = pad[quote + 1], pad[quote + 2]
        size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (quote + 1 < doc_end), 2, 0)
        pair = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        size = np.where(pair & (quote + 2 < doc_end), 3, size)
        # a run of other characters isn't broken inside, so the letters follow the apostrophe at once
        quote, size, doc_end = quote[size > 0], size[size > 0], doc_end[size > 0]
        begins[quote + 1] = False
        at = quote + size
        begins[at[at < doc_end]] = True
    return np.flatnonzero(begins)


class Ranks:
    """A vocabulary: its tokens by id, a minimal perfect hash over them, and a hash table of the pairs that merge."""

    def __init__(self, path: str):
        table = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()))
        self.by_id = {i: t for t, i in table.items()}
        ids = np.array(sorted(self.by_id), np.int64)
        tokens = [self.by_id[i] for i in ids.tolist()]
        self.longest = max(map(len, tokens))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        if not np.array_equal(ids, np.arange(len(ids))):
            raise ValueError("ids must run from 0 without gaps")
        self.single = np.full(256, -1, np.int64)
        for b in range(256):
            self.single[b] = table.get(bytes([b]), -1)
        if (self.single < 0).any():
            raise ValueError("every byte must be a token")
        self._perfect(span_hashes(self.bytes, self.off[:-1], self.off[1:]))
        keys, to = [], []
        for t, i in table.items():
            for k in range(1, len(t)):
                a, b = table.get(t[:k]), table.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(i)
        self._pairs(np.array(keys, np.uint64), np.array(to, np.int64))

    def _perfect(self, h: np.ndarray) -> None:
        """Hash and displace: each bucket of keys gets the first seed that sends its keys to free places."""
        n = len(h)
        if len(np.unique(h)) != n:
            raise ValueError("tokens of equal hash")
        m = n // 3 + 1
        bucket = (h % U64(m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.searchsorted(bucket[order], np.arange(m + 1))
        self.seed = np.zeros(m, np.uint64)
        self.slot_hash, self.slot_id = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        taken, free_at = np.zeros(n, bool), 0
        tries = np.arange(256, dtype=np.uint64)
        for b in np.argsort(-(start[1:] - start[:-1]), kind="stable").tolist():
            members = order[start[b] : start[b + 1]]
            if not len(members):
                continue
            keys = h[members]
            if len(members) == 1:  # a seed of the upper half names the place itself
                while taken[free_at]:
                    free_at += 1
                self.seed[b] = U64((1 << 63) | free_at)
                places = [free_at]
            else:
                tried = U64(0)
                while True:
                    all_places = (mix(keys + ((tries + tried) * STEP)[:, None]) % U64(n)).astype(np.int64)
                    ok = ~taken[all_places].any(1)
                    ranked = np.sort(all_places, 1)
                    ok &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                    if ok.any():
                        break
                    tried += U64(len(tries))
                pick = int(np.argmax(ok))
                self.seed[b], places = tries[pick] + tried, all_places[pick].tolist()
            for p, i in zip(places, members.tolist()):
                taken[p] = True
                self.slot_hash[p], self.slot_id[p] = h[i], i

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of whole tokens by their hashes, -1 for others."""
        seed = self.seed[(h % U64(len(self.seed))).astype(np.int64)]
        direct = seed >> U64(63) == U64(1)
        place = np.where(direct, seed & U64((1 << 63) - 1), mix(h + seed * STEP) % U64(len(self.slot_hash))).astype(np.int64)
        return np.where(self.slot_hash[place] == h, self.slot_id[place], -1)

    def _pairs(self, keys: np.ndarray, to: np.ndarray) -> None:
        """Open addressing, with linear probes."""
        bits = int(np.ceil(np.log2(max(16, 3 * len(keys)))))
        self.pair_shift = U64(64 - bits)
        size = 1 << bits
        self.pair_key, self.pair_to = np.full(size, ~U64(0), np.uint64), np.full(size, _NONE, np.int64)
        place = (mix(keys) >> self.pair_shift).astype(np.int64)
        left, self.probes = np.arange(len(keys)), 0
        while len(left):
            at = (place[left] + self.probes) % size
            empty = self.pair_key[at] == ~U64(0)
            _, first = np.unique(at, return_index=True)
            here = np.zeros(len(left), bool)
            here[first] = True
            here &= empty
            self.pair_key[at[here]], self.pair_to[at[here]] = keys[left[here]], to[left[here]]
            left = left[~here]
            self.probes += 1

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids (which are the ranks) of the tokens that pairs make, or a number above all ids."""
        key = a.astype(np.uint64) << U64(32) | b.astype(np.uint64)
        size = len(self.pair_key)
        at = (mix(key) >> self.pair_shift).astype(np.int64)
        out = np.full(len(key), _NONE)
        left = np.arange(len(key))
        for _ in range(self.probes):
            k = self.pair_key[at]
            hit = k == key[left]
            out[left[hit]] = self.pair_to[at[hit]]
            go = ~hit & (k != ~U64(0))
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) % size
        return out

    def size(self) -> int:
        return sum(x.nbytes for x in (self.bytes, self.off, self.seed, self.slot_hash, self.slot_id, self.pair_key, self.pair_to))


def merge_long(ranks: Ranks, piece: bytes) -> list[int]:
    """BPE of one piece by a heap of (rank, place) over linked bytes, O(n log n)."""
    ids = ranks.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before, version = [*range(1, n), -1], [*range(-1, n - 1)], [0] * n
    first = ranks.merged(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() if n > 1 else []
    heap = [(r, i, 0, 0) for i, r in enumerate(first) if r < _NONE]
    heapq.heapify(heap)
    cache: dict[tuple[int, int], int] = {}

    def push(i: int) -> None:
        j = after[i]
        if i >= 0 and j >= 0:
            pair = (ids[i], ids[j])
            if (r := cache.get(pair)) is None:
                r = cache[pair] = int(ranks.merged(np.array([pair[0]]), np.array([pair[1]]))[0])
            if r < _NONE:
                heapq.heappush(heap, (r, i, version[i], version[j]))

    while heap:
        r, i, vi, vj = heapq.heappop(heap)
        j = after[i]
        if version[i] != vi or j < 0 or version[j] != vj:
            continue
        ids[i], after[i] = r, after[j]
        version[i] += 1
        version[j] = -1
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    out, i = [], 0
    while i >= 0 and n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_short(ranks: Ranks, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BPE of many short pieces side by side: each step merges the lowest pair of every piece that has one.

    Returns all their ids and the number of each.
    """
    lens = ends - starts
    piece = np.repeat(np.arange(len(lens)), lens)
    first = np.concatenate([[0], np.cumsum(lens)])
    ids = ranks.single[buf[np.arange(first[-1]) - np.repeat(first[:-1] - starts, lens)]]
    counts = np.zeros(len(lens), np.int64)
    done_piece, done_ids = [], []
    rank = np.full(len(ids), _NONE)
    pairs = np.flatnonzero(piece[1:] == piece[:-1])
    rank[pairs] = ranks.merged(ids[pairs], ids[pairs + 1])
    while len(ids):
        head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        best = np.minimum.reduceat(rank, head)
        size = np.diff(np.concatenate([head, [len(ids)]]))
        live = best < _NONE
        if not live.all():
            keep = np.repeat(live, size)
            done_piece.append(piece[~keep])
            done_ids.append(ids[~keep])
            piece, ids, rank = piece[keep], ids[keep], rank[keep]
            best, size = best[live], size[live]
            if not len(ids):
                break
            head = np.concatenate([[0], np.cumsum(size)[:-1]])
        hit = np.flatnonzero(rank == np.repeat(best, size))
        at = hit[np.concatenate([[True], piece[hit[1:]] != piece[hit[:-1]]])]  # the first such pair of each piece
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))  # places once the second halves are gone
        piece, ids, rank = piece[keep], ids[keep], rank[keep]
        rank[new] = _NONE
        nxt = new[(new + 1 < len(ids))]
        nxt = nxt[piece[nxt + 1] == piece[nxt]]
        rank[nxt] = ranks.merged(ids[nxt], ids[nxt + 1])
        prev = new[new > 0] - 1
        prev = prev[piece[prev] == piece[prev + 1]]
        rank[prev] = ranks.merged(ids[prev], ids[prev + 1])
    all_piece, all_ids = np.concatenate([*done_piece, piece]), np.concatenate([*done_ids, ids])
    order = np.argsort(all_piece, kind="stable")
    counts = np.bincount(all_piece, minlength=len(lens))
    return all_ids[order], counts


def encode(ranks: Ranks, chunk: Chunk, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, and the index where each text's begin."""
    starts = split(chunk, classes)
    ends = np.concatenate([starts[1:], [len(chunk.buf)]]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(chunk.n + 1, np.int64)
    h = span_hashes(chunk.buf, starts, ends)
    ids = ranks.lookup(h)
    lens = ends - starts
    known = ids >= 0
    # the hash names one token only; its length and bytes decide
    known[known] = lens[known] == (ranks.off[ids[known] + 1] - ranks.off[ids[known]])
    at = np.flatnonzero(known)
    size = lens[at]
    base = np.repeat(np.cumsum(size) - size, size)
    step = np.arange(len(base)) - base
    same = chunk.buf[np.repeat(starts[at], size) + step] == ranks.bytes[np.repeat(ranks.off[ids[at]], size) + step]
    if not same.all():
        known[at] = np.logical_and.reduceat(same, np.cumsum(size) - size)
    counts = np.ones(len(starts), np.int64)
    miss = np.flatnonzero(~known)
    _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
    rep = miss[one]
    short = lens[rep] <= SHORT
    rep_ids: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
    rep_counts = np.zeros(len(rep), np.int64)
    flat, count = merge_short(ranks, chunk.buf, starts[rep[short]], ends[rep[short]]) if short.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    rep_counts[short] = count
    longs = [np.array(merge_long(ranks, chunk.buf[starts[i] : ends[i]].tobytes()), np.int64) for i in rep[~short].tolist()]
    rep_counts[~short] = [len(x) for x in longs]
    rep_ids = np.concatenate([flat, *longs]) if len(rep) else np.zeros(0, np.int64)
    begin = np.zeros(len(rep), np.int64)
    begin[short] = np.cumsum(count) - count
    lengths = np.array([len(x) for x in longs], np.int64)
    begin[~short] = len(flat) + np.cumsum(lengths) - lengths
    counts[miss] = rep_counts[back]
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1], np.int64)
    out[first[:-1][known]] = ids[known]
    size = counts[miss]
    base = np.repeat(np.cumsum(size) - size, size)
    step = np.arange(len(base)) - base
    out[np.repeat(first[miss], size) + step] = rep_ids[np.repeat(begin[back], size) + step]
    return out, first[np.searchsorted(starts, chunk.off)]


def decode(ranks: Ranks, ids: np.ndarray) -> np.ndarray:
    """The bytes of a sequence of ids."""
    size = ranks.off[ids + 1] - ranks.off[ids]
    base = np.repeat(np.cumsum(size) - size, size)
    return ranks.bytes[np.repeat(ranks.off[ids], size) + np.arange(len(base)) - base]


_loaded: dict[tuple[str, float], Ranks] = {}


def load(path: str) -> Ranks:
    key = (path, Path(path).stat().st_mtime)
    if key not in _loaded:
        _loaded[key] = Ranks(path)
    return _loaded[key]


def bpe(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encodes and decodes every whole text by the ranks in the file ``path``.

    Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256, ``carry`` columns and, if asked for, ids.  A null text is an
    empty one, of 0 tokens.  Null ids are passed on, repeated rows encoded each,
    other columns ignored; an empty table gives no rows.  The vocabulary, whose
    size is checked, is broadcast; there is no shuffle.
    """
    ranks = load(path)
    shared = bounded_broadcast(df.sparkSession, (ranks, char_classes()), ranks.size() + 0x110000, MAX_VOCABULARY_BYTES)
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([base.schema[c] for c in ("doc_id", *carry)]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        ranks, classes = shared.value
        for b in batches:
            for c in chunks(b.column("text"), CHUNK_BYTES):
                ids, first = encode(ranks, c, classes)
                back = decode(ranks, ids)
                cut = np.concatenate([[0], np.cumsum(ranks.off[ids + 1] - ranks.off[ids])])[first]
                small = ids.astype("<u4")
                one = [hashlib.sha256(small[first[i] : first[i + 1]]).hexdigest() for i in range(c.n)]
                two = [hashlib.sha256(back[cut[i] : cut[i + 1]]).hexdigest() for i in range(c.n)]
                cols = [*(b.column(k).slice(c.first, c.n) for k in ("doc_id", *carry)), pa.array(np.diff(first)), pa.array(one), pa.array(two)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(freed(run), schema)
