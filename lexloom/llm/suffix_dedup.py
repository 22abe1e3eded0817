"""Removal of long repeats: suffix arrays by the difference-cover algorithm over what can repeat at all."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext
from .bytetext import SPACED, U64, Chunk, chunks, mix
from .store import drop, freed, trim, written

#: Bytes of the shortest repeat; words of the shortest passage: over 50, less the two at its ends, which may be joined to their neighbours' text.
LENGTH, PASSAGE = 400, 49
#: Most bytes of contexts of a key in a suffix array; bytes in an array of several keys.
TASK_BYTES, ARRAY_BYTES = 1 << 20, 1 << 18
#: Numbers of rows, and bytes of what goes with them, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: Occurrences from which a context is joined by broadcast are this share of all, so there are few such contexts.
HOT_SHARE = 1e-4

# -- symbols


class Symbols:
    """The symbols of a chunk: 64-bit values, their places per text, and the bytes each covers.

    In unit ``bytes`` every byte is a symbol; in unit ``words`` every word
    between ASCII white space, named by its hash.
    """

    def __init__(self, chunk: Chunk, unit: str):
        self.chunk, self.unit = chunk, unit
        if unit == "bytes":
            self.off, self.starts, self.ends = chunk.off, None, None
            self.values = bytetext._BYTE[chunk.buf]
        elif unit == "words":
            w = chunk.words(SPACED)
            self.off, self.starts, self.ends = w.first, w.starts, w.ends
            self.values = w.hashes()
        else:
            raise ValueError(f"unknown unit {unit!r}")
        self.prefix = _prefix(self.values)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _span(self.prefix, a, b)

    def hashes_by_others(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the same spans that don't follow from :meth:`hashes`."""
        return _span(_prefix(mix(self.values)), a, b)

    def cut(self, i: int, lo: int, n: int) -> bytes:
        """``n`` symbols of text ``i`` from ``lo``, as they go into a suffix array."""
        at = int(self.off[i]) + lo
        return (self.chunk.buf if self.unit == "bytes" else self.values)[at : at + n].tobytes()

    def text(self, i: int, lo: int, n: int) -> bytes:
        """The text of ``n`` symbols of text ``i`` from ``lo``."""
        at = int(self.off[i]) + lo
        a, b = (at, at + n) if self.unit == "bytes" else (self.starts[at], self.ends[at + n - 1])
        return self.chunk.buf[a:b].tobytes()

    def bytes_of(self, i: int, ranges: np.ndarray) -> np.ndarray:
        """Ranges of symbols of text ``i`` as ranges of its bytes."""
        if self.unit == "bytes" or not len(ranges):
            return ranges
        at = ranges + self.off[i]
        return np.stack([self.starts[at[:, 0]], self.ends[at[:, 1] - 1]], 1) - self.chunk.off[i]


_DTYPE = {"bytes": np.dtype(np.uint8), "words": np.dtype(np.uint64)}


def _prefix(values: np.ndarray) -> np.ndarray:
    bytetext._powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * bytetext._pow[: len(values)], out=out[1:])
    return out


def _span(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of spans of symbols, equal for equal ones wherever they stand."""
    return mix(((prefix[b] - prefix[a]) * bytetext._inv[a]) ^ ((b - a).astype(np.uint64) * U64(0xD6E8FEB86659FD93)))


# -- suffix arrays


def _names(*cols: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the rows of the columns, and how many differ."""
    if sum(int(c.max(initial=0)).bit_length() for c in cols) <= 64:
        key = np.zeros(len(cols[0]), np.uint64)
        for c in cols:
            key = key << U64(int(c.max(initial=0)).bit_length()) | c.astype(np.uint64)
        order = np.argsort(key)
        k = key[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    else:
        order = np.lexsort(cols[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in cols])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, int(new.sum())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes in order, by the difference cover {1, 2} mod 3.

    Triples at the sampled places are sorted and named; the string of names is
    sorted in the same way, unless all differ.  The suffixes left are sorted by
    their first symbol and the rank of the next suffix, and merged in.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = s.astype(np.int64) + 1  # 0 is for what lies beyond the end
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # a suffix at n keeps the two halves apart if n = 1 mod 3
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    name, different = _names(t[sample], t[sample + 1], t[sample + 2])
    if different < len(sample):
        order = suffix_array(name)
    else:
        order = np.argsort(name, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    wide = U64(int(len(sample) + 1).bit_length())
    symbol = int(t.max()).bit_length()
    if 2 * symbol + int(wide) > 64:
        raise ValueError("too many symbols for one suffix array")
    near = lambda i: t[i].astype(np.uint64) << wide | rank[i + 1].astype(np.uint64)
    far = lambda i: (t[i].astype(np.uint64) << U64(symbol) | t[i + 1].astype(np.uint64)) << wide | rank[i + 2].astype(np.uint64)
    zero = zero[np.argsort(near(zero), kind="stable")]
    at_one = sampled % 3 == 1
    before = np.searchsorted(near(sampled[at_one]), near(zero)) + np.searchsorted(far(sampled[~at_one]), far(zero))
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + before
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sampled
    return out


def repeated_windows(texts: list[np.ndarray], owned: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Of the first ``owned[k]`` windows of each sequence, those with an equal among the others'.

    Suffixes of all sequences, parted by a symbol of their own, are sorted;
    neighbours in that order are compared over ``length`` symbols, by two
    64-bit hashes of different bases.
    """
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    flat = np.concatenate([np.append(t, t.dtype.type(0)) for t in texts])
    s = np.unique(flat, return_inverse=True)[1].astype(np.int64) + 1 if flat.dtype.itemsize > 1 else flat.astype(np.int64) + 1
    s[first + size] = 0
    mine = np.zeros(len(s), bool)
    for f, n, m in zip(first.tolist(), size.tolist(), owned):
        mine[f : f + max(0, min(m, n - length + 1))] = True
    order = suffix_array(s)
    order = order[mine[order]]
    values = mix(s.astype(np.uint64))
    one, two = (_span(_prefix(v), order, order + length) for v in (values, mix(values)))
    same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
    hit = np.zeros(len(s), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [np.flatnonzero(hit[f : f + m]) for f, m in zip(first.tolist(), owned)]


# -- anchors


def anchors(sym: Symbols, length: int, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, first and last windows and hashes of the anchors of a chunk.

    Each window of ``length`` symbols belongs to one anchor: of the strings of
    ``k`` symbols (a quarter of that length) inside it, the leftmost of the
    least hash.  Equal windows have equal anchors at the same offset, and the
    windows of an anchor lie side by side.
    """
    k = k or max(1, length // 4)
    w = length - k + 1
    n = len(sym.values)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    starts = np.arange(n - k + 1)
    h = sym.hashes(starts, starts + k)
    key = h >> U64(32) << U64(32) | starts.astype(np.uint64)
    pad = -len(key) % w
    x = np.concatenate([key, np.full(pad, ~U64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()[: len(key)]
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()[: len(key)]
    owner = (np.minimum(right[: n - length + 1], left[w - 1 : w - 1 + n - length + 1]) & U64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(sym.off)
    long = size >= length
    np.add.at(inside, sym.off[:-1][long], 1)
    np.add.at(inside, sym.off[1:][long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(inside[: n - length + 1]))
    owner = owner[window]
    if not len(owner):
        return none, none, none, np.zeros(0, np.uint64)
    head = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)]))
    last = np.append(head[1:], len(owner)) - 1
    place = owner[head]
    return place, window[head], window[last], h[place]


def _anchored(docs: DataFrame, length: int, unit: str, k: int | None = None) -> DataFrame:
    """Anchors (row, key, ctx, lo, n): key and ctx are hashes of the anchor and of its context (the symbols of its windows and where it stands in them), which begins at lo with n windows."""

    def run(batches):
        for b in batches:
            row = b.column("row").to_numpy()
            for c in chunks(b.column("text")):
                sym = Symbols(c, unit)
                place, lo, hi, key = anchors(sym, length, k)
                if not len(key):
                    continue
                doc = np.searchsorted(sym.off, lo, side="right") - 1
                shape = mix((place - lo).astype(np.uint64) << U64(32) | (hi - lo).astype(np.uint64))
                ctx = mix((sym.hashes_by_others if k == length else sym.hashes)(lo, hi + length) ^ shape)
                arrays = [row[c.first + doc], key.view(np.int64), ctx.view(np.int64), lo - sym.off[doc], hi - lo + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)) for a in arrays], names=["row", "key", "ctx", "lo", "n"])

    return docs.select("row", "text").mapInArrow(freed(run), "row long, key long, ctx long, lo long, n long")


# -- contexts


_RUNS = "key long, ctx long, runs binary"


def _runs(windows: np.ndarray) -> bytes:
    """Windows in order as (first, last) pairs of 32-bit integers."""
    if not len(windows):
        return b""
    cut = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1] + 1, [True]]))
    return np.stack([windows[cut[:-1]], windows[cut[1:] - 1]], 1).astype("<i4").tobytes()


def _beside(docs: DataFrame, per: DataFrame, size: Column, few: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with what ``per`` has for them (``size`` bytes), and the other rows.

    Up to ``few`` rows and BROADCAST_BYTES of it are broadcast.  Of more, only
    texts that have something are shuffled: the numbers of their rows are
    broadcast, or if there are too many of these the texts are parted by a join.
    """
    n, total = per.agg(F.count("*"), F.coalesce(F.sum(size + 16), F.lit(0))).first()
    if n <= few and total <= BROADCAST_BYTES:
        return docs.join(F.broadcast(per), "row"), docs.join(F.broadcast(per.select("row")), "row", "left_anti")
    ids = per.select("row")
    if n <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "row", "left_semi").join(per.hint("merge"), "row"), docs.join(ids, "row", "left_anti")


def _context_bytes(docs: DataFrame, reps: DataFrame, length: int, unit: str, few: int, as_text: bool = False) -> DataFrame:
    """(key, ctx, n, bytes) of the contexts of ``reps``, cut from their texts as symbols or as text."""
    per = reps.groupBy("row").agg(F.collect_list(F.struct("key", "ctx", "lo", "n")).alias("cuts"))
    per = written(per, "cuts")

    def run(batches):
        for b in batches:
            cuts = b.column("cuts")
            for c in chunks(b.column("text")):
                sym = Symbols(c, unit)
                cut = sym.text if as_text else sym.cut
                out: dict[str, list] = {k: [] for k in ("key", "ctx", "n", "bytes")}
                for i in range(c.n):
                    for x in cuts[c.first + i].as_py():
                        for k in ("key", "ctx", "n"):
                            out[k].append(x[k])
                        out["bytes"].append(cut(i, x["lo"], x["n"] - 1 + length))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]))

    some, _ = _beside(docs.select("row", "text"), per, F.size("cuts") * 48, few)
    return some.mapInArrow(freed(run), "key long, ctx long, n long, bytes binary")


def _sorted_runs(contexts: DataFrame, length: int, unit: str, buckets: int) -> DataFrame:
    """Repeated windows of contexts, from suffix arrays of buckets of keys."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["key", "ctx"]).sort_values("key", kind="stable")
        size = rows["bytes"].map(len).to_numpy()
        group = np.cumsum(size) // min(ARRAY_BYTES, TASK_BYTES)
        key = rows["key"].to_numpy()
        for i in range(1, len(group)):  # a key isn't split
            if key[i] == key[i - 1]:
                group[i] = group[i - 1]
        out = []
        for g in np.unique(group):
            part = rows[group == g]
            hits = repeated_windows([np.frombuffer(x, _DTYPE[unit]) for x in part["bytes"]], part["n"].tolist(), length)
            out.append(pd.DataFrame({"key": part["key"].to_numpy(), "ctx": part["ctx"].to_numpy(), "runs": [_runs(h) for h in hits]}))
        got = pd.concat(out)
        trim()
        return got[got["runs"].map(len) > 0]

    return contexts.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInPandas(run, _RUNS)


def _longer(k: int, length: int) -> int:
    """How long the anchors are that divide the keys of anchors of ``k`` symbols; in the end they are the windows themselves."""
    return length if k > length // 2 else length - (length - k) // 4


def _divided_runs(contexts: DataFrame, length: int, unit: str, few: int, k: int) -> DataFrame:
    """The same for keys of more contexts than a task may hold: the contexts' windows get anchors of ``k`` symbols, which part those that differ.

    An anchor of a window depends on nothing but the window, so equal ones stay
    together.  Where anchors are whole windows, counting settles every key.
    """
    rows = written(contexts.withColumn("row", F.monotonically_increasing_id()), "sequences")
    spans = _spans(rows.select("row", F.col("bytes").alias("text")), length, unit, few, k)

    def pack(batches):
        for b in batches:
            runs = [(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2) - np.array([0, length])).astype("<i4").tobytes() for x in b.column("ranges")]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ctx"), pa.array(runs, pa.binary())], names=["key", "ctx", "runs"])

    return spans.join(rows.select("row", "key", "ctx"), "row").select("key", "ctx", "ranges").mapInArrow(freed(pack), _RUNS)


def _spans(docs: DataFrame, length: int, unit: str, few: int, k: int | None = None) -> DataFrame:
    """(row, ranges): the covered symbols of every text that has some, as pairs of 64-bit integers, by anchors of ``k`` symbols."""
    k = k or max(1, length // 4)
    every = written(_anchored(docs, length, unit, k), "anchors")
    keys = written(every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "keys")
    found = written(every.join(keys.hint("broadcast" if keys.count() <= few else "merge"), "key", "left_semi"), "found")
    drop(every)
    contexts = written(found.groupBy("key", "ctx").agg(F.count("*").alias("times"), F.min(F.struct("row", "lo")).alias("at"), F.first("n").alias("n")), "contexts")
    # a key all of whose contexts repeat is settled; the others' contexts must be compared
    width = (F.col("n") + length - 1) * _DTYPE[unit].itemsize
    stats = contexts.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("times") == 1, 1).otherwise(0)).alias("single"), F.sum(width).alias("width"))
    open_keys = written(stats.where("kinds > 1 AND single > 0").select("key", "width"), "open")
    total = open_keys.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0]
    reps = contexts.join(open_keys, "key").select("key", "ctx", "n", "width", F.col("at.row").alias("row"), F.col("at.lo").alias("lo"))
    small = _context_bytes(docs, reps.where(F.col("width") <= TASK_BYTES), length, unit, few)
    runs = _sorted_runs(small, length, unit, max(1, int(total) // (2 * TASK_BYTES)))
    many = reps.where(F.col("width") > TASK_BYTES)
    if open_keys.where(F.col("width") > TASK_BYTES).limit(1).count():
        runs = runs.unionByName(_divided_runs(_context_bytes(docs, many, length, unit, few, True), length, unit, few, _longer(k, length)))
    runs = written(runs, "runs")
    settled = contexts.join(runs, ["key", "ctx"], "left").where("times > 1 OR runs IS NOT NULL").select("key", "ctx", "times", F.when(F.col("times") == 1, F.col("runs")).alias("runs"))
    settled = written(settled, "settled")
    hot = settled.where(F.col("times") > F.lit(max(1000, HOT_SHARE * found.count())))
    some = found.join(F.broadcast(hot), ["key", "ctx"]).unionByName(found.join(F.broadcast(hot.select("key", "ctx")), ["key", "ctx"], "left_anti").join(settled, ["key", "ctx"]))
    per = some.groupBy("row").agg(F.collect_list(F.struct("lo", "n", "runs")).alias("windows"))

    def merge(batches):
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                yield pa.RecordBatch.from_arrays([part.column("row"), _covered(part.column("windows"), length)], names=["row", "ranges"])

    spans = written(per.mapInArrow(freed(merge), "row long, ranges binary"), "spans")
    for table in (keys, found, contexts, open_keys, runs, settled):
        drop(table)
    return spans


def _covered(windows: pa.Array, length: int) -> pa.Array:
    """For each row's list of (lo, n, runs) the maximal covered ranges, as pairs of 64-bit integers."""
    count = np.asarray(windows.value_lengths()).astype(np.int64)
    flat = windows.flatten()
    lo, n, runs = (flat.field(k) for k in range(3))
    lo, whole = lo.to_numpy(), ~np.asarray(runs.is_valid())
    size = np.where(whole, 1, np.asarray(pc.fill_null(pc.binary_length(runs), 0)) // 8)
    first = np.cumsum(size) - size
    a, b = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
    b[first[whole]] = n.to_numpy()[whole] - 1
    buf, _ = bytetext.column_bytes(runs)
    listed = np.repeat(~whole, size)
    pairs = np.frombuffer(buf.tobytes(), "<i4").reshape(-1, 2)
    a[listed], b[listed] = pairs[:, 0], pairs[:, 1]
    at = np.repeat(lo, size)
    a, b = a + at, b + at + length
    row = np.repeat(np.repeat(np.arange(len(count)), count), size)
    order = np.lexsort((a, row))
    a, b, row = a[order], b[order], row[order]
    # rows are laid one after another, so that one running maximum does for all
    step = np.int64(b.max(initial=0) + 1)
    far = np.maximum.accumulate(b + row * step)
    head = np.flatnonzero(np.concatenate([[True], a[1:] + row[1:] * step > far[:-1]])) if len(a) else np.zeros(0, np.int64)
    tail = np.append(head[1:], len(a)) - 1
    out = np.stack([a[head], far[tail] - row[tail] * step], 1).astype("<i8") if len(a) else np.zeros((0, 2), "<i8")
    cut = np.searchsorted(row[head], np.arange(len(count) + 1)) * 16
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(out.tobytes())])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, unit: str = "bytes", passage: int | None = None, keep_text: bool = False, carry: tuple[str, ...] = (), few: int | None = None) -> DataFrame:
    """Removes every byte inside a string of ``length`` symbols that also starts anywhere else.

    Symbols are the UTF-8 bytes of a text, or in unit ``words`` its words
    between ASCII white space (white space inside a repeat goes with it).  Null
    is an empty text; matches stay within a document, may overlap, and are
    judged on the input.  One row for each row of ``df``: doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256, ``carry`` columns
    and, with ``keep_text``, the text left (bytes that no longer make a
    character are left out of it).  With ``passage``, n_passage_words is the
    number of words inside strings of so many words that stand anywhere else,
    which are counted, not removed.  Copies are removed from all places, the
    first included.  Repeated rows are copies; null ids are passed on; other
    columns are ignored; an empty table gives no rows.

    Only text that can repeat is sorted: each window belongs to the string of
    a quarter of its length with the least hash in it, its anchor, and windows
    whose anchor stands once are unique.  Contexts of anchors that are equal as
    a whole are settled by counting.  The rest, one of each kind, is sorted by
    the difference-cover algorithm in buckets of equal anchors, and neighbours
    are compared; keys of more than TASK_BYTES are first divided by longer
    anchors, at last by whole windows, which are counted, so no task holds an
    unbounded group.  Anchors that stand twice or more, and what is found for texts, are
    broadcast up to ``few`` rows (BROADCAST_ROWS, where that isn't given), else
    joined by a shuffle.
    """
    few = BROADCAST_ROWS if few is None else few
    names = {f"_carry{i}": c for i, c in enumerate(carry)}
    if clash := {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "text"} & set(carry):
        raise ValueError(f"carried columns would clash: {sorted(clash)}")
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`").alias(n) for n, c in names.items()], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    docs = written(base.withColumn("row", F.monotonically_increasing_id()), "docs")
    spans = _spans(docs, length, unit, few)
    if passage:
        spans = spans.join(_spans(docs, passage, "words", few).withColumnRenamed("ranges", "passages"), "row", "full_outer")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("binary"))
    spans = written(spans, "ranges")
    some, others = _beside(docs, spans, F.coalesce(F.length("ranges"), F.lit(0)) + F.coalesce(F.length("passages"), F.lit(0)), few)
    joined = some.unionByName(others, allowMissingColumns=True).drop("row")
    keep = [c for c in joined.columns if c not in ("text", "ranges", "passages")]
    schema = T.StructType([joined.schema[c] for c in keep])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    if passage:
        schema = schema.add("n_passage_words", "long")
    if keep_text:
        schema = schema.add("text", "string")
    none = np.zeros((0, 2), np.int64)

    def pairs(value: pa.Scalar) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), "<i8").reshape(-1, 2) if value.is_valid else none

    def run(batches):
        for b in batches:
            ranges, passages = b.column("ranges"), b.column("passages")
            for c in chunks(b.column("text")):
                at, sym = slice(c.first, c.first + c.n), None
                size, removed, spans, words, digest, kept = [], [], [], [], [], []
                for i, (value, other) in enumerate(zip(ranges[at], passages[at])):
                    data, r = c.buf[c.off[i] : c.off[i + 1]].tobytes(), pairs(value)
                    if len(r):
                        if unit != "bytes":
                            sym = sym or Symbols(c, unit)
                            r = sym.bytes_of(i, r)
                        left, to = [], 0
                        for x, y in r.tolist():
                            left.append(data[to:x])
                            to = y
                        rest = b"".join([*left, data[to:]])
                    else:
                        rest = data
                    size.append(len(data))
                    removed.append(len(data) - len(rest))
                    spans.append(len(r))
                    digest.append(hashlib.sha256(rest).hexdigest())
                    if passage:
                        p = pairs(other)
                        words.append(int((p[:, 1] - p[:, 0]).sum()))
                    if keep_text:
                        kept.append(rest.decode("utf-8", "ignore"))
                cols = [*(b.column(k).slice(c.first, c.n) for k in keep), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())]
                if passage:
                    cols.append(pa.array(words, pa.int64()))
                if keep_text:
                    cols.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.mapInArrow(freed(run), schema).withColumnsRenamed(names)
