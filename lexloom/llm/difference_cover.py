"""Suffixes of many sequences in order, by the difference cover {1, 2} mod 3, every sort spread over the cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mix
from .store import drop, freed, written


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists."""
    return np.asarray(col.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))]).astype(np.int64)


def _batch(names: str, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names.split())


def _longs(*names: str) -> str:
    return ", ".join(f"{n} long" for n in names)


def counted_before(one: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Distinct ``keys`` with, for each of ``counts``, its sum over all lesser keys.

    Keys are sorted by range; each task adds up its own as a stream, and the
    tasks' totals, a row each, are added up on the driver.
    """
    names = ["task", "total", *keys, *counts]

    def run(batches):
        from pyspark import TaskContext

        task, have = TaskContext.get().partitionId(), [0] * len(counts)
        for b in batches:
            cols = []
            for i, c in enumerate(counts):
                n = b.column(c).to_numpy()
                upto = have[i] + np.cumsum(n)
                cols.append(upto - n)
                have[i] = int(upto[-1]) if len(n) else have[i]
            yield _batch(" ".join(names), np.full(b.num_rows, task), np.zeros(b.num_rows, np.int64), *(b.column(k).to_numpy() for k in keys), *cols)
        yield _batch(" ".join(names), *(np.array([x]) for x in (task, 1, *[0] * len(keys), *have)))

    inside = written(one.select(*keys, *counts).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(freed(run), _longs(*names)), "sorted")
    start, rows = [0] * len(counts), []
    for r in inside.where("total = 1").orderBy("task").collect():
        rows.append((r["task"], *start))
        start = [a + r[c] for a, c in zip(start, counts)]
    starts = one.sparkSession.createDataFrame(rows, _longs("task", *(f"start_{c}" for c in counts)))
    return inside.where("total = 0").join(F.broadcast(starts), "task").select(*keys, *[(F.col(c) + F.col(f"start_{c}")).alias(c) for c in counts])


def ranks(rows: DataFrame, left: int) -> DataFrame:
    """(seq, ranks) of rows (seq, symbols): ranks order all suffixes that differ in their first ``left`` symbols, which are above 0.

    Triples at the sampled places are sorted and named by their order; the
    sequences of names, three times as wide, are ranked in the same way.  The
    suffixes left are ranked by their first symbols and the rank of the next
    sampled suffix, merged in by counting what comes before.
    """
    if left <= 1:
        return rows.select("seq", F.col("symbols").alias("ranks"))

    def sample(batches):
        for b in batches:
            flat, off = _lists(b.column("symbols"))
            n = np.diff(off)
            size = n + (n % 3 == 1)  # the place after the end parts the halves
            doc = np.repeat(np.arange(len(n)), size)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            keep = pos % 3 != 0
            doc, pos = doc[keep], pos[keep]
            at = [np.where(pos + k < n[doc], flat[np.minimum(off[doc] + pos + k, max(len(flat) - 1, 0))], 0) if len(flat) else pos for k in range(3)]
            yield _batch("seq pos a b c", b.column("seq").to_numpy()[doc], pos, *at)

    triples = written(rows.mapInArrow(freed(sample), _longs("seq", "pos", "a", "b", "c")), "triples")
    names = counted_before(triples.groupBy("a", "b", "c").agg(F.count("*").alias("n")), ["a", "b", "c"], ["n"])
    named = triples.join(names, ["a", "b", "c"]).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct((F.col("pos") % 3).alias("half"), "pos", (F.col("n") + 1).alias("name")))).alias("names"))
    inner = written(named.select("seq", F.transform("names", lambda x: x["name"]).alias("symbols")), "names")
    drop(triples)
    below = written(ranks(inner, -(-left // 3)), "ranks")
    drop(inner)

    def cells(batches):
        for b in batches:
            flat, off = _lists(b.column("symbols"))
            rank, at = _lists(b.column("ranks"))
            n = np.diff(off)
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(flat)) - off[doc]
            # ranks lie in the order 1, 4, ..., 2, 5, ...; those after the first half's dummy begin later
            half = (n + 1) // 3 + (n % 3 == 1)
            place = lambda p: at[doc] + np.where(p % 3 == 1, p // 3, half[doc] + p // 3)

            def rank_at(p: np.ndarray) -> np.ndarray:
                ok = (p < n[doc]) & (p % 3 != 0)
                return np.where(ok, rank[np.where(ok, place(p), 0)], 0) if len(rank) else np.zeros(len(p), np.int64)

            after = np.where(pos + 1 < n[doc], np.append(flat, 0)[np.arange(len(flat)) + 1], 0)
            yield _batch("seq pos kind s0 s1 r0 r1 r2", b.column("seq").to_numpy()[doc], pos, pos % 3, flat, after, *(rank_at(pos + k) for k in range(3)))

    table = written(rows.join(below, "seq").select("seq", "symbols", "ranks").mapInArrow(freed(cells), _longs("seq", "pos", "kind", "s0", "s1", "r0", "r1", "r2")), "cells")
    drop(below)
    of = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n{k}")
    first = counted_before(table.where("kind < 2").groupBy("s0", "r1").agg(of(0), of(1)), ["s0", "r1"], ["n0", "n1"])
    second = counted_before(table.where("kind <> 1").groupBy("s0", "s1", "r2").agg(of(0), of(2)), ["s0", "s1", "r2"], ["n0", "n2"])
    own = counted_before(table.where("kind > 0").groupBy("r0").agg(F.count("*").alias("n")), ["r0"], ["n"])
    zero = table.where("kind = 0").join(first, ["s0", "r1"]).join(second.drop("n0"), ["s0", "s1", "r2"]).select("seq", "pos", (F.col("n0") + F.col("n1") + F.col("n2") + 1).alias("rank"))
    one = table.where("kind = 1").join(first.drop("n1"), ["s0", "r1"]).join(own, "r0").select("seq", "pos", (F.col("n") + F.col("n0") + 1).alias("rank"))
    two = table.where("kind = 2").join(second.drop("n2"), ["s0", "s1", "r2"]).join(own, "r0").select("seq", "pos", (F.col("n") + F.col("n0") + 1).alias("rank"))
    out = zero.unionAll(one).unionAll(two).groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    return out.select("seq", F.transform("ranks", lambda x: x["rank"]).alias("ranks"))


def repeated(rows: DataFrame, length: int) -> DataFrame:
    """(seq, at): of the first ``owned`` windows of each of the rows (seq, owned, symbols), those of which there are equal ones.

    Windows are sorted by the rank of their suffix, so equal ones are side by
    side, and neighbours are compared over ``length`` symbols, by two 64-bit
    hashes; where two tasks meet, their last and first rows are compared here.
    """
    from .suffix_dedup import _prefix, _span

    found = written(ranks(rows.select("seq", "symbols"), length), "order")

    def windows(batches):
        for b in batches:
            flat, off = _lists(b.column("symbols"))
            rank, _ = _lists(b.column("ranks"))
            n = np.minimum(b.column("owned").to_numpy(), np.maximum(np.diff(off) - length + 1, 0))
            doc = np.repeat(np.arange(len(n)), n)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            at, values = off[doc] + pos, mix(flat.astype(np.uint64))
            hashes = [_span(_prefix(v), at, at + length).view(np.int64) for v in (values, mix(values))]
            yield _batch("rank seq pos h1 h2", rank[at], b.column("seq").to_numpy()[doc], pos, *hashes)

    ordered = rows.join(found, "seq").select("seq", "owned", "symbols", "ranks").mapInArrow(freed(windows), _longs("rank", "seq", "pos", "h1", "h2"))
    ordered = ordered.repartitionByRange("rank", "seq", "pos").sortWithinPartitions("rank", "seq", "pos")

    def compare(batches):
        held: list[np.ndarray] | None = None
        before = np.zeros(0, bool)  # whether the held row has an equal before it
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("rank", "seq", "pos", "h1", "h2")]
            edge = np.zeros(b.num_rows, bool)
            if held is None:
                before, edge[0] = np.zeros(1, bool), True
            else:
                cols, edge = [np.concatenate([h, c]) for h, c in zip(held, cols)], np.concatenate([held_edge, edge])
            same = (cols[3][1:] == cols[3][:-1]) & (cols[4][1:] == cols[4][:-1])
            prev = np.concatenate([before, same])
            hit = prev[:-1] | same
            yield from kept([c[:-1] for c in cols], hit, edge[:-1])
            held, held_edge, before = [c[-1:] for c in cols], edge[-1:], prev[-1:]
        if held is not None:
            yield from kept(held, before, np.ones(1, bool))

    def kept(cols, hit, edge):
        some = hit | edge
        if some.any():
            yield _batch("rank seq pos h1 h2 hit edge", *(c[some] for c in cols), hit[some], edge[some])

    hits = written(ordered.mapInArrow(freed(compare), _longs("rank", "seq", "pos", "h1", "h2") + ", hit boolean, edge boolean"), "hits")
    drop(found)
    ends = hits.where("edge").orderBy("rank", "seq", "pos").collect()  # two rows of each task
    met = {(r["seq"], r["pos"]) for a, b in zip(ends, ends[1:]) if (a["h1"], a["h2"]) == (b["h1"], b["h2"]) for r in (a, b)}
    more = rows.sparkSession.createDataFrame(sorted(met), "seq long, pos long")
    return hits.where("hit").select("seq", "pos").unionAll(more).groupBy("seq").agg(F.sort_array(F.collect_set("pos")).alias("at"))
