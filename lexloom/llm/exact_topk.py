"""Exact top-k search by inner product: tiled matrix products, partial selection, tree merging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_broadcast, written

#: Rows of candidates and of queries in a tile.
TILE, QUERIES = 4096, 512
FAN_IN = 16
#: Bytes of queries that are broadcast at a time.
GROUP_BYTES = 32 << 20

#: The score of an empty place.
EMPTY = np.iinfo(np.int64).min

_LISTS = "block int, part long, query_id binary, ids binary, scores binary"


def _vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and flat integer components of the rows that take part."""
    col, ids = batch.column(1), batch.column(0)
    ok = np.asarray(ids.is_valid()) & np.asarray(col.is_valid())
    flat = col.flatten()
    lens = np.where(np.asarray(col.is_valid()), np.nan_to_num(np.asarray(col.value_lengths().fill_null(0))), 0).astype(np.int64)
    x = np.floor(np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) * scale)
    bad = ~np.isfinite(x)
    row = np.repeat(np.arange(len(lens)), lens)
    ok &= np.bincount(row[bad], minlength=len(lens)) == 0
    keep = ok[row]
    return np.asarray(ids.fill_null(0))[ok].astype(np.int64), lens[ok], x[keep]


def _by_length(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, lens, flat = _vectors(batch, scale)
    start = np.concatenate([[0], np.cumsum(lens)])
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield ids[at], flat[(start[at][:, None] + np.arange(n)).ravel()].reshape(len(at), n)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by float64 where no sum can reach 2**53, else by Python's integers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return (whole(q) @ whole(c).T).astype(np.int64)


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of every row's candidates, empty places last; rows of equal ids count each."""
    order = np.lexsort((ids, -scores, scores == EMPTY), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def _select(s: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Partial selection in a tile: candidates in order of id, so that a place breaks ties."""
    order = np.argsort(ids, kind="stable")
    ids, s = ids[order], s[:, order]
    n = len(ids)
    if n and np.abs(s).max() < 2**62 // max(n, 1):
        key = s * n + (n - 1 - np.arange(n))
    else:
        key = np.argsort(np.argsort(s * 1.0, axis=1, kind="stable"), axis=1)
        full = np.lexsort((np.broadcast_to(-np.arange(n), s.shape), s), axis=1)
        np.put_along_axis(key, full, np.broadcast_to(np.arange(n), s.shape), 1)
    key = np.where(ids[None, :] == own[:, None], np.iinfo(np.int64).min, key)
    m = min(n, k)
    at = np.argpartition(key, n - m, axis=1)[:, n - m :] if m < n else np.broadcast_to(np.arange(n), s.shape)
    gone = np.take_along_axis(key, at, 1) == np.iinfo(np.int64).min
    return ids[at], np.where(gone, EMPTY, np.take_along_axis(s, at, 1))


def _query_groups(queries: DataFrame, scale: float) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Blocks of at most QUERIES queries, streamed to the driver and handed on in groups of bounded bytes."""

    def pack(batches):
        for b in batches:
            for i in range(0, b.num_rows, QUERIES):
                for ids, x in _by_length(b.slice(i, QUERIES), scale):
                    if x.nbytes > GROUP_BYTES:
                        raise ValueError("a block of queries is too large to broadcast")
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    group, size = [], 0
    for row in queries.mapInArrow(pack, "ids binary, x binary").toLocalIterator(prefetchPartitions=True):
        ids = np.frombuffer(row.ids, np.int64)
        x = np.frombuffer(row.x, np.float64).reshape(len(ids), -1)
        group.append((ids, x))
        size += x.nbytes + ids.nbytes
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _search(group: list, candidates: DataFrame, k: int, scale: float, parts: int) -> DataFrame:
    """Lists of one group of queries over all candidates."""
    merged: dict[int, list] = {}
    for ids, x in group:
        merged.setdefault(x.shape[1], []).append((ids, x))
    group = []
    for blocks in merged.values():
        ids, x = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
        group += [(ids[i : i + QUERIES], x[i : i + QUERIES]) for i in range(0, len(ids), QUERIES)]
    size = sum(i.nbytes + x.nbytes for i, x in group)
    shared = bounded_broadcast(candidates.sparkSession, group, size, 3 * GROUP_BYTES)

    def run(batches):
        from pyspark import TaskContext

        best: list = [None] * len(shared.value)
        for b in batches:
            for i in range(0, b.num_rows, TILE):
                for ids, c in _by_length(b.slice(i, TILE), scale):
                    for j, (own, q) in enumerate(shared.value):
                        if q.shape[1] == c.shape[1]:
                            got = _select(_product(q, c), ids, own, k)
                            best[j] = got if best[j] is None else _merge(np.hstack([best[j][0], got[0]]), np.hstack([best[j][1], got[1]]), k)
        part = TaskContext.get().partitionId()
        for j, got in enumerate(best):
            if got is not None:
                got = _merge(*got, k)
                arrays = [[j], [part], [shared.value[j][0].tobytes()], [got[0].tobytes()], [got[1].tobytes()]]
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], names=["block", "part", "query_id", "ids", "scores"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows.query_id.iloc[0]) // 8
        ids = np.hstack([np.frombuffer(x, np.int64).reshape(n, -1) for x in rows.ids])
        scores = np.hstack([np.frombuffer(x, np.int64).reshape(n, -1) for x in rows.scores])
        got = _merge(ids, scores, k)
        return pd.DataFrame({"block": rows.block.iloc[:1], "part": rows.part.iloc[:1] // FAN_IN, "query_id": rows.query_id.iloc[:1], "ids": [got[0].tobytes()], "scores": [got[1].tobytes()]})

    lists = candidates.mapInArrow(run, _LISTS)
    while True:
        lists = lists.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(lambda key, rows: fold(rows), _LISTS)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return lists


def exact_topk(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """For each query its ``k`` candidates of highest inner product, ties to smaller ids.

    Components become ``floor(scale * x)``.  A query's candidates are all rows
    of ``df`` but those of its own id; rows of one id are candidates each.
    Repeated rows of ``queries`` are one query; rows of one id with different
    vectors are queries each.  Vectors (and ids) that are null or hold a null or
    non-finite component take no part, as query or candidate; vectors of
    another length than the query's don't either.  Empty tables give no rows;
    other columns are ignored; ids may be negative.  Returns query_id, rank
    (from 1), vec_id and score.

    Queries are broadcast in groups of bounded size, each over one scan of the
    candidates, which are never shuffled; lists of ``k`` are merged by a tree of
    fan-in 16, so the largest task holds 16 lists of a block.
    """
    pick = lambda d: d.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    candidates, spark = pick(df), df.sparkSession
    parts = candidates.rdd.getNumPartitions()
    found: list[DataFrame] = []
    for group in _query_groups(pick(queries).distinct(), scale):
        one = _search(group, candidates, k, scale, parts)
        found.append(written(one, "topk") if found else one)
    schema = "query_id long, rank int, vec_id long, score long"
    if not found:
        return spark.createDataFrame([], schema)

    def rows(batches):
        for b in batches:
            for q, i, s in zip(b.column("query_id").to_pylist(), b.column("ids").to_pylist(), b.column("scores").to_pylist()):
                q = np.frombuffer(q, np.int64)
                i, s = np.frombuffer(i, np.int64).reshape(len(q), -1), np.frombuffer(s, np.int64).reshape(len(q), -1)
                there = s != EMPTY
                rank = np.broadcast_to(np.arange(1, i.shape[1] + 1, dtype=np.int32), i.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, there.sum(1))), pa.array(rank[there]), pa.array(i[there]), pa.array(s[there])], names=["query_id", "rank", "vec_id", "score"])

    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.mapInArrow(rows, schema)
