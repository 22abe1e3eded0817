"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact verification in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import SPACED, U64, Chunk, chunks, gram_hashes, inside_one, mix
from .components import components
from .store import drop, free_name, freed, trim, written

#: Words of an n-gram, least Jaccard similarity of a link, the share of links that must be found, as measured, and the chance of a pair at the threshold that the longest prefix must give.
GRAM, THRESHOLD, RECALL, START = 3, 0.5, 0.999, 0.99
#: Trees of the forest, and symbols (of 16 bits) of a signature in each.
TREES, DEPTH = 40, 4
#: Classes in a block of the verification, and bytes of text in a task of small components.
BLOCK, TASK_BYTES = 384, 4 << 20
#: Classes in a task that holds the classes of small nodes against each other.
TASK_CLASSES = 8192
#: Rows of candidates that may be broadcast.
BROADCAST_ROWS = 300_000
#: Copies from which a text is joined by broadcast are this share of all rows, so there are few such texts.
HOT_SHARE = 1e-4

_FACTORS = np.random.default_rng(77).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U64(2) + U64(1)


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The chance that a pair of such a similarity shares a prefix of ``depth`` symbols in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def longest(threshold: float) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with the chance START."""
    return max([1, *(d for d in range(1, DEPTH + 1) if chance(threshold, d) >= START)])


def shingles(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words of every text, and the index where each text's begin.

    Words are parted by ASCII white space, A-Z is lower-cased.  A text of fewer
    than ``n`` words has one gram, of all its words; one without words none.
    """
    w = chunk.lower().words(SPACED)
    h = w.hashes()
    ok = inside_one(w.first, len(h), n)
    g, doc = gram_hashes(h, n)[ok], w.doc[: len(ok)][ok]
    few = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            there = w.counts[few] > k
            own[there] = mix(own[there] + h[w.first[few[there]] + k] + U64(k + 1))
        doc = np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        g, doc = np.concatenate([g, own])[order], doc[order]
    return g, np.searchsorted(doc, np.arange(chunk.n + 1))


def signatures(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, TREES) labels: the path of a text in each tree, 16 bits a step; of texts without grams 0."""
    n = len(first) - 1
    out = np.zeros((n, TREES), np.uint64)
    has = np.flatnonzero(first[1:] > first[:-1])
    if not len(has):
        return out
    at, x = first[:-1][has], np.empty_like(g)
    for m in range(TREES * DEPTH):
        np.multiply(g, _FACTORS[m], out=x)
        low = mix(np.minimum.reduceat(x, at)) >> U64(48)
        out[has, m // DEPTH] = out[has, m // DEPTH] << U64(16) | low
    return out


def _same_steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal steps of signatures, an estimate of the similarity."""
    x, n = a ^ b, np.zeros(len(a))
    for k in range(DEPTH):
        n += ((x >> U64(16 * k)) & U64(0xFFFF) == 0).sum(1)
    return n / (a.shape[1] * DEPTH)


def _classes(base: DataFrame, gram: int) -> DataFrame:
    """One row for each different text: class, md5, least id, copies, bytes, labels (empty for a text without words)."""
    schema = T.StructType([base.schema["doc_id"]]).add("md5", "string").add("bytes", "long").add("labels", T.ArrayType(T.LongType()))

    def run(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                g, first = shingles(c, gram)
                sig, has = signatures(g, first), first[1:] > first[:-1]
                cut = np.concatenate([[0], np.cumsum(np.where(has, TREES, 0))]).astype(np.int32)
                labels = pa.ListArray.from_arrays(pa.array(cut), pa.array(sig[has].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.first, c.n), b.column("md5").slice(c.first, c.n), pa.array(np.diff(c.off)), labels], names=schema.names)

    rows = base.mapInArrow(run, schema)
    one = rows.groupBy("md5").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies"), F.max("bytes").alias("bytes"), F.max("labels").alias("labels"))
    return written(one.withColumn("cls", F.monotonically_increasing_id()), "classes")


class Forest:
    """The prefix tries of all trees, as rows in order of (tree, label, class).

    Labels are compared with their neighbours': ``deep`` is the longest prefix,
    in symbols, that a row shares with the row before or after it, so the node
    of depth d over it has company if ``deep`` >= d, and ``heads`` are the first
    classes of its nodes of depths ``floor`` to ``top``, itself in a node's first
    row.  Rows are sorted by range, so a node of any number of rows lies over
    many tasks, each of which reads its rows as a stream and has heads of its
    own; where two tasks meet, the rows beside the cut are held against each
    other here.  Rows that share fewer than ``floor`` symbols with both
    neighbours are left out.
    """

    def __init__(self, sig: DataFrame, floor: int, top: int):
        steps = sig.select("cls", F.posexplode("labels").alias("tree", "label"))
        ordered = steps.select("tree", "label", "cls").repartitionByRange("tree", "label", "cls").sortWithinPartitions("tree", "label", "cls")
        depths = range(floor, top + 1)

        def run(batches):
            held: tuple[np.ndarray, ...] | None = None
            for b in batches:
                if not b.num_rows:
                    continue
                tree, label, cls = (b.column(c).to_numpy().astype(np.int64) for c in ("tree", "label", "cls"))
                lcp, edge = np.full(1, -1), np.ones(1, bool)
                before = np.repeat(cls[:1], len(depths))
                if held is not None:
                    tree, label, cls = (np.concatenate([h, x]) for h, x in zip(held, (tree, label, cls)))
                    lcp, edge, before = held[3:]
                lcp = np.concatenate([lcp, shared_symbols(tree[:-1], label[:-1], tree[1:], label[1:])])
                edge = np.concatenate([edge, np.zeros(len(cls) - 1, bool)])
                heads = np.empty((len(cls), len(depths)), np.int64)
                for k, d in enumerate(depths):
                    first = np.where(lcp < d, np.arange(len(cls)), 0)
                    first[0] = 0
                    first = np.maximum.accumulate(first)
                    heads[:, k] = np.where(first == 0, before[k], cls[first])
                deep = np.maximum(lcp[:-1], lcp[1:])
                yield from rows(tree[:-1], label[:-1], cls[:-1], heads[:-1], deep, edge[:-1])
                held = (tree[-1:], label[-1:], cls[-1:], lcp[-1:], edge[-1:], heads[-1])
            if held is not None:
                yield from rows(*held[:3], held[5][None], held[3], np.ones(1, bool))

        def rows(tree, label, cls, heads, deep, edge):
            keep = (deep >= floor) | edge
            if keep.any():
                lists = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1, dtype=np.int32) * len(depths)), pa.array(heads[keep].ravel()))
                arrays = [pa.array(x[keep]) for x in (tree.astype(np.int32), label, cls, deep.astype(np.int8), edge)]
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=["tree", "label", "cls", "deep", "edge", "heads"])

        self.floor = floor
        self.rows = written(ordered.mapInArrow(freed(run), "tree int, label long, cls long, deep byte, edge boolean, heads array<long>"), "forest")
        ends = self.rows.where("edge").select("tree", "label", "cls").orderBy("tree", "label", "cls").collect()  # two rows of each task
        t, x, c = (np.array(col, np.int64) for col in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 3
        met = list(zip(c[:-1].tolist(), c[1:].tolist(), shared_symbols(t[:-1], x[:-1], t[1:], x[1:]).tolist()))
        self.met = sig.sparkSession.createDataFrame(met, "cls long, head long, lcp int")

    def edges(self, depth: int) -> DataFrame:
        """(a, b): the classes of each node of a depth with the first ones, which connect it."""
        stars = self.rows.select("cls", F.element_at("heads", depth - self.floor + 1).alias("head"))
        both = stars.unionAll(self.met.where(F.col("lcp") >= depth).select("cls", "head")).where(F.col("cls") != F.col("head"))
        return both.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()

    def members(self, depth: int) -> DataFrame:
        """(node, cls): the classes of the nodes of a depth; nodes of one class may be among them."""
        node = F.xxhash64("tree", F.shiftrightunsigned("label", 16 * (DEPTH - depth)))
        return self.rows.where((F.col("deep") >= depth) | F.col("edge")).select(node.alias("node"), "cls")


def shared_symbols(tree_a: np.ndarray, a: np.ndarray, tree_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the labels' longest common prefixes have, -1 in different trees."""
    x = (a ^ b).view(np.uint64)
    n = sum((x >> U64(16 * (DEPTH - k)) == 0).astype(np.int64) for k in range(1, DEPTH)) + (x == 0)
    return np.where(tree_a == tree_b, n, -1)


def _candidates(forest: Forest, sig: DataFrame, threshold: float, depth: int) -> DataFrame:
    """(node, label): the component of every class that has candidates.

    Two classes below one node of a depth are candidates if their signatures
    agree in at least half the threshold's share of steps: a pair at the
    threshold is that far off its expectation with a chance below 1e-9.  First
    the classes of a node are held against its first ones, then, in nodes whose
    classes aren't connected by that, all pairs of different components, in
    pairs of blocks.
    """
    joined = (
        forest.edges(depth)
        .join(sig.select(F.col("cls").alias("a"), F.col("labels").alias("x")), "a")
        .join(sig.select(F.col("cls").alias("b"), F.col("labels").alias("y")), "b")
    )

    def run(batches):
        for b in batches:
            x, y = (np.asarray(b.column(c).flatten()).view(np.uint64).reshape(b.num_rows, TREES) for c in "xy")
            keep = pa.array(_same_steps(x, y) >= threshold / 2)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    comps = written(components(joined.mapInArrow(freed(run), "a long, b long")), "components")
    more = components(_edges_across(forest.members(depth), comps, sig, threshold))
    grown = comps.join(more.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return grown.unionByName(more.join(comps.select("node"), "node", "left_anti").select("node", "label"))


def _edges_across(members: DataFrame, comps: DataFrame, sig: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) between components of which a node has candidates of each, from (node, cls).

    A component's number is its label, or the class if it is in none.  Nodes of
    the same classes are looked at once.  Two classes are a first one and another.
    """
    label = F.coalesce("label", "cls").alias("label")
    rows = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("node", "cls", label)
    h = F.xxhash64("cls")
    apart = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")).where("lo <> hi AND n > 2")
    one = apart.groupBy("n", "x", "y").agg(F.min("node").alias("node")).select("node", "n")
    rows = written(rows.join(one, "node"), "apart")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    tasks = 1 + rows.count() // TASK_CLASSES
    small = rows.where(F.col("n") <= BLOCK).select(F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("tile"), "node", "cls", "label", F.lit(2).alias("side"))
    tiles = (
        rows.where(F.col("n") > BLOCK).select("node", "cls", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "node", "cls", "label", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    )

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("node")
        nodes, comp, side = (t.column(c).to_numpy() for c in ("node", "label", "side"))
        steps = np.asarray(t.column("labels").combine_chunks().flatten()).view(np.uint16).reshape(t.num_rows, TREES * DEPTH)
        cut = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1], [True]]))
        out = np.zeros((0, 2), np.int64)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            for k in range(s, e):
                to = np.arange(k + 1, e)
                to = to[(comp[to] != comp[k]) & ((side[k] == 2) | (side[to] != side[k]))]
                to = to[(steps[to] == steps[k]).sum(1) >= threshold / 2 * steps.shape[1]]
                if len(to):
                    out = np.concatenate([out, np.stack([np.full(len(to), comp[k]), comp[to]], 1)])
            if len(out) > BLOCK:
                out = np.unique(np.sort(out, 1), axis=0)
        out = np.unique(np.sort(out, 1), axis=0)
        return pa.table({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    return small.unionAll(tiles).join(sig, "cls").groupBy("tile").applyInArrow(run, "a long, b long")


def _links_in_block(g: np.ndarray, first: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts of at least the threshold's similarity, and that: between those whose ``side`` is 0 and 1, or among all if it is 2."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    one = np.ones(len(g), bool)
    one[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[one], doc[one]
    size = np.bincount(doc, minlength=n)
    order = np.argsort(g, kind="stable")
    g, doc = g[order], doc[order]
    number = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]).astype(np.int64)])) if len(g) else g
    often = np.bincount(number) > 1 if len(g) else np.zeros(0, bool)
    both = bool((side == 2).all())
    rows, cols = (np.arange(n), np.arange(n)) if both else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    common = np.zeros((len(rows), len(cols)), np.float32)
    if often.any():
        keep = often[number]
        number, doc = (np.cumsum(often) - 1)[number[keep]], doc[keep]
        step = 4096
        for i in range(0, int(often.sum()), step):
            a, b = np.searchsorted(number, [i, i + step])
            m = np.zeros((n, step), np.float32)
            m[doc[a:b], number[a:b] - i] = 1
            common += m[rows] @ m[cols].T
    union = size[rows][:, None] + size[cols][None, :] - common
    i, j = np.nonzero((common >= threshold * union) & (union > 0))
    alike = common[i, j] / union[i, j]
    i, j = rows[i], cols[j]
    return (i[i < j], j[i < j], alike[i < j]) if both else (i, j, alike)


def _forest_of(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, fewer than texts."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _verified(texts: DataFrame, gram: int, threshold: float) -> DataFrame:
    """Rows (a, b, n, w1 to w4): n links of class a where b is null, else an edge between classes, from (tile, comp, cls, side, text).

    ``w<d>`` is the number of links that the n found ones stand for, if a pair is found with its chance at depth d.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["comp", "cls", "side"]).sort_values(["comp", "cls"], kind="stable")
        out: list[tuple] = []
        comps = rows["comp"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], comps[1:] != comps[:-1], [True]]))
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            part = rows.iloc[s:e]
            gs, firsts, base = [], [np.zeros(1, np.int64)], 0
            for c in chunks(pa.array(part["text"], pa.large_string())):
                g, first = shingles(c, gram)
                gs.append(g)
                firsts.append(first[1:] + base)
                base += len(g)
            cls = part["cls"].to_numpy()
            i, j, alike = _links_in_block(np.concatenate(gs), np.concatenate(firsts), part["side"].to_numpy(), threshold)
            ends = np.concatenate([i, j])
            n = np.bincount(ends, minlength=len(cls))
            w = [np.bincount(ends, np.tile(1 / chance(alike, d), 2), len(cls)) for d in range(1, DEPTH + 1)]
            out += [(int(cls[k]), None, int(n[k]), *(float(x[k]) for x in w)) for k in np.flatnonzero(n).tolist()]
            out += [(int(cls[a]), int(cls[b]), 0, *[0.0] * DEPTH) for a, b in _forest_of(len(cls), i, j)]
        trim()
        cols = list(zip(*out)) or [()] * (3 + DEPTH)
        return pd.DataFrame({**{c: pd.array(x, "Int64") for c, x in zip("abn", cols)}, **{f"w{d}": np.array(x, float) for d, x in enumerate(cols[3:], 1)}})

    return texts.groupBy("tile").applyInPandas(run, "a long, b long, n long, " + ", ".join(f"w{d} double" for d in range(1, DEPTH + 1)))


def _tiles(texts: DataFrame, total: int) -> DataFrame:
    """(tile, comp, cls, side, text) for the verification: components up to a block share a tile, larger ones are cut into pairs of blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    small = texts.where(F.col("size") <= BLOCK).select(F.xxhash64(F.pmod(F.xxhash64("comp"), F.lit(1 + total // TASK_BYTES))).alias("tile"), "comp", "cls", F.lit(2).alias("side"), "text")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    large = (
        texts.where(F.col("size") > BLOCK).select("comp", "cls", "text", own.alias("own"), other.alias("other"))
        .select(F.xxhash64("comp", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "comp", "cls", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "text")
    )
    return small.unionAll(large)


def _links(base: DataFrame, classes: DataFrame, gram: int, threshold: float, recall: float) -> DataFrame:
    """The verified rows of :func:`_verified`.

    Prefixes are matched first at the length at which a pair at the threshold is
    found with the chance START, and by a symbol less each time until the links
    found make up ``recall`` of all, of which each found one stands for as many
    as its chance to be found says.  Components that a shorter prefix leaves as
    they are aren't verified again.
    """
    sig = classes.select("cls", "labels").where(F.size("labels") > 0)
    depth, forest, found, before = longest(threshold), None, None, None
    while True:
        if forest is None or depth < forest.floor:
            forest = Forest(sig, max(1, depth - 1), depth)
        comps = written(_candidates(forest, sig, threshold, depth), "candidates")
        sizes = comps.groupBy(F.col("label").alias("comp")).agg(F.count("*").alias("size"))
        sized = written(comps.select(F.col("node").alias("cls"), F.col("label").alias("comp")).join(sizes, "comp"), "sized")
        todo = sized if before is None else sized.join(before, ["comp", "size"], "left_anti")
        wanted = written(todo.join(classes.select("cls", "md5", "copy_id", "bytes"), "cls"), "wanted")
        n, total = wanted.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        pick = wanted.drop("bytes")
        if n <= BROADCAST_ROWS:
            pick = F.broadcast(pick)
        texts = base.join(pick, (base["md5"] == wanted["md5"]) & base["doc_id"].eqNullSafe(wanted["copy_id"])).select("cls", "comp", "size", "text")
        new = _verified(_tiles(texts, total), gram, threshold)
        if found is not None:
            new = new.unionByName(found.join(wanted.select(F.col("cls").alias("a")), "a", "left_anti"))
        new = written(new, "links")
        links, stand_for = new.where("b IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(f"w{depth}"), F.lit(0.0))).first()
        for table in (comps, wanted, *([found] if found is not None else [])):
            drop(table)
        found, before = new, sized.select("comp", "size").distinct()
        if depth == 1 or links >= recall * stand_for:
            drop(forest.rows)
            return found
        depth -= 1


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    gram: int = GRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """One row for each row of ``df``: its near-copy class and its links.

    Texts are linked if the Jaccard similarity of their sets of word n-grams is
    at least ``threshold``.  Equal texts are one class of copies and get the
    same values; ``n_links`` counts the different texts linked to this one,
    ``copy_id`` is the least id among equal texts, ``n_copies`` their number,
    and ``class_id`` the least ``copy_id`` among texts connected by links (for
    null ids null, the least of others counting).  Null is an empty text; texts
    without words are linked to none.  Repeated rows are copies; other columns
    are ignored; an empty table gives no rows.

    Candidates: a forest of TREES tries over MinHash signatures, whose prefixes
    are matched at the length that suits the threshold and then shortened until
    ``recall``, as measured from the links found, is met.  Each two classes of a node are connected, or
    their signatures show them to be apart; connected candidates are a
    component.  Verification: all pairs of a component, exactly, by products
    of incidence matrices of blocks of at most BLOCK texts, so that a link
    between candidates is never lost and no task holds more than two blocks.
    """
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("md5", F.md5("text"))
    classes = _classes(base, gram)
    found = _links(base, classes, gram, threshold, recall)
    links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    tops = components(found.where("b IS NOT NULL").select("a", "b"))
    ids = tops.join(classes.select(F.col("cls").alias("node"), "copy_id"), "node")
    least = ids.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    linked = tops.join(least, "label").select(F.col("node").alias("cls"), "class_id")
    per = classes.select("cls", "md5", "copy_id", "n_copies").join(linked, "cls", "left").join(links, "cls", "left")
    per = written(per.select("md5", "copy_id", "n_copies", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "per")
    rows = per.agg(F.coalesce(F.sum("n_copies"), F.lit(0))).first()[0]
    hot = per.where(F.col("n_copies") > max(100, HOT_SHARE * rows))
    docs = base.select("doc_id", "md5")
    out = docs.join(F.broadcast(hot), "md5").unionByName(docs.join(F.broadcast(hot.select("md5")), "md5", "left_anti").join(per, "md5"))
    return out.select("doc_id", "class_id", "copy_id", "n_copies", "n_links")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` but one of each near-copy class: that whose id is least (of equal ids one; null ids come last).

    Null texts are empty ones, all empty texts copies of each other, texts
    without words otherwise alike to none.  All columns stay, whatever their
    names; an empty table gives no rows.  Rows are dropped by a broadcast of
    their numbers if these are few enough, else by a shuffled join.
    """
    own = free_name(df, "row")
    order = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(own))
    rows = written(df.withColumn(own, F.monotonically_increasing_id()), "rows")
    found = near_copies(rows.select(F.col(own).alias("doc_id"), F.col(f"`{text}`").alias("text")), gram=options.pop("gram", GRAM), **options)
    found = written(found.where("n_links > 0 OR n_copies > 1").select(F.col("doc_id").alias(own), F.col("class_id").alias(f"{own}_class")), "near")
    ids = rows.select(own, f"`{id_col}`").join(found, own)
    first = ids.groupBy(f"{own}_class").agg(F.min(order).alias("first"))
    stay = first.select(F.col(f"first.{own}").alias(own))
    gone = written(found.select(own).join(stay, own, "left_anti"), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, own, "left_anti").drop(own)
