"""Language-model scores by a probabilistic suffix tree over phrases, beside smoothed unigrams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import GRAM, SPACED, U64, Chunk, Words, chunks, column_bytes, mix
from .compression_classifier import crc_bucket
from .store import freed, trim, written

#: Longest context, in phrases; a word in so many ends a phrase.
DEPTH, PHRASE = 2, 8
#: Times that a phrase, or a phrase after a context, must occur in training to be known there.
LEAST = 2
#: Bits per occurrence by which the phrases known after a context must diverge from those after its suffix, and bits for each such phrase in all.
DIVERGENCE, EVIDENCE = 0.03, 4.0
#: Bytes of texts, and symbols, of a part, whose keys are counted and answered together; bytes of texts in a row.
PART_BYTES, HELD, ROW_BYTES = 16 << 20, 1 << 20, 1 << 19
#: Symbols of all texts for each bucket, a range of keys whose counts are summed together.
BUCKET = 1 << 21

#: Symbols beside words: the end of a text, and the phrase before its first.
_END, _BEGIN = U64(0x1B873593CC9E2D51), U64(0x38495AB5A1D2C3E4)
_SEED, _NONE = U64(0x9AE16A3B2F90404F), U64(3)
#: What stands for the order in the keys of words that are counted beside phrases.
_WORD = 3


# -- phrases


def phrases(w: Words, one_in: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of all texts: their keys, how many words each has, the index where each text's begin, and the phrase of every word.

    A phrase ends with a word whose hash says so (one in ``one_in``; with 1
    every word is a phrase) or with the
    end of its text, which counts as a symbol; so phrases, like words, don't
    depend on where they stand, and none is the beginning of another.
    """
    h, n = w.hashes(), w.chunk.n
    last = np.zeros(len(h), bool)
    ends = mix(h ^ _SEED) % U64(one_in) == 0
    at = np.arange(len(h)) + w.doc  # places of the words among the symbols, an end after each text
    size = len(h) + n
    sym, cut = np.full(size, _END), np.ones(size, bool)
    sym[at], cut[at] = h, ends
    stop = np.flatnonzero(cut)
    start = np.concatenate([[0], stop[:-1] + 1])
    of = np.cumsum(cut) - cut
    place = np.arange(size) - start[of]
    key = mix(np.add.reduceat(mix(sym + mix(place.astype(np.uint64) + U64(1))), start)) if size else np.zeros(0, np.uint64)
    words = stop - start + 1
    text_end = w.first[1:] + np.arange(n)
    first = np.concatenate([[0], of[text_end] + 1]).astype(np.int64)
    words[first[1:] - 1] -= 1
    return key, words, first, of[at]


def _gram(chain: np.ndarray, order: int) -> np.ndarray:
    """Keys of grams; the last two bits tell the order."""
    return mix(chain ^ _SEED) >> U64(2) << U64(2) | U64(order)


def grams(key: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of every phrase after contexts of 0, 1, ... DEPTH phrases; _NONE where the text hasn't so many before it.

    What stands before a text's first phrase is a phrase of its own.
    """
    begins = np.zeros(len(key), bool)
    begins[first[:-1]] = True  # every text has a phrase
    place = np.arange(len(key)) - np.repeat(first[:-1], np.diff(first))
    before = np.concatenate([[_BEGIN], key[:-1]]).astype(np.uint64)[: len(key)]
    before[begins] = _BEGIN
    out, chain, prev = [_gram(key, 0)], key, before
    for d in range(1, DEPTH + 1):
        chain = mix(chain * GRAM + prev)
        out.append(np.where(place >= d - 1, _gram(chain, d), _NONE))
        prev = np.concatenate([[_BEGIN], prev[:-1]]).astype(np.uint64)[: len(key)]
    return out


#: The key of a text's beginning as a context.
BEGIN = _gram(np.array([_BEGIN]), 0)[0]


# -- packed numbers

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of all of them, without the bytes that are 0 in all, compressed."""
    x = x.astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + _ZIP.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZIP.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    return out.reshape(-1).view("<u8")


def packed_keys(keys: np.ndarray) -> bytes:
    """Rising keys, by their differences."""
    d = keys.copy()
    d[1:] -= keys[:-1]
    return packed(d)


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64)


def _all(blobs, of=unpacked, kind=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blobs, and the index where each one's begin."""
    got = [of(x) for x in blobs]
    return np.concatenate([np.zeros(0, kind), *got]), np.cumsum([0, *map(len, got)])


# -- parts


class Part:
    """The texts of a part as phrases and grams; the same whenever it is read."""

    def __init__(self, table: pa.Table, one_in: int):
        self.part, self.texts = table.column("part")[0].as_py(), []
        cols: list[list[np.ndarray]] = [[], [], [], []]
        ends, self.separate = [np.zeros(1, np.int64)], one_in > 1
        for blob in table.sort_by("seq").column("texts"):
            b = pa.ipc.open_stream(blob.as_buffer()).read_next_batch()
            w = Chunk(*column_bytes(b.column("text"))).words(SPACED)
            key, words, first, of = phrases(w, one_in)
            for col, x in zip(cols, (key, (of + ends[-1][-1]).astype(np.int32), w.counts, w.hashes() if self.separate else key[:0])):
                col.append(x)
            ends.append(first[1:] + ends[-1][-1])
            self.texts.append(b.drop_columns(["text"]))
        self.key, self.of, self.n_words, words = (np.concatenate(x) for x in cols)
        self.first = np.concatenate(ends)
        self.train = ~np.concatenate([b.column("held_out").to_numpy(zero_copy_only=False) for b in self.texts])
        self.grams = grams(self.key, self.first)
        self.words = _gram(words, _WORD)

    def trained(self) -> np.ndarray:
        """Which phrases are of training texts."""
        return np.repeat(self.train, np.diff(self.first))

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of phrases, alone and after one, and of words where phrases are not words; and which are of training texts."""
        train, g = self.trained(), self.grams
        if not self.separate:
            return np.concatenate(g[:2]), np.tile(train, 2)
        return np.concatenate([*g[:2], self.words]), np.concatenate([train, train, np.repeat(self.train, self.n_words)])

    def previous(self, x: np.ndarray, begin) -> np.ndarray:
        """Of each phrase what ``x`` has for the phrase before it in its text, ``begin`` for a first one."""
        out = np.concatenate([x[:1], x[:-1]])
        out[self.first[:-1]] = begin
        return out

    def longer(self, n: np.ndarray) -> np.ndarray:
        """Where a phrase after two can occur LEAST times in training: both grams of order 1 in it do (``n``: their occurrences)."""
        return np.flatnonzero((self.grams[2] != _NONE) & (n >= LEAST) & (self.previous(n, 0) >= LEAST))


def _heads(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[_heads(keys)]


def _places(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones, which have them all; keys in order are faster to find."""
    order, out = np.argsort(keys), np.empty(len(keys), np.int32)
    out[order] = np.searchsorted(distinct, keys[order])
    return out


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and how often each occurs in training."""
    distinct, seen = _distinct(keys), np.sort(keys[train])
    head, n = _heads(seen), np.zeros(len(distinct), np.uint64)
    n[np.searchsorted(distinct, seen[head])] = np.diff(np.append(head, len(seen)))
    return distinct, n


def _cuts(keys: np.ndarray, buckets: int) -> list[int]:
    """Where the keys of each bucket begin among rising keys."""
    return np.searchsorted(((keys >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=np.uint64)).tolist()


def _told(table: pa.Table, step: int, col: str = "answer") -> np.ndarray:
    """What a part was told for its distinct keys of a step, in their order."""
    table = table.filter(pc.equal(table.column("step"), step)).sort_by("bucket")
    return _all(x.as_py() for x in table.column(col))[0].astype(np.int64)


# -- counting

_REQUEST, _ANSWER = "part long, bucket long, keys binary, n binary", "step int, part long, bucket long, answer binary, kinds binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _request(p: Part, buckets: int, keys: np.ndarray, train: np.ndarray) -> pa.Table:
    distinct, n = _counted(keys, train)
    cuts = _cuts(distinct, buckets)
    rows = [(p.part, b, packed_keys(distinct[i:j]), packed(n[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    return _table(_REQUEST, rows)


def _totals(requests: DataFrame, step: int) -> DataFrame:
    """Per part and bucket, for each distinct key asked for: twice its training occurrences in all parts, plus 1 for the first part that asks.

    Rows of part -1 - d sum up the keys of order d: occurrences, keys that
    occur, and occurrences and number of those that occur LEAST times.
    """
    sums = ", total long, distinct long, known long, known_kinds long"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        bucket, rows = table.column("bucket")[0].as_py(), []
        keys, cut = _all((x.as_py() for x in table.column("keys")), unpacked_keys)
        n = _all(x.as_py() for x in table.column("n"))[0].astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        head = _heads(keys)
        total, key = np.add.reduceat(n, head), keys[head]
        value = 2 * np.repeat(total, np.diff(np.append(head, len(keys))))
        value[head] += 1
        answer = np.empty_like(value)
        answer[order] = value
        for part, i, j in zip(table.column("part").to_pylist(), cut[:-1].tolist(), cut[1:].tolist()):
            rows.append((step, part, bucket, packed(answer[i:j]), None, 0, 0, 0, 0))
        for d in (0, _WORD):
            x = total[key & U64(3) == d]
            rows.append((step, -1 - d, bucket, None, None, int(x.sum()), int((x > 0).sum()), int(x[x >= LEAST].sum()), int((x >= LEAST).sum())))
        trim()
        return _table(_ANSWER + sums, rows)

    return requests.groupBy("bucket").applyInArrow(run, _ANSWER + sums)


# -- the tree

_CONTEXTS = "part long, bucket long, asked binary, contexts binary, known binary, kinds binary, bits binary"


def _contexts(p: Part, told: pa.Table, buckets: int, texts: int, total: int) -> pa.Table:
    """What a part has for the contexts: the keys of those it asks for, and of each context the grams known after it that this part is the first to have.

    These are summed up for a context as their occurrences, their number, and
    the bits by which they diverge from the distribution after its suffix.
    """
    distinct, value = _distinct(p.short()[0]), _told(told, 1)
    n, (g0, g1, g2) = value >> 1, p.grams
    n0 = lambda at: n[np.searchsorted(distinct, g0[at])]
    place = _places(distinct, g1)
    n1 = n[place]
    first = np.zeros(len(g1), bool)
    first[p.first[:-1]] = True
    kept = []

    def add(value: np.ndarray, context: np.ndarray, of_context: np.ndarray, n_suffix: np.ndarray, of_suffix) -> None:
        x = value >> 1
        kept.append((context, x, x * (np.log2(x / of_context) - np.log2(n_suffix / of_suffix))))

    def own(at: np.ndarray, keys: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct key that is known and this part's own, and its value."""
        order = np.argsort(keys)
        order = order[_heads(keys[order])]
        keep = (value & 1 == 1) & (value >> 1 >= LEAST)
        return at[order[keep]], value[keep]

    one = np.zeros(len(distinct), bool)
    one[place] = True
    at, v = own(np.arange(len(g1)), g1, value[one])
    before = lambda at: np.where(first[at], texts, n0(at - 1))
    add(v, np.where(first[at], BEGIN, g0[at - 1]), before(at), n0(at), total)
    at = p.longer(n1)
    at, v = own(at, g2[at], _told(told, 2))
    add(v, g1[at - 1], n1[at - 1], n1[at], before(at))

    context, x, bits = (np.concatenate(c) for c in zip(*kept))
    order = np.argsort(context)
    context, x, bits = context[order], x[order], bits[order]
    head = _heads(context)
    kinds = np.diff(np.append(head, len(context)))
    known, bits = (np.add.reduceat(c, head) if len(head) else c for c in (x, bits))
    context, asked = context[head], _asked(distinct, n)
    rows, cuts = [], [_cuts(c, buckets) for c in (asked, context)]
    for b in range(buckets):
        i, j, k, m = cuts[0][b], cuts[0][b + 1], cuts[1][b], cuts[1][b + 1]
        if j > i or m > k:
            rows.append((p.part, b, packed_keys(asked[i:j]), packed_keys(context[k:m]), packed(known[k:m]), packed(kinds[k:m]), bits[k:m].astype("<f8").tobytes()))
    return _table(_CONTEXTS, rows)


def _asked(distinct: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The contexts that a part asks for: its grams that are known, and the beginning of a text."""
    keys = distinct[(n >= LEAST) & (distinct & U64(3) != _WORD)]
    return np.insert(keys, np.searchsorted(keys, BEGIN), BEGIN)


def _states(contexts: DataFrame, divergence: float, evidence: float) -> DataFrame:
    """Per part and bucket, for each context asked for: the occurrences and the number of the phrases known after it, 0 if it doesn't stay.

    A context stays if the phrases known after it (LEAST times or more) diverge
    from their distribution after its suffix by ``divergence`` bits an
    occurrence and EVIDENCE bits for each of them, so a likelihood-ratio test.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        bucket, rows = table.column("bucket")[0].as_py(), []
        of = lambda name: [x.as_py() for x in table.column(name)]
        key = _all(of("contexts"), unpacked_keys)[0]
        order = np.argsort(key, kind="stable")
        key, known, kinds = key[order], *(_all(of(c))[0].astype(np.int64)[order] for c in ("known", "kinds"))
        bits = np.frombuffer(b"".join(of("bits")), "<f8")[order]
        head = _heads(key)
        if len(head):
            known, kinds, bits = (np.add.reduceat(c, head) for c in (known, kinds, bits))
            stay = (bits >= divergence * known) & (bits >= evidence * kinds)
            key, known, kinds = key[head][stay], known[stay], kinds[stay]
        key, known, kinds = np.append(key, U64(0)), np.append(known, 0), np.append(kinds, 0)  # the last stands for contexts that don't stay
        for part, asked in zip(of("part"), of("asked")):
            asked = unpacked_keys(asked)
            at = np.searchsorted(key[:-1], asked)
            at[key[at] != asked] = len(key) - 1
            rows.append((3, part, bucket, packed(known[at]), packed(kinds[at])))
        trim()
        return _table(_ANSWER, rows)

    return contexts.groupBy("bucket").applyInArrow(run, _ANSWER)


def _scores(p: Part, told: pa.Table, texts: int, total: int, known: int, kinds: int, words: int, distinct_words: int) -> pa.Table:
    """Per text what ``lm_scores`` returns.

    A phrase is looked up after the longest context of the tree that its
    history ends with.  After a context of n occurrences, of which ``known``
    are of ``kinds`` known phrases, a known phrase of c occurrences has c / (n +
    kinds), what is left goes to the context's suffix, and from the empty
    context to the words themselves.
    """
    distinct, n = _distinct(p.short()[0]), _told(told, 1) >> 1
    asked = _asked(distinct, n)
    of_asked = _told(told, 3), _told(told, 3, "kinds")
    begin = int(np.searchsorted(asked, BEGIN))
    at = np.searchsorted(distinct, np.delete(asked, begin))
    states = [np.zeros(len(n), np.int64) for _ in of_asked]
    for s, x in zip(states, of_asked):
        s[at] = np.delete(x, begin)
    places = [_places(distinct, g) for g in p.grams[:2]]
    at = p.longer(n[places[1]])
    n2 = np.zeros(len(p.key), np.int64)
    if len(at):
        keys = p.grams[2][at]
        n2[at] = (_told(told, 2) >> 1)[_places(_distinct(keys), keys)]
    p.grams = []
    logp, open_ = np.zeros(len(p.key)), np.ones(len(p.key), bool)
    for d in range(DEPTH, -1, -1):
        n_d = n2 if d == DEPTH else n[places[d]]
        at = np.flatnonzero(open_)
        if d:
            start = (*(int(x[begin]) for x in of_asked), texts) if d == 1 else (0, 0, 0)
            m, k, all_ = (p.previous(x[places[d - 1]], y)[at] for x, y in zip((*states, n), start))
        else:
            m, k, all_ = (np.full(len(at), x) for x in (known, kinds, total))
        hit = (k > 0) & (n_d[at] >= LEAST)
        miss = (k > 0) & ~hit
        logp[at[hit]] += np.log10(n_d[at[hit]] / (all_[hit] + k[hit]))
        logp[at[miss]] += np.log10((all_[miss] - m[miss] + k[miss]) / (all_[miss] + k[miss]))
        open_[at[hit]] = False
    del m, k, all_, n_d, n2, hit, miss, at
    unit, end = float(np.log10(words + 0.5 * (distinct_words + 1))), float(np.log10(texts + 0.5))
    of_words = n[_places(distinct, p.words) if p.separate else places[0][p.of]]
    logs = np.bincount(p.of, weights=np.log10(of_words + 0.5) - unit, minlength=len(p.key)).astype(float)  # of no words, counts
    logs[p.first[1:] - 1] += end - unit
    whole, score = np.add.reduceat(logs, p.first[:-1]), np.add.reduceat(logp + np.where(open_, logs, 0.0), p.first[:-1])
    tokens = p.n_words + 1
    seen = np.bincount(np.repeat(np.arange(len(tokens)), p.n_words), weights=of_words > 0, minlength=len(tokens)).astype(np.int64) + int(texts > 0)
    out = pa.Table.from_batches(p.texts)
    for name, x in (("n_tokens", tokens.astype(np.int64)), ("n_known", seen), ("train_tokens", np.full(len(tokens), words)), ("base_score", whole), ("score", score), ("gain", (score - whole) / tokens)):
        out = out.append_column(name, pa.array(x))
    return out


def lm_scores(df: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = 1, folds: int = 5, divergence: float = DIVERGENCE, hot: float | None = None, phrase: int = PHRASE) -> DataFrame:
    """Scores of every whole text under two models learnt from the rows that aren't held out.

    Held out are rows whose crc32(id as text) mod ``folds`` is ``held``; a null
    id counts as an empty text.  Texts are lower-cased (A-Z); tokens are the
    words between ASCII white space, and one end.  Returns doc_id, held_out,
    n_tokens, n_known (tokens seen in training), train_tokens, base_score (sum
    of log10((c + 0.5) / (N + 0.5 (V + 1)))), score, the suffix tree's log10
    probability of the text, and gain, what a token of it is better by.  A null text is an empty one, its only token is
    the end.  Rows are scored each, repeated or not; an empty table gives no
    rows; other columns are ignored.

    The tree's symbols are phrases, words up to one in ``phrase`` that ends a
    phrase by its hash; with 1 they are the words, and the end of a text; its contexts are of up to DEPTH phrases and grow in number with the
    text there is.  Phrases that aren't known are spelled as words, with the
    probabilities of the base score, so with nothing known the two are equal.

    Words and phrases are counted by 64-bit hashes, by parts of bounded size:
    each part asks for its different grams, by rising keys, and is told the
    sums in the same order, without the keys.  A phrase after two is asked for
    only where both shorter grams in it occur LEAST times, as it can't do so
    otherwise.  Sums are made by ranges of keys.  Texts are compressed, and read
    anew for each step.  No count, tree or group is held on the driver or in one
    task.  ``hot`` has no effect any more, as rare and frequent words are
    counted alike.
    """
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), (crc_bucket(F.col(f"`{id_col}`"), folds) == held).alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part, size, symbols, seq = TaskContext.get().partitionId() << 33, 0, 0, 0
        for b in batches:
            for c in chunks(b.column("text"), min(ROW_BYTES, PART_BYTES)):
                c = c.lower()
                n, rows = len(c.words(SPACED).starts) + c.n, b.slice(c.first, c.n)
                if symbols and (size + len(c.buf) > PART_BYTES or symbols + n > HELD):
                    part, size, symbols = part + 1, 0, 0
                size, symbols, seq = size + len(c.buf), symbols + n, seq + 1
                texts = pa.Array.from_buffers(pa.large_binary(), c.n, [None, pa.py_buffer(c.off), pa.py_buffer(c.buf)])
                sealed = pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), texts], names=["doc_id", "held_out", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, sealed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(sealed)
                train = c.n - rows.column("held_out").true_count
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([n]), pa.array([train]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["part", "seq", "symbols", "train", "texts"])

    docs = written(base.mapInArrow(freed(run), "part long, seq long, symbols long, train long, texts binary"), "texts")
    symbols, texts = docs.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("symbols", "train"))).first()
    buckets = 1 + symbols // BUCKET
    parts = docs.select("part", "seq", "texts").groupBy("part")

    def ask(table: pa.Table) -> pa.Table:
        p = Part(table, phrase)
        out = _request(p, buckets, *p.short())
        trim()
        return out

    def ask_longer(table: pa.Table, told: pa.Table) -> pa.Table:
        p = Part(table, phrase)
        distinct, n = _distinct(p.short()[0]), _told(told, 1) >> 1
        at = p.longer(n[_places(distinct, p.grams[1])])
        out = _request(p, buckets, p.grams[2][at], p.trained()[at])
        trim()
        return out

    def ask_contexts(table: pa.Table, told: pa.Table) -> pa.Table:
        out = _contexts(Part(table, phrase), told, buckets, texts, total)
        trim()
        return out

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        out = _scores(Part(table, phrase), told, texts, total, known, kinds, words, distinct)
        trim()
        return out

    short = written(_totals(parts.applyInArrow(ask, _REQUEST), 1), "answers", passing=True)
    sums = short.where("part < 0").groupBy("part").agg(*(F.sum(c) for c in ("total", "distinct", "known", "known_kinds"))).collect()
    of = {-1 - x[0]: tuple(x[1:]) for x in sums}
    total, distinct, known, kinds = of.get(0, (0, 0, 0, 0))
    words = total
    if phrase > 1:
        words, distinct = (x + y for x, y in zip(of.get(_WORD, (0, 0)), (texts, int(texts > 0))))
    names = [x.split()[0] for x in _ANSWER.split(", ")]
    told = short.where("part >= 0").select(names)
    long = written(_totals(parts.cogroup(told.groupBy("part")).applyInArrow(ask_longer, _REQUEST), 2), "answers", passing=True)
    told = told.union(long.where("part >= 0").select(names))
    contexts = parts.cogroup(told.groupBy("part")).applyInArrow(ask_contexts, _CONTEXTS)
    told = told.union(written(_states(contexts, divergence, EVIDENCE), "states", passing=True))
    out = T.StructType([*base.schema.fields[:2]])
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double"), ("gain", "double")):
        out = out.add(name, kind)
    return parts.cogroup(told.groupBy("part")).applyInArrow(score, out)
