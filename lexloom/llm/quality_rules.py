"""Quality rules from the share of characters inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import GRAM, SPACED, Chunk, char_table, chunks, gram_hashes, inside_one, mix, span_hashes, sums
from .store import freed, small_batches

#: Most characters (as a share of those in words) that may stand inside n-grams of so many words that occurred before in the text.
GRAM_LIMITS = {3: 0.5, 4: 0.4, 5: 0.15, 6: 0.15, 7: 0.15, 8: 0.15, 9: 0.15, 10: 0.15}
#: The same for lines equal to an earlier one, and symbols per word.
LINE_LIMIT, SYMBOL_LIMIT = 0.2, 0.1
BASE_GRAM = 5

_SYMBOL = ~char_table(b"#*$%&|<>")
_NEWLINE = char_table(b"\n")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal in their document, and which have one before them."""
    some, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) < 2:
        return some, later
    key = mix(h ^ mix(doc.astype(np.uint64)))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    at = np.sort(order[same[1:] | same[:-1]])
    if len(at):
        # few items are left: an exact comparison of document and hash, in order of place
        order = np.lexsort((at, h[at], doc[at]))
        at = at[order]
        same = (h[at][1:] == h[at][:-1]) & (doc[at][1:] == doc[at][:-1])
        later[at[1:]] = same
        some[at[1:]] = same
        some[at[:-1]] |= same
    return some, later


def _covered(window: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` items lie in a marked window of ``n``."""
    step = np.zeros(total + 1, np.int32)
    step[: len(window)] += window
    step[n : n + len(window)] -= window
    return np.cumsum(step[:-1]) > 0


def measure(chunk: Chunk, grams: Sequence[int]) -> dict[str, np.ndarray]:
    """Counts per document of a chunk, ``gram_chars_n`` for each length included."""
    w = chunk.words(SPACED)
    doc, total = w.doc, len(w.starts)
    lead = np.concatenate([[0], np.cumsum(_LEAD[chunk.buf])])
    chars = lead[w.ends] - lead[w.starts]
    out = {"n_words": w.counts.astype(np.int64), "word_chars": sums(chars, w.first), "n_symbols": sums(_SYMBOL[chunk.buf].astype(np.int64), chunk.off)}

    lines = chunk.words(_NEWLINE)
    has = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    ldoc, a, b = lines.doc[has], lines.starts[has], lines.ends[has]
    _, again = _repeated(ldoc, span_hashes(chunk.buf, a, b))
    out["n_dup_lines"] = np.bincount(ldoc[again], minlength=chunk.n).astype(np.int64)
    word_lead = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_lead[np.searchsorted(w.starts, b)] - word_lead[np.searchsorted(w.starts, a)]
    out["dup_line_chars"] = np.bincount(ldoc[again], weights=line_chars[again], minlength=chunk.n).astype(np.int64)

    # a window repeats only if both windows inside it of one word less do
    h, before, length = w.hashes(), None, 0
    for n in sorted({*grams, BASE_GRAM}):
        ok = inside_one(w.first, total, n)
        if before is not None:
            for k in range(n - length + 1):
                ok &= before[k : k + len(ok)]
        at = np.flatnonzero(ok)
        some, later = np.zeros(len(ok), bool), np.zeros(len(ok), bool)
        some[at], later[at] = _repeated(doc[at], _grams_at(h, at, n))
        before, length = some, n
        if n == BASE_GRAM:
            out["n_repeat_words"] = sums(_covered(some, n, total).astype(np.int64), w.first)
        out[f"gram_chars_{n}"] = sums(np.where(_covered(later, n, total), chars, 0), w.first)
    return out


def _grams_at(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    if 4 * len(at) > len(h):
        return gram_hashes(h, n)[at]
    x = np.zeros(len(at), np.uint64)
    for k in range(n):
        x = x * GRAM + h[at + k]
    return mix(x)


def _judge(m: Mapping[str, np.ndarray], grams: Mapping[int, float], line_limit: float, symbol_limit: float) -> tuple[np.ndarray, np.ndarray]:
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    bad = base_failed | (m["dup_line_chars"] > line_limit * m["word_chars"]) | (m["n_symbols"] > symbol_limit * m["n_words"])
    for n, limit in grams.items():
        bad |= m[f"gram_chars_{n}"] > limit * m["word_chars"]
    return base_failed, ~bad


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    gram_limits: Mapping[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
    symbol_limit: float = SYMBOL_LIMIT,
) -> DataFrame:
    """Measures of repetition of every whole text and a verdict.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and per rule the share of word characters
    that it measures (``line_share``, ``gram_share_n``).  A text is kept if it
    passes the base rule and every limit.  A null or empty text has all counts
    0, shares 0 and fails; a null id is passed on.  Rows are judged one by one,
    in one pass without a shuffle; repeated rows and other columns don't matter,
    an empty table gives no rows.
    """
    grams = dict(GRAM_LIMITS if gram_limits is None else gram_limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = {"line_share": "dup_line_chars"} | {f"gram_share_{n}": f"gram_chars_{n}" for n in grams}
    small_batches(df.sparkSession)
    base = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([base.schema["doc_id"]])
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean")
    for c in shares:
        schema = schema.add(c, "double")

    def run(batches):
        for b in batches:
            for c in chunks(b.column("text")):
                m = measure(c, list(grams))
                base_failed, kept = _judge(m, grams, line_limit, symbol_limit)
                share = [m[v] / np.maximum(m["word_chars"], 1) for v in shares.values()]
                cols = [b.column("doc_id").slice(c.first, c.n), *(pa.array(m[x]) for x in counts), pa.array(base_failed), pa.array(kept), *map(pa.array, share)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(freed(run), schema)
