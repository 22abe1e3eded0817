"""Tokens of a column of texts."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batch
from ..functions import text as T

#: Most bytes of texts that go to a Python worker at once; their trigrams are many times as large.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Limits the session's Arrow batches, so that the tokens of a batch fit in a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(name, BATCH_BYTES)


def tokenized(df: DataFrame, text: str = "text", parts: Sequence[str] = ("words", "grams")) -> DataFrame:
    """Adds ``words`` and ``grams`` (those asked for), arrays in order with repeats, to every row.

    The words of plain texts are found by column expressions, those of others by
    Arrow functions, trigrams by an Arrow function over bytes; each row takes
    one way, and nothing is shuffled.  A null text has none.
    Ask only for what is used: trigrams are many times the words.
    """
    clash = set(parts) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    small_batches(df)
    col = T.text_of(F.col(f"`{text}`"))
    native = {"words": T.plain_words(col), "grams": T.plain_grams(col)}
    python = {"words": T.python_words(col), "grams": T.python_grams(col)}
    plain = T.is_plain(col)
    return df.where(plain).withColumns({p: native[p] for p in parts}).unionByName(df.where(~plain).withColumns({p: python[p] for p in parts}))


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``: the words, then the trigrams."""
    return tokenized(df, text).withColumn("tokens", F.concat("words", "grams")).drop("words", "grams")


def normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``normalized``: NFKC, then lower case by character."""
    col = T.text_of(F.col(f"`{text}`"))
    plain = T.is_plain(col)
    return df.where(plain).withColumn("normalized", F.lower(col)).unionByName(df.where(~plain).withColumn("normalized", T.python_normalize(col)))


def each(df: DataFrame, array: Column, name: str, *keep: Column | str) -> DataFrame:
    """``keep`` and an element of ``array`` as ``name``, a row for each that isn't null.

    A plain explode has the optimizer add a filter on the array's size, which
    computes the array, here all the tokenizing, a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def gram_totals(df: DataFrame, text: str = "text") -> DataFrame:
    """(g, n): each different trigram, as a number, and how often it stands in all texts; a task sends its own sums."""
    small_batches(df)

    def run(batches):
        totals = batch.GramTotals()
        for b in batches:
            for _, texts in batch.chunks(b.column(0)):
                totals.add(texts)
        code, n = totals.all()
        for i in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(code[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["g", "n"])

    return df.select(T.text_of(F.col(f"`{text}`")).alias("text")).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
