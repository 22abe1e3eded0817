"""Structured Streaming over texts: the row-wise functions as they are, and duplicates dropped by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import content_hashes, sentiments
from ..operators.tokens import with_tokens


def tokens_of(stream: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens`` to each row of a stream; no state."""
    return with_tokens(stream, text)


def sentiment_of(stream: DataFrame, text: str = "text") -> DataFrame:
    return sentiments(stream, text)


def drop_repeats(stream: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Rows whose text, but for case and white space, came before within ``delay`` are dropped; state older than the watermark is, too."""
    return content_hashes(stream, text).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def sentiment_counts(stream: DataFrame, time: str, window: str = "10 minutes", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """(start, polarity, n) in tumbling windows."""
    rows = sentiments(stream, text).withWatermark(time, delay)
    return rows.groupBy(F.window(time, window), "polarity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "polarity", "n")
