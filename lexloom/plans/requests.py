"""Requests: a command with a dictionary in, a dictionary out, computed by Spark."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keywords as K
from ..operators import similarity as S
from ..operators.corpus import Corpus
from ..operators.tokens import tokenized, with_tokens


class RequestError(ValueError):
    """A request that doesn't have what its command needs."""


def _strings(payload: dict, name: str) -> list[str]:
    value = payload.get(name)
    if not isinstance(value, list):
        raise RequestError(f'missing or invalid "{name}" array')
    return [v if isinstance(v, str) else "" for v in value]


def _number(payload: dict, name: str, default: int) -> int:
    value = payload.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= 0 else default


def _rows(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def _tokenize(spark: SparkSession, payload: dict) -> dict:
    texts, n = _strings(payload, "texts"), _number(payload, "ngram", 1)
    if not 1 <= n <= 3:
        raise RequestError('"ngram" must be 1, 2, or 3')
    rows = tokenized(_rows(spark, texts)).select("doc_id", F.concat("words", "grams", T.word_ngrams(F.col("words"), n)).alias("t"))
    return {"tokens": [r["t"] for r in rows.orderBy("doc_id").collect()]}


def _jaccard(spark: SparkSession, payload: dict) -> dict:
    text = lambda v: v if isinstance(v, str) else ""
    if isinstance(payload.get("pairs"), list):
        pairs = [p if isinstance(p, dict) else {} for p in payload["pairs"]]
    elif "a" in payload and "b" in payload:
        pairs = [payload]
    else:
        raise RequestError('give "a" and "b", or a "pairs" array')
    df = spark.createDataFrame([(i, text(p.get("a")), text(p.get("b"))) for i, p in enumerate(pairs)], "n long, a string, b string")
    scores = [r["s"] for r in S.jaccard_pairs(df).orderBy("n").select(F.round("score", 6).alias("s")).collect()]
    return {"scores": scores} if isinstance(payload.get("pairs"), list) else {"score": scores[0]}


def _bm25(spark: SparkSession, payload: dict) -> dict:
    docs, query, weighted = _strings(payload, "corpus"), payload.get("query"), payload.get("weighted", False)
    if not isinstance(query, str):
        raise RequestError('missing or invalid "query" string')
    if not isinstance(weighted, bool):
        raise RequestError('"weighted" must be a boolean')
    rows = _rows(spark, docs)
    scores = Corpus.build_weighted(rows).bm25_weighted(query) if weighted else Corpus.build(rows).bm25(query)
    return {"scores": [r["s"] for r in scores.orderBy("doc_id").select(F.round("score", 6).alias("s")).collect()]}


def _hash(spark: SparkSession, payload: dict) -> dict:
    rows = with_tokens(_rows(spark, _strings(payload, "texts"))).select("doc_id", T.content_hash(F.col("tokens")).alias("h"))
    return {"hashes": [r["h"] for r in rows.orderBy("doc_id").collect()]}


def _keywords(spark: SparkSession, payload: dict) -> dict:
    texts, top_n, window = _strings(payload, "texts"), _number(payload, "top_n", 20), _number(payload, "window_size", 4)
    method = payload.get("method") if isinstance(payload.get("method"), str) else "tfidf"
    rows = _rows(spark, texts)
    if method == "tfidf":
        found = K.tfidf_keywords(rows, top_n)
    elif method == "textrank":
        found = K.textrank_keywords(_rows(spark, ["\n".join(texts)]), window, top_n)
    elif method == "cooccurrence":
        if not isinstance(payload.get("query"), str):
            raise RequestError('the "cooccurrence" method needs a "query" string')
        found = K.cooccurrence_keywords(rows, payload["query"], window, top_n)
    else:
        raise RequestError(f'unknown "method" {method!r}: use "tfidf", "textrank" or "cooccurrence"')
    ordered = sorted(found.collect(), key=lambda r: (-r["score"], r["keyword"]))
    return {"keywords": [{"keyword": r["keyword"], "score": round(r["score"], 6), "count": r["count"]} for r in ordered]}


def _diff(spark: SparkSession, payload: dict) -> dict:
    a, b = _strings(payload, "corpus_a"), _strings(payload, "corpus_b")
    rows = K.corpus_diff(_rows(spark, a), _rows(spark, b), _number(payload, "top_n", 20)).collect()
    side = lambda s: [{"keyword": r["keyword"], "ratio": round(r["ratio"], 6)} for r in sorted((r for r in rows if r["side"] == s), key=lambda r: (-r["ratio"], r["keyword"]))]
    return {"a_distinctive": side("a"), "b_distinctive": side("b")}


def _sentiment(spark: SparkSession, payload: dict) -> dict:
    rows = S.sentiments(_rows(spark, _strings(payload, "texts"))).orderBy("doc_id").collect()
    return {"results": [{"text_index": r["doc_id"], "polarity": r["polarity"], "confidence": round(r["confidence"], 6)} for r in rows]}


COMMANDS = {"tokenize": _tokenize, "jaccard": _jaccard, "bm25": _bm25, "hash": _hash, "keywords": _keywords, "diff": _diff, "sentiment": _sentiment}


def run(spark: SparkSession, command: str, payload: Any) -> dict:
    """The answer to a request; a RequestError for one that can't be answered."""
    if command not in COMMANDS:
        raise RequestError(f"unknown command {command!r}")
    return COMMANDS[command](spark, payload if isinstance(payload, dict) else {})
