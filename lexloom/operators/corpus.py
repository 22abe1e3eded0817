"""A corpus as tables of tokens, postings and document lengths, and BM25 over it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batch, scalar
from ..functions import text as T
from .tokens import each, small_batches, tokenized

K1, B = 1.2, 0.75
#: Terms of a query up to which they are a literal list and their frequencies are gathered on the driver.
LITERAL_TERMS = 20_000

_QUERY = "term string, weight double"


def kept(weight: Column) -> Column:
    """Weights that count: above 0 and finite."""
    return (weight > 0) & (weight < float("inf")) & ~F.isnan(weight)


class Corpus:
    """Documents with their tokens, of weight 1 or weighted.

    ``base`` has doc_id and tokens, an array of strings or, if weighted, of
    (token, weight).  Nothing is computed until a result is asked for; cache
    ``base`` to reuse it, or save the postings.  ``texts``, if given, has
    (doc_id, text) of the same rows; queries of known terms then count them
    straight from the texts, without lists of all tokens.
    """

    def __init__(self, base: DataFrame, weighted: bool = False, texts: DataFrame | None = None):
        self.base, self.weighted, self.texts = base, weighted, texts

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "doc_id", text: str = "text") -> Corpus:
        texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        return cls(tokenized(texts).select("doc_id", "words", F.concat("words", "grams").alias("tokens")), texts=texts)

    @classmethod
    def build_weighted(cls, df: DataFrame, id_col: str = "doc_id", text: str = "text") -> Corpus:
        """Weights from particles; see :func:`lexloom.functions.scalar.weighted_tokens`."""
        return cls.build_weighted_tokens(df.select(F.col(f"`{id_col}`").alias("doc_id"), T.weighted_tokens(T.text_of(F.col(f"`{text}`"))).alias("tokens")))

    @classmethod
    def build_weighted_tokens(cls, df: DataFrame, id_col: str = "doc_id", tokens: str = "tokens") -> Corpus:
        """From arrays of (token, weight); weights that are not above 0 or not finite are left out.

        The frequency of a term is the sum of its weights, the length of a
        document the number of tokens that are left.
        """
        left = F.filter(F.coalesce(F.col(f"`{tokens}`"), F.array()), lambda t: kept(t["weight"]))
        return cls(df.select(F.col(f"`{id_col}`").alias("doc_id"), left.alias("tokens")), weighted=True)

    def docs(self) -> DataFrame:
        """(doc_id, dl)."""
        return self.base.select("doc_id", F.size("tokens").cast("double").alias("dl"))

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(doc_id, term, tf, dl); of ``terms`` only, if given, which other tokens are dropped for before the shuffle."""
        name = (lambda t: t["token"]) if self.weighted else (lambda t: t)
        tokens = F.col("tokens") if terms is None else F.filter("tokens", lambda t: name(t).isin(*terms) if terms else F.lit(False))
        rows = each(self.base, tokens, "t", "doc_id", F.size("tokens").cast("double").alias("dl"))
        return self._counted(rows)

    def document_frequency(self) -> DataFrame:
        """(term, df)."""
        names = F.array_distinct(F.transform("tokens", lambda t: t["token"]) if self.weighted else F.col("tokens"))
        return each(self.base, names, "term").groupBy("term").agg(F.count("*").alias("df"))

    def stats(self) -> DataFrame:
        """One row (n, avgdl)."""
        return self.docs().agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.count("*"), F.lit(0.0)).alias("avgdl"))

    def size(self) -> int:
        return self.base.count()

    def is_empty(self) -> bool:
        return not self.base.limit(1).count()

    def save(self, path: str) -> None:
        """Writes the postings (in files by hash of the term) and the document lengths."""
        self.postings().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64))).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings")
        self.docs().write.parquet(f"{path}/docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Saved:
        """The corpus that :meth:`save` wrote."""
        return Saved(spark.read.parquet(f"{path}/postings").drop("part"), spark.read.parquet(f"{path}/docs"))

    # -- BM25

    def bm25(self, query: str) -> DataFrame:
        """(doc_id, score) of every document, 0 without a match, for the distinct tokens of a text."""
        return self.bm25_tokens(scalar.tokens(query))

    def bm25_tokens(self, terms: Iterable[str]) -> DataFrame:
        return self.bm25_weighted_tokens((t, 1.0) for t in terms)

    def bm25_weighted(self, query: str) -> DataFrame:
        """With the query's tokens weighted by their particles."""
        return self.bm25_weighted_tokens((t.token, t.weight) for t in scalar.weighted_tokens(query))

    def bm25_weighted_tokens(self, query: Iterable[tuple[str, float]]) -> DataFrame:
        """Each term counts once, with the greatest of its weights; others than finite ones above 0 are left out."""
        best: dict[str, float] = {}
        for term, weight in query:
            if 0 < weight < float("inf"):
                best[term] = max(best.get(term, 0.0), float(weight))
        if len(best) > LITERAL_TERMS:
            query_rows = self.base.sparkSession.createDataFrame(sorted(best.items()), _QUERY)
            return self._scored(self.postings(), query_rows, self.docs())
        if self.texts is not None:
            return self._text_scores(best)
        name = (lambda t: t["token"]) if self.weighted else (lambda t: t)
        hits = F.filter("tokens", lambda t: name(t).isin(*sorted(best)) if best else F.lit(False))
        rows = self.base.select("doc_id", F.size("tokens").cast("double").alias("dl"), hits.alias("hits"))
        n, avgdl, df = _gathered(rows, name)
        idf = {t: float(np.log((n - d + 0.5) / (d + 0.5) + 1.0)) * best[t] for t, d in df.items()}
        score = _scorer(idf, avgdl, self.weighted)
        return rows.select("doc_id", score(F.col("hits"), F.col("dl")).alias("score"))

    def _text_scores(self, best: dict[str, float]) -> DataFrame:
        names = sorted(best)
        terms = batch.Terms(names)
        n, avgdl, df = _text_stats(self.texts, terms)
        worth = np.log((n - df + 0.5) / (df + 0.5) + 1.0) * np.array([best[t] for t in names], float)
        kind = self.texts.schema["doc_id"].dataType.simpleString()

        def run(batches):
            for b in batches:
                score = np.zeros(b.num_rows)
                for at, texts in batch.chunks(b.column("text")):
                    text, term, tf, total, _ = terms.found(texts)
                    part = worth[term] * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * total[text] / (avgdl or 1.0)))
                    score[at : at + len(texts)] = np.bincount(text, weights=part, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

        return self.texts.mapInArrow(run, f"doc_id {kind}, score double")

    def _counted(self, rows: DataFrame) -> DataFrame:
        tf = F.sum("t.weight") if self.weighted else F.count("*").cast("double")
        return rows.groupBy("doc_id", "dl", (F.col("t.token") if self.weighted else F.col("t")).alias("term")).agg(tf.alias("tf")).select("doc_id", "term", "tf", "dl")

    def _scored(self, postings: DataFrame, query: DataFrame, docs: DataFrame) -> DataFrame:
        found = postings.join(query, "term")
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        per = found.join(df, "term").withColumn("part", bm25_part(F.col("tf"), F.col("df"), F.col("dl"), self._n(), self._avgdl()) * F.col("weight"))
        scores = per.groupBy("doc_id").agg(F.sum("part").alias("score"))
        return docs.select("doc_id").join(scores, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def bm25_batch(self, queries: DataFrame, id_col: str = "query_id", text: str = "text") -> DataFrame:
        """(query_id, doc_id, score) of documents that hold a term of a query, for a table of queries."""
        rows = tokenized(queries.select(F.col(f"`{id_col}`").alias("query_id"), F.col(f"`{text}`").alias("text")))
        terms = each(rows, F.array_distinct(F.concat("words", "grams")), "term", "query_id")
        postings = self.postings()
        df = postings.groupBy("term").agg(F.count("*").alias("df"))
        part = bm25_part(F.col("tf"), F.col("df"), F.col("dl"), self._n(), self._avgdl())
        weighed = postings.join(df, "term").select("doc_id", "term", part.alias("part"))
        return weighed.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))

    def bm25_batch_top(self, queries: DataFrame, k: int, id_col: str = "query_id", text: str = "text", digits: int | None = None) -> DataFrame:
        """The ``k`` documents of the highest score for each query, ties to the lesser doc_id; scores rounded to ``digits`` before they are compared.

        Queries of up to LITERAL_TERMS different terms are broadcast: documents
        are scored where they are, against all queries at once, and only the
        best of each batch are shuffled.  More go by :meth:`bm25_batch`.
        """
        asked = tokenized(queries.select(F.col(f"`{id_col}`").alias("query_id"), F.col(f"`{text}`").alias("text")))
        terms = each(asked, F.array_distinct(F.concat("words", "grams")), "term", "query_id").distinct()
        vocabulary = [r["term"] for r in terms.select("term").distinct().limit(LITERAL_TERMS + 1).collect()]
        if len(vocabulary) > LITERAL_TERMS or self.texts is None:
            scores = self.bm25_batch(queries, id_col, text)
            return top(scores if digits is None else scores.withColumn("score", F.round("score", digits)), k, by="query_id")
        vocabulary.sort()
        wanted = batch.Terms(vocabulary)
        n, avgdl, df = _text_stats(self.texts, wanted)
        pairs = terms.toArrow()
        ids = pairs.column("query_id").combine_chunks().unique()
        number = {t: i for i, t in enumerate(vocabulary)}
        query = np.asarray(pairs.column("query_id").combine_chunks().dictionary_encode("encode").indices).astype(np.int64)
        term = np.array([number[t] for t in pairs.column("term").to_pylist()], np.int64)
        order = np.argsort(term, kind="stable")
        query, first = query[order], np.searchsorted(term[order], np.arange(len(number) + 1))
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1.0)
        n_queries = len(ids)
        n_terms, dense = wanted.n, wanted.n * n_queries <= 1 << 22
        shared = self.base.sparkSession.sparkContext.broadcast((wanted, query, first, idf))
        kind = self.texts.schema["doc_id"].dataType.simpleString()
        names = ["q", "doc_id", "score"]

        def first_ones(found: pa.Table) -> pa.Table:
            order = pc.sort_indices(found, sort_keys=[("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start")
            q = np.asarray(found.column("q"))[order]
            return found.take(order.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) < k))))

        def run(batches):
            wanted, query, first, idf = shared.value
            if dense:
                asks = np.zeros((n_terms, n_queries))
                asks[np.repeat(np.arange(n_terms), np.diff(first)), query] = 1.0
            found, waiting = [], 0
            for b in batches:
                for at, texts in batch.chunks(b.column("text")):
                    text, term, tf, total, _ = wanted.found(texts)
                    part = idf[term] * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * total[text] / (avgdl or 1.0)))
                    # a few texts at a time, so that a row for each of their queries fits
                    for lo in range(0, len(texts), step := max(1, (1 << 20) // max(n_queries, n_terms, 1))):
                        some, rows = slice(*np.searchsorted(text, (lo, lo + step))), min(step, len(texts) - lo)
                        if dense:
                            parts = np.zeros((rows, n_terms))
                            parts[text[some] - lo, term[some]] = part[some]
                            score = parts @ asks
                        else:
                            t, size = term[some], first[term[some] + 1] - first[term[some]]
                            place = np.repeat(first[t], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                            score = np.bincount(np.repeat(text[some] - lo, size) * n_queries + query[place], weights=np.repeat(part[some], size), minlength=rows * n_queries).reshape(rows, n_queries)
                        has = score > 0  # every part is
                        score = score if digits is None else np.round(score, digits)
                        least = np.partition(np.where(has, score, -np.inf), rows - max(k, 1), axis=0)[rows - max(k, 1)] if rows > k else np.full(n_queries, -np.inf)
                        row, q = np.nonzero(has & (score >= least))
                        found.append(pa.table([pa.array(q), b.column("doc_id").take(pa.array(at + lo + row)), pa.array(score[row, q])], names=names))
                        waiting += len(q)
                        if waiting > 1 << 18:
                            found = [first_ones(pa.concat_tables(found))]
                            waiting = 0
            if found:
                yield from first_ones(pa.concat_tables(found)).to_batches(1 << 16)

        found = self.texts.mapInArrow(run, f"q long, doc_id {kind}, score double")
        named = self.base.sparkSession.createDataFrame(pa.table({"q": pa.array(np.arange(n_queries)), "query_id": ids}))
        return top(found, k, by="q").join(F.broadcast(named), "q").select("query_id", "doc_id", "score")

    def _n(self) -> Column:
        return self.stats().select("n").scalar()

    def _avgdl(self) -> Column:
        return self.stats().select("avgdl").scalar()


def _text_stats(texts: DataFrame, terms: batch.Terms) -> tuple[int, float, np.ndarray]:
    """The number of texts, their mean length in tokens, and in how many of them each term stands; a task sends its own sums."""
    small_batches(texts)

    def run(batches):
        df, n, length = np.zeros(terms.n, np.int64), 0, 0
        for b in batches:
            for _, some in batch.chunks(b.column("text")):
                _, term, _, total, _ = terms.found(some)
                df += np.bincount(term, minlength=terms.n)
                n, length = n + len(some), length + int(total.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[n], df[at]])), pa.array(np.concatenate([[length], 0 * at]))], names=["term", "n", "length"])

    df, n, length = np.zeros(terms.n, np.int64), 0, 0
    for r in texts.select("text").mapInArrow(run, "term long, n long, length long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect():
        if r["term"] < 0:
            n, length = r["n"], r["length"]
        else:
            df[r["term"]] = r["n"]
    return n, length / max(n, 1), df


def _gathered(rows: DataFrame, name) -> tuple[int, float, dict[str, int]]:
    """The number of documents, their mean length, and in how many each term of ``hits`` stands; one pass, pre-aggregated."""
    terms = F.array_distinct(F.transform("hits", name))
    each_one = F.explode(F.concat(F.array(F.lit(None).cast("string")), terms))
    per = rows.select("dl", each_one.alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).collect()
    total = next(((r["n"], r["dl"]) for r in per if r["term"] is None), (0, 0.0))
    return total[0], total[1] / max(total[0], 1), {r["term"]: r["n"] for r in per if r["term"] is not None}


def _term_counts(hits: pa.Array, weighted: bool = False) -> tuple[np.ndarray, tuple[list[str], np.ndarray], np.ndarray]:
    """Row, term (names and numbers) and frequency of the different terms of each row."""
    count = np.asarray(hits.value_lengths()).astype(np.int64)
    flat = hits.flatten()
    tokens, weight = (flat.field(0), np.asarray(flat.field(1))) if weighted else (flat, None)
    codes = tokens.dictionary_encode()
    names = codes.dictionary.to_pylist()
    key, back = np.unique(np.repeat(np.arange(len(count)), count) * max(len(names), 1) + np.asarray(codes.indices).astype(np.int64), return_inverse=True)
    tf = np.bincount(back, weights=weight, minlength=len(key)).astype(float)
    return key // max(len(names), 1), (names, key % max(len(names), 1)), tf


def _scorer(idf: dict[str, float], avgdl: float, weighted: bool):
    """BM25 of a row's hits, of a document of length dl; a row is scored by itself, so nothing is shuffled."""

    @F.arrow_udf("double")
    def score(hits: pa.Array, dl: pa.Array) -> pa.Array:
        at, (names, term), tf = _term_counts(hits, weighted)
        worth = np.array([idf[t] for t in names] or [0.0])[term] if len(at) else tf
        length = np.asarray(dl)[at]
        part = worth * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * length / (avgdl or 1.0)))
        return pa.array(np.bincount(at, weights=part, minlength=len(hits)).astype(float))

    return score


def bm25_part(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """A term's share of a document's score."""
    idf = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
    return idf * (tf * (K1 + 1.0)) / (tf + K1 * (1.0 - B + B * dl / avgdl))


def top(scores: DataFrame, k: int, score: str = "score", tie: str = "doc_id", by: str | None = None) -> DataFrame:
    """The k highest scores, ties to the lesser ``tie``; with ``by`` in each of its groups."""
    if by is None:
        return scores.orderBy(F.desc(score), F.asc(tie)).limit(k)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie)))
    return scores.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


class Saved(Corpus):
    """A corpus read back from its postings, so that no text is tokenized again."""

    def __init__(self, postings: DataFrame, docs: DataFrame):
        self.rows, self.lengths, self.weighted = postings, docs, False

    def docs(self) -> DataFrame:
        return self.lengths

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        return self.rows if terms is None else self.rows.where(F.col("term").isin(*terms) if terms else F.lit(False))

    def document_frequency(self) -> DataFrame:
        return self.rows.groupBy("term").agg(F.count("*").alias("df"))

    def size(self) -> int:
        return self.lengths.count()

    def is_empty(self) -> bool:
        return not self.lengths.limit(1).count()

    def bm25_weighted_tokens(self, query: Iterable[tuple[str, float]]) -> DataFrame:
        best: dict[str, float] = {}
        for term, weight in query:
            if 0 < weight < float("inf"):
                best[term] = max(best.get(term, 0.0), float(weight))
        rows = self.rows.sparkSession.createDataFrame(sorted(best.items()), _QUERY)
        few = len(best) <= LITERAL_TERMS
        return self._scored(self.postings(sorted(best)) if few else self.rows, F.broadcast(rows) if few else rows, self.lengths)


class Scorer(Protocol):
    """What ranks documents for a query; an embedding scorer would fit as well."""

    def scores(self, query: str) -> DataFrame: ...


class LexicalScorer:
    """BM25 as a scorer."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    @classmethod
    def of(cls, df: DataFrame) -> LexicalScorer:
        return cls(Corpus.build(df))

    def scores(self, query: str) -> DataFrame:
        return self.corpus.bm25(query)
