"""Steps that count within a task give what the string functions give, and what they shuffle doesn't grow with the tokens."""

import contextlib
import io
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexloom.functions import batch, scalar
from lexloom.operators import keywords as K
from lexloom.operators import similarity as S
from lexloom.operators.corpus import Corpus

from .test_operators import TEXTS, rows

MORE = [*TEXTS, "aBc a-b a_b x.y 1.2 a. .b -c d- iPhone", "a b c a b d a c", "\U00020000\U00020001\U00020002 abc", "mixed メモリ getMemory v1.2-x"]


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_batches_equal_strings():
    for most in (1, 40, 1 << 20):
        for at, texts in batch.chunks(pa.array(MORE), most):
            assert texts == [t or "" for t in MORE[at : at + len(texts)]]
            assert batch.word_lists(texts) == [scalar.words(t) for t in texts]
            asked = sorted({x for t in ("words only abc メモリ機能", *texts) for x in scalar.tokens(t)})[::2]
            text, term, tf, total, distinct = batch.Terms(asked).found(texts, different=True)
            for i, t in enumerate(texts):
                count = Counter(scalar.tokens(t))
                assert (total[i], distinct[i]) == (count.total(), len(count))
                assert {asked[k]: n for j, k, n in zip(text, term, tf) if j == i} == {k: n for k, n in count.items() if k in set(asked)}


def test_edges_are_counted_in_the_task(spark, monkeypatch):
    """no row for each pair of places is shuffled; rows that share an id are still summed."""
    texts = ["red green blue red green lamp", "red green", "", None, "lamp blue", "red green lamp"]
    ids = [1, 2, 3, 4, None, None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = Counter()
    for i, t in zip(ids, texts):
        w = scalar.words(t)
        for at in range(len(w) - min(3, len(w)) + 1):
            v = w[at : at + min(3, len(w))]
            want.update((i, x, y) for j, x in enumerate(v) for k, y in enumerate(v) if j != k and x != y)
    found = lambda: {(r.doc_id, r.a, r.b): r.w for r in K.cooccurrence_edges(df, 3).collect()}
    assert found() == want
    monkeypatch.setattr(K, "SHARED_IDS", 0)
    assert found() == want
    assert "Exchange" not in plan(K.cooccurrence_edges(df.where("doc_id < 4"), 3))


def test_bm25_makes_no_lists_of_tokens(spark):
    """terms are counted from the texts; ties go to the lesser id over batches and tasks."""
    corpus = Corpus.build(rows(spark, MORE))
    asked = ["abc", "memory", "words", "\u0001wor", "\u0001メモリ", "nowhere"]
    by_tokens = Corpus(corpus.base).bm25_tokens(asked)
    from_texts = corpus.bm25_tokens(asked)
    assert "regexp_extract_all" in plan(by_tokens) and "regexp_extract_all" not in plan(from_texts) and "plain_grams" not in plan(from_texts)
    key = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert key(from_texts) == key(by_tokens)
    many = Corpus.build(rows(spark, ["same words here"] * 50 + MORE).repartition(7))
    q = spark.createDataFrame([("a", "words here"), (None, "memory abc"), ("c", "")], "query_id string, text string")
    best = many.bm25_batch_top(q, 3, digits=6)
    assert "plain_grams" not in plan(best)
    assert sorted(r.doc_id for r in best.collect() if r.query_id == "a") == [0, 1, 2]
    for query, text in (("a", "words here"), (None, "memory abc")):
        want = sorted(((-round(r.score, 6), r.doc_id) for r in many.bm25(text).collect() if r.score > 0))[:3]
        assert sorted((-r.score, r.doc_id) for r in best.collect() if r.query_id == query) == want


def test_jaccard_counts_in_the_task(spark, monkeypatch):
    """no row for each token is shuffled; by joins the same."""
    asked = spark.createDataFrame(list(enumerate(["words only", "", "メモリ abc", None])), "query_id long, text string")
    one = lambda: S.jaccard_against(rows(spark, MORE).repartition(3), asked)
    key = lambda df: sorted((r.query_id, r.doc_id, r.score) for r in df.collect())
    got = one()
    assert "Aggregate" not in plan(got) and "Join" not in plan(got)
    assert key(S.jaccard_against(rows(spark, MORE), asked.limit(0))) == []
    monkeypatch.setattr(S, "ASKED_TERMS", 1)
    assert key(got) == key(one())


def test_content_hash_without_lists(spark):
    """the joined tokens stay in the worker."""
    df = S.content_hashes(rows(spark, MORE).repartition(3))
    assert "regexp_extract_all" not in plan(df) and "array_join" not in plan(df)
    assert {r.doc_id: r.content_hash for r in df.collect()} == {i: scalar.content_hash(t) for i, t in enumerate(MORE)}


def test_trigrams_are_counted_as_numbers(spark, monkeypatch, tmp_path):
    """no list of trigrams leaves the worker; none at all count as 0."""
    from lexloom import queries

    monkeypatch.setattr(batch, "TABLE", 100_000)
    count = Counter(g for t in MORE for g in scalar.char_grams(t))
    for name, df, want in (("some", rows(spark, MORE).repartition(3), (count.total(), len(count))), ("none", rows(spark, [None, "ab"]), (0, 0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.trigram_vocabulary(spark, f"{tmp_path}/{name}")
        assert tuple(got.first()) == want and "plain_grams" not in plan(got)


def test_keywords_are_counted_in_the_task(spark):
    """no row for each text and word is shuffled."""
    df = rows(spark, [*MORE, "red green red", "green lamp"]).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("l"), F.col("doc_id") % 3))).repartition(3)
    totals = K._term_totals(df, "text", ["lang"])
    got = {(r.lang, r.keyword): (r.c, r.d) for r in totals.groupBy("lang", "keyword").agg(F.sum("count").alias("c"), F.sum("df").alias("d")).collect()}
    want, docs = Counter(), Counter()
    for r in df.collect():
        words = [(r.lang, w) for w in scalar.words(r.text) if not scalar.is_stopword(w)]
        want.update(words)
        docs.update(set(words))
    assert got == {k: (want[k], docs[k]) for k in want}
    assert "monotonically" not in plan(K.tfidf_keywords(df, 5, by="lang"))


def test_textrank_reads_texts_in_the_task(spark):
    """F8: words are found where they are ranked."""
    df = K.textrank_keywords(rows(spark, MORE).repartition(3), 4, 1000)
    assert "regexp_extract_all" not in plan(df)
    want = {(i, k): (s, n) for i, t in enumerate(MORE) for k, s, n in K.rank_words([w for w in scalar.words(t) if not scalar.is_stopword(w)], 4)}
    assert {(r.doc_id, r.keyword): (r.score, r["count"]) for r in df.collect()} == want
