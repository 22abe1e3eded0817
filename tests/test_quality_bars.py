"""Bars of quality over generated texts: near duplicates are found, topics kept apart, planted texts ranked first."""

import random

from pyspark.sql import functions as F

from lexloom.operators import similarity as S
from lexloom.operators.corpus import Corpus, top

TOPICS = [
    ["the build_cache folder is rebuilt from scratch every night", "every night the build_cache folder is rebuilt", "rebuild the build_cache folder from scratch each night"],
    ["never store a password in plain text inside the config file", "the config file must not hold a password in plain text", "keep passwords in plain text out of the config file"],
    ["each invoice needs a due_date that lies after its issue_date", "an invoice has a due_date later than the issue_date", "set due_date after issue_date on each invoice"],
    ["バックアップは毎晩サーバーに保存される", "毎晩サーバーへバックアップを保存する", "サーバーに保存するバックアップは毎晩作る"],
    ["設定ファイルに暗証番号を書かない", "暗証番号は設定ファイルへ書き込まない", "設定ファイルには暗証番号を残さない"],
    ["古いログは圧縮してから削除する", "ログが古い場合は圧縮後に削除", "削除の前に古いログを圧縮しておく"],
]
RNG = random.Random(20)


def noisy(s, dot=True):
    """More spaces, capitals at the beginnings of words, perhaps a full stop."""
    words = [w.capitalize() if w[0].isascii() and w[0].isalpha() and w.islower() and "_" not in w and RNG.random() < 0.3 else w for w in s.split(" ")]
    return "".join(w + " " * RNG.choice([1, 1, 1, 2]) for w in words).strip() + ("." if dot and RNG.random() < 0.3 else "")


def scores(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.score for r in S.jaccard_pairs(df).orderBy("i").collect()]


def test_near_duplicates_are_found(spark):
    got = scores(spark, [(noisy(v), noisy(v)) for t in TOPICS for v in t for _ in range(200)])
    assert len(got) == 3600 and sum(s >= S.NEAR for s in got) / len(got) >= 0.99


def test_topics_are_kept_apart(spark):
    pick = lambda t: noisy(RNG.choice(t))
    two = [RNG.sample(TOPICS, 2) for _ in range(4000)]
    got = scores(spark, [(pick(a), pick(b)) for a, b in two])
    assert sum(s >= S.NEAR for s in got) / len(got) <= 0.01
    same, other = [], []
    for a, b in two:
        x, y = RNG.sample(a, 2)
        same.append((x, y))
        other.append((x, RNG.choice(b)))
    assert sum(s > o for s, o in zip(scores(spark, same), scores(spark, other))) / len(two) >= 0.95


def test_planted_texts_rank_first(spark):
    docs = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TOPICS)], "doc_id int, text string")
    asked = []
    for i, t in enumerate(TOPICS):
        for v in t:
            for _ in range(100):
                words = v.split() if " " in v else [v[k : k + 5] for k in range(0, len(v), 5)]
                asked.append((len(asked), i, " ".join(RNG.sample(words, max(2, len(words) // 2)))))
    queries = spark.createDataFrame(asked, "query_id int, planted int, text string")
    ranked = top(Corpus.build(docs).bm25_batch(queries), 3, by="query_id").join(queries, "query_id")
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"), F.max(F.when(F.col("doc_id") == F.col("planted"), F.col("score"))).alias("own"))
    n, first, third = best.agg(F.count("*"), F.sum((F.col("own") == F.col("best")).cast("int")), F.count("own")).first()
    assert first / len(asked) >= 0.9 and third / len(asked) >= 0.98 and n <= len(asked)


def test_hashes_stand_noise(spark):
    rows = [(v, noisy(v, dot=False)) for t in TOPICS for v in t for _ in range(50)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    a, b = ({r.i: r.content_hash for r in S.content_hashes(df, c).select("i", "content_hash").collect()} for c in "ab")
    assert a == b
