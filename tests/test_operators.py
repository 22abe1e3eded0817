"""Table operators against the string functions and fixed expectations."""

import io
import json
import math
import sys

import pytest
from pyspark.sql import functions as F

from lexloom import __main__ as cli
from lexloom.functions import scalar
from lexloom.functions import text as T
from lexloom.functions.segment import fnv1a
from lexloom.operators import keywords as K
from lexloom.operators import similarity as S
from lexloom.operators import training as M
from lexloom.operators.corpus import Corpus, LexicalScorer, top
from lexloom.operators.tokens import normalized, tokenized
from lexloom.plans.requests import RequestError, run
from lexloom.sources.texts import expand_paths, gold, read_lines, read_texts
from lexloom.streaming.texts import drop_repeats, sentiment_counts

TEXTS = [
    "feat-memory-p1", "getMemoryQuery v0.13.0 a.b.c x.1 1.x _a_ --- a_b-c.d HTTPServer dontDo’It don't", "", "  ", None, "Straße Éa-Éb ÉcoleÉcole", "メモリ機能 abc は重要", "e.g. U.S.A. 3.14.15 a._b a-.b",
    "ΣΑΣ", "\u0085x y z", "a–b c·d", "This is great and terrible", "안녕하세요", "plain words only here", "ﬁne ① ½", "à decomposed", "İstanbul", "word " * 3000,
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_columns_equal_strings(spark):
    df = tokenized(rows(spark, TEXTS))
    cols = {"est": T.estimate_tokens(T.text_of(F.col("text"))), "hash": T.content_hash(F.concat("words", "grams")), "s": T.sentiment(F.col("words")), "ng": T.word_ngrams(F.col("words"), 3), "content": T.drop_stopwords(F.col("words"))}
    got = df.withColumns(cols).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        w = scalar.words(r.text)
        assert (r.words, r.grams, r.est, r.hash) == (w, scalar.char_grams(r.text), scalar.estimate_tokens(r.text), scalar.content_hash(r.text))
        assert tuple(r.s) == scalar.sentiment(r.text) and w + r.grams + r.ng == scalar.tokens_ngrams(r.text, 3) and r.content == [x for x in w if not scalar.is_stopword(x)]
    assert {r.doc_id: r.normalized for r in normalized(rows(spark, TEXTS)).collect()} == {i: scalar.normalize(t) for i, t in enumerate(TEXTS)}
    assert tokenized(rows(spark, TEXTS).limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokenized(df)


def scores(df):
    return [r.score for r in df.orderBy("doc_id").collect()]


def test_bm25(spark):
    c = Corpus.build(rows(spark, ["atomic write", "cat mat"]))
    assert [round(s, 6) for s in scores(c.bm25("atomic"))] == [3.128893, 0.0]
    assert scores(c.bm25("zzzz")) == scores(c.bm25("")) == [0.0, 0.0]
    assert c.size() == 2 and not c.is_empty() and c.stats().first().n == 2
    assert scores(c.bm25_tokens(["atomic", "atomic"])) == scores(c.bm25_tokens(["atomic"]))
    empty = Corpus.build(rows(spark, []))
    assert empty.is_empty() and scores(empty.bm25("a")) == [] and scores(Corpus.build(rows(spark, ["", None])).bm25("a")) == [0.0, 0.0]
    assert [r.doc_id for r in top(c.bm25("cat"), 1).collect()] == [1]
    assert scores(LexicalScorer.of(rows(spark, ["atomic write", "cat mat"])).scores("atomic")) == scores(c.bm25("atomic"))
    q = spark.createDataFrame([(7, "atomic"), (8, "nothing")], "query_id int, text string")
    assert [(r.query_id, r.doc_id, round(r.score, 6)) for r in c.bm25_batch(q).collect()] == [(7, 0, 3.128893)]


def test_weighted_bm25(spark):
    c = Corpus.build(rows(spark, ["alpha content", "delta content"]))
    a, d = scores(c.bm25_weighted("alphaは delta"))
    assert math.isclose(a / d, 2.0)
    a, d = scores(c.bm25_weighted_tokens([("alpha", 1.0), ("alpha", 2.0), ("delta", 1.0)]))
    assert math.isclose(a / d, 2.0)
    assert scores(c.bm25_weighted_tokens([("alpha", float("nan")), ("delta", float("inf")), ("content", -1.0)])) == [0.0, 0.0]
    tokens = spark.createDataFrame([(0, [("x", 2.0), ("x", 1.0), ("y", 0.0), ("z", float("nan"))]), (1, [("y", 1.0)]), (2, None)], "doc_id long, tokens array<struct<token:string,weight:double>>")
    w = Corpus.build_weighted_tokens(tokens)
    assert {tuple(r) for r in w.postings().collect()} == {(0, "x", 3.0, 2.0), (1, "y", 1.0, 1.0)}
    notes = ["メモリ管理は重要です", "猫が好きです", "atomic_write は安全に保存する"]
    by = Corpus.build_weighted(rows(spark, notes))
    for query, want in [("メモリは", 0), ("猫", 1), ("atomic_write", 2)]:
        assert top(by.bm25_weighted(query), 1).first().doc_id == want
    assert scores(by.bm25_weighted("はがを")) == [0.0] * 3


def test_keywords(spark):
    got = K.tfidf_keywords(rows(spark, ["rust systems", "rust safety", "python data"]), 10).collect()
    assert [(r.keyword, round(r.score, 6), r["count"]) for r in got] == [("data", 0.231049, 1), ("python", 0.231049, 1), ("rust", 0.231049, 2), ("safety", 0.231049, 1), ("systems", 0.231049, 1)]
    assert K.tfidf_keywords(rows(spark, []), 5).collect() == [] == K.tfidf_keywords(rows(spark, ["", None]), 5).collect()
    diff = K.corpus_diff(rows(spark, ["rust systems"]), rows(spark, ["python data"])).collect()
    assert {(r.side, r.keyword, round(r.ratio, 6)) for r in diff} == {("a", "rust", 2.5), ("a", "systems", 2.5), ("b", "python", 2.5), ("b", "data", 2.5)}
    same = rows(spark, ["rust systems"])
    assert K.corpus_diff(same, same).collect() == [] == K.corpus_diff(rows(spark, []), rows(spark, [])).collect()
    docs = rows(spark, ["memory leak found in memory pool", "short", "pool"])
    assert [(r.keyword, r["count"]) for r in K.cooccurrence_keywords(docs, "leak", 3, 10).orderBy("keyword").collect()] == [("found", 2), ("in", 1), ("memory", 1)]
    assert K.cooccurrence_keywords(docs, "は", 3).collect() == [] == K.cooccurrence_keywords(docs, "leak", 0).collect()


def test_textrank(spark):
    texts = ["a b c a b d a", "one", "", None, "x x x", "p q"]
    got = K.textrank_keywords(rows(spark, texts), 3, 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, {})[r.keyword] = (r.score, r["count"])
    assert set(by) == {0, 1, 4, 5} and by[0]["a"][1] == 3 and max(by[0], key=lambda k: by[0][k]) == "a"
    assert math.isclose(sum(s for s, _ in by[0].values()), 1, abs_tol=1e-4) and math.isclose(by[1]["one"][0], 0.15)
    edges = {(r.a, r.b): r.w for r in K.cooccurrence_edges(rows(spark, texts[:1]), 3).collect()}
    words, want = texts[0].split(), {}
    for i in range(len(words) - 2):
        for x in range(i, i + 3):
            for y in range(i, i + 3):
                if x != y and words[x] != words[y]:
                    want[words[x], words[y]] = want.get((words[x], words[y]), 0) + 1
    assert edges == want
    large = {r.keyword: r.score for r in K.textrank_large(rows(spark, texts[:1]), 3, 10).collect()}
    assert all(math.isclose(large[k], by[0][k][0], abs_tol=1e-5) for k in large)


def test_textrank_query_settles(spark, tmp_path):
    from lexloom import queries

    names = ["river", "stone", "bridge", "forest", "valley", "meadow", "harbor", "castle", "garden", "window", "ladder", "bottle", "candle", "mirror", "pencil", "saddle"]
    text = " ".join(w for i in range(0, 16, 4) for w in names[i : i + 5] * (i + 1))
    for table in ("documents", "benchmark"):
        spark.createDataFrame([(0, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/{table}.parquet")
    want = {k: s for k, s, _ in K.rank_words(text.split(), 4)}
    got = {r.keyword: r.score for r in queries.textrank_large(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want)


def test_similarity(spark):
    pairs = spark.createDataFrame([(0, "hello world", "hello world"), (1, "", None), (2, "hello", ""), (3, "hello world", "hello there")], "n int, a string, b string")
    assert [round(r.score, 6) for r in S.jaccard_pairs(pairs).orderBy("n").collect()] == [1.0, 1.0, 0.0, 0.294118]
    base = "the quick brown fox jumps over the lazy dog near the river bank every single morning"
    texts = [base, base + " again", base.upper(), "something else entirely different", "", None, base.replace("quick", "slow")]
    got = {(r.a, r.b): r for r in S.near_duplicates(rows(spark, texts)).collect()}
    want = {(a, b) for a in (0, 1, 3, 6) for b in (0, 1, 3, 6) if a < b and scalar.jaccard(texts[a], texts[b]) >= 0.72}
    assert set(got) == want and want and all(math.isclose(r.score, scalar.jaccard(texts[a], texts[b])) for (a, b), r in got.items())
    assert got[0, 1].copies_a == 2
    assert {(r.doc_id, r.copies) for r in S.dedup_by_hash(rows(spark, texts)).collect()} == {(0, 2), (1, 1), (3, 1), (4, 2), (6, 1)}


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("SELECT lex_tokens('abc') t, lex_jaccard('hello world', 'hello there') j, lex_content_hash('') h, lex_sentiment('great')['polarity'] s, lex_is_stopword('です') w, lex_estimate_tokens('hello world!') e, lex_fnv1a('a') f").first()
    assert (row.t, round(row.j, 6), row.h, row.s, row.w, row.e, row.f) == (["abc", "\u0001abc"], 0.294118, "cbf29ce484222325", "positive", True, 3, "af63dc4c8601ec8c")


LINES = ["# c", "", "これ は 新しい 記事 です 。", "昨日 は 雨 が 降りました", "学生 たち が 本 を 読む"]


def test_training(spark, monkeypatch, tmp_path):
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")
    samples = M.training_samples(lines).persist()
    assert samples.count() == sum(len(M.line_samples(s)) for s in LINES)
    model = M.train(samples, 4)
    monkeypatch.setattr(M, "LOCAL_PAIRS", 0)
    spread = M.train(samples, 4)
    assert list(spread.weights) == list(model.weights) and all(math.isclose(spread.weights[k], v, rel_tol=1e-9) for k, v in model.weights.items())
    metrics = M.evaluate(model, samples).first()
    assert metrics.accuracy > 0.8 and 0 <= metrics.precision <= 1
    model.save_json(f"{tmp_path}/m.json")
    assert M.Model.load_json(f"{tmp_path}/m.json").weights == model.weights
    with pytest.raises(ValueError):
        M.train(samples.limit(0), 1)
    assert tuple(M.evaluate(model, samples.limit(0)).first()) == (0.0, 0.0, 0.0)
    from lexloom.functions.segment import default_segmenter

    report = M.evaluate_lines(lines, default_segmenter()).first()
    assert report.runs == 3 and 0.5 < report.boundary_f1 <= 1
    assert M.evaluate_lines(lines.limit(0), default_segmenter()).first().boundary_f1 == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("猫 です\n# no\n\n犬 と", encoding="utf-8")
    (tmp_path / "a.txt").write_text("雨 が", encoding="utf-8")
    (tmp_path / "x.md").write_text("no")
    assert [p[-5:] for p in expand_paths([str(tmp_path)])] == ["a.txt", "b.txt"]
    assert [r.words for r in gold(read_lines(spark, [str(tmp_path)])).orderBy("line_no").collect()] == [["雨", "が"], ["猫", "です"], ["犬", "と"]]
    with pytest.raises(FileNotFoundError):
        expand_paths([f"{tmp_path}/none"])
    rows(spark, ["a", None]).write.json(f"{tmp_path}/j.json")
    assert read_texts(spark, f"{tmp_path}/j.json", fmt="json").count() == 2
    assert read_texts(spark, f"{tmp_path}/a.txt").first().text == "雨 が"


def test_requests(spark, monkeypatch, capsys):
    ask = lambda c, **p: run(spark, c, p)
    assert ask("tokenize", texts=["abc", 5]) == {"tokens": [["abc", "\u0001abc"], []]}
    assert "a b" in ask("tokenize", texts=["a b"], ngram=2)["tokens"][0]
    assert ask("jaccard", a="hello world", b="hello there") == {"score": 0.294118}
    assert ask("jaccard", pairs=[{"a": "", "b": ""}, {"a": "x"}]) == {"scores": [1.0, 0.0]}
    assert ask("bm25", corpus=["atomic write", "cat mat"], query="atomic") == {"scores": [3.128893, 0.0]}
    assert ask("bm25", corpus=["atomic write", None], query="", weighted=True) == {"scores": [0.0, 0.0]}
    assert ask("hash", texts=["", "hello world"]) == {"hashes": ["cbf29ce484222325", "5fc23bef9ab05c69"]}
    assert len(ask("keywords", texts=["rust systems", "rust safety"], top_n=2)["keywords"]) == 2
    assert ask("keywords", texts=["a b a", "b"], method="textrank")["keywords"][0]["count"] == 2
    assert ask("diff", corpus_a=["rust systems"], corpus_b=["python data"])["a_distinctive"][0] == {"keyword": "rust", "ratio": 2.5}
    assert [(r["text_index"], r["polarity"], r["confidence"]) for r in ask("sentiment", texts=["This is great!"])["results"]] == [(0, "positive", 0.666667)]
    for command, payload in [("tokenize", {}), ("tokenize", {"texts": ["a"], "ngram": 4}), ("jaccard", {"a": "x"}), ("bm25", {"corpus": []}), ("bm25", {"corpus": [], "query": "a", "weighted": 1}), ("keywords", {"texts": [], "method": "x"}), ("keywords", {"texts": [], "method": "cooccurrence"}), ("nope", {})]:
        with pytest.raises(RequestError):
            run(spark, command, payload)
    assert cli.main([]) == 2 == cli.main(["nope"])
    monkeypatch.setattr(sys, "stdin", io.StringIO("{"))
    assert cli.main(["hash"]) == 1 and "error" in json.loads(capsys.readouterr().out)


def test_streaming(spark, tmp_path):
    df = spark.createDataFrame([("Hello World", "2024-01-01 00:00:00"), ("hello   world", "2024-01-01 00:01:00"), ("great", "2024-01-01 00:02:00")], "text string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out, mode in (("repeats", drop_repeats(stream, "at"), "append"), ("moods", sentiment_counts(stream, "at"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("repeats").count() == 2
    assert {(r.polarity, r.n) for r in spark.table("moods").collect()} == {("neutral", 2), ("positive", 1)}


def test_entry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and {"bm25_topk", "near_duplicates_072"} <= names


def test_samples_of_many_files(spark, tmp_path):
    """Ids of samples stay different and in order over more files than fit in a few bits of a number."""
    for i in range(12):
        (tmp_path / f"{i:02}.txt").write_text("昨日 は 雨 が 降りました\n" * (1 + i % 3), encoding="utf-8")
    samples = M.training_samples(read_lines(spark, [str(tmp_path)])).collect()
    assert len({r.sample_id for r in samples}) == len(samples) == sum(1 + i % 3 for i in range(12)) * len(M.line_samples("昨日 は 雨 が 降りました"))
    files = [r.sample_id.n.file for r in sorted(samples, key=lambda r: r.sample_id)]
    assert files == sorted(files) and set(files) == set(range(12))


def test_batch_of_queries(spark, monkeypatch, tmp_path):
    """The best of each query, ties by id, by broadcast and by joins; and from a saved corpus."""
    texts = [t for t in TEXTS if t] + ["write the words here"] * 3 + [f"word number {i} of many" for i in range(40)]
    corpus = Corpus.build(rows(spark, texts))
    asked = spark.createDataFrame([("a", "plain words"), ("b", "number many"), ("c", "zqx"), ("d", ""), ("e", "メモリ 記事")], "query_id string, text string")
    want = [tuple(r) for r in top(corpus.bm25_batch(asked).withColumn("score", F.round("score", 6)), 3, by="query_id").select("query_id", "doc_id", "score").collect()]
    got = [tuple(r) for r in corpus.bm25_batch_top(asked, 3, digits=6).collect()]
    assert sorted(got) == sorted(want) and {q for q, *_ in got} >= {"a", "b"}
    monkeypatch.setattr("lexloom.operators.corpus.LITERAL_TERMS", 1)
    assert sorted(tuple(r) for r in corpus.bm25_batch_top(asked, 3, digits=6).select("query_id", "doc_id", "score").collect()) == sorted(want)
    monkeypatch.undo()
    assert corpus.bm25_batch_top(asked.limit(0), 3).collect() == [] and Corpus.build(rows(spark, [])).bm25_batch_top(asked, 3).collect() == []
    corpus.save(f"{tmp_path}/c")
    saved = Corpus.load(spark, f"{tmp_path}/c")
    assert saved.size() == corpus.size() and not saved.is_empty()
    assert [round(s, 9) for s in scores(saved.bm25("plain words"))] == [round(s, 9) for s in scores(corpus.bm25("plain words"))]


def test_jaccard_against(spark):
    texts, asked = ["hello world", "hello there", "", None, "zzz"], ["hello world", ""]
    got = {(r.query_id, r.doc_id): r.score for r in S.jaccard_against(rows(spark, texts), rows(spark, asked).withColumnRenamed("doc_id", "query_id")).collect()}
    want = {(q, d): scalar.jaccard(a, b) for q, a in enumerate(asked) for d, b in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v > 0}


def test_hashes_of_documents(spark):
    df = rows(spark, [*TEXTS, "é" * 9000]).select("doc_id", "text", T.fnv1a_hex(F.encode(T.text_of(F.col("text")), "UTF-8")).alias("fnv"))
    assert all(int(r.fnv, 16) == fnv1a((r.text or "").encode()) for r in df.collect())
