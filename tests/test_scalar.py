"""Text functions on strings: fixed expectations."""

import math

import pytest

from lexloom.functions import scalar as S
from lexloom.functions.constants import GRAM_MARK, default_weights
from lexloom.functions.segment import ModelFile, Segmenter, char_class, default_segmenter, encode_model, features, fnv1a
from lexloom.operators import training as M


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("メモリ機能", ["メモリ", "機能"]),
        ("ＡＢＣ", ["abc"]),
        ("feat-memory-p1", ["feat", "memory", "p1", "feat", "memory", "p1"]),
        ("getMemoryQuery", ["getmemoryquery", "get", "memory", "query", "get", "memory", "query"]),
        ("0.13.0", ["0.13.0", "0", "13", "0", "0", "13", "0"]),
        ("atomic_write", ["atomic_write", "atomic", "write", "atomic", "write"]),
        ("HTTPServer", ["httpserver"]),
        ("don't", ["don", "t"]),
        ("", []),
        ("   ", []),
        (None, []),
        ("トークナイザー", ["トークナイザー"]),
        ("안녕하세요", ["안녕", "녕하", "하세", "세요"]),
        ("猫です", ["猫", "です"]),
        ("実施した結果", ["実施", "した", "結果"]),
        ("昨日は雨が降りました", "昨日 は 雨 が 降りました".split()),
        ("これはバグだろ！", "これ は バグ だろ".split()),
        ("無理だろw", ["無理", "だろ", "w"]),
        ("幸いです", ["幸いです"]),
        ("ア・イ", ["ア", "・", "イ"]),
    ],
)
def test_words(text, want):
    assert S.words(text) == want


@pytest.mark.parametrize("word", "人々 島々 日々 時々 我々 佐々木 子供たち 学生たち 私たち".split())
def test_kept_whole(word):
    assert S.words(word) == [word]


@pytest.mark.parametrize(("text", "inside"), [("街の人々が集まった", "人々"), ("山々が連なる", "山々"), ("隅々まで掃除した", "隅々"), ("これは記事です", "です"), ("便利です", "です")])
def test_holds_word(text, inside):
    found = S.words(text)
    assert inside in found and "々" not in found and "す" not in found


def test_tokens_and_grams():
    assert S.tokens("abc") == ["abc", GRAM_MARK + "abc"]
    assert S.char_grams("a　 b") == [GRAM_MARK + "a b"]
    assert S.char_grams("ab") == []
    assert S.normalize("ΣΑΣ") == "σασ"
    assert [t for t in S.tokens_ngrams("hello world foo bar", 3) if " " in t and not t.startswith(GRAM_MARK)] == ["hello world", "world foo", "foo bar", "hello world foo", "world foo bar"]


def weights(text, **options):
    return {t.token: t.weight for t in S.weighted_tokens(text, **options)}


def test_weights():
    w = weights("atomic_write は重要")
    assert [w[t] for t in ("atomic_write", "atomic", "write", "重要", "は")] == [2.0, 2.0, 2.0, 1.0, 0.0]
    grams = [t.weight for t in S.weighted_tokens("atomic_write は重要") if t.token.startswith(GRAM_MARK)]
    assert grams == [0.5] * 12 + [0.0] * 2
    assert weights("atomic_write は重要", compat=False)[GRAM_MARK + "は重要"] == 0.25
    for text, word, want in [("メモリが不足する", "メモリ", 2.0), ("ファイルを書く", "ファイル", 1.8), ("sshで接続する", "ssh", 1.5), ("サーバーに送る", "サーバー", 1.5), ("「メモリ」は重要", "メモリ", 2.0), ("(ファイル)を書く", "ファイル", 1.8), ("メモリの設定は重要", "設定", 2.0), ("メモリの設定は重要", "メモリ", 1.0), ("atomic_write。は重要", "atomic_write", 1.0), ("atomic_write\nは重要", "atomic_write", 1.0)]:
        assert weights(text)[word] == want
    assert not any(weights("これは").values())
    assert [t.token for t in S.weighted_tokens("Some text, メモリ機能")] == S.tokens("Some text, メモリ機能")


def test_small_functions():
    assert [S.estimate_tokens(t) for t in ("hello world!", "メモリ機能です", "atomic_writeを必ず使う", "😀😀😀😀", "", None)] == [3, 4, 6, 1, 0, 0]
    assert S.content_hash("") == "cbf29ce484222325" and S.content_hash("hello world") == "5fc23bef9ab05c69" == S.content_hash("Hello   World")
    assert S.fnv1a_hex(b"a") == "af63dc4c8601ec8c"
    assert S.jaccard("hello world", "hello world") == S.jaccard("", None) == 1.0 and S.jaccard("hello", "") == 0.0
    assert math.isclose(S.jaccard("hello world", "hello there"), 5 / 17)


def test_stopwords():
    assert all(map(S.is_stopword, "の に は を が です ます ました ない す や した して よる など とか ぜひ かも なく だろ だろう でし は가 나の た가".split()))
    assert not any(map(S.is_stopword, "メモリ 機能 はし にわ かに すし いす たこ のり よこ ゆり やま 少なく 無く なっ たい んだ すㇰ は豈 the".split()))


def test_sentiment():
    for text, want in [("This is great and amazing work", "positive"), ("This is terrible and horrible", "negative"), ("good but also bad", "neutral"), ("素晴らしい機能で便利です", "positive"), ("バグが多くて不安定です", "negative"), ("", "neutral")]:
        assert S.sentiment(text)[0] == want
    assert round(S.sentiment("This is great!")[1], 6) == 0.666667 and S.sentiment("")[1] == 0.0 and S.sentiment("table")[1] == 0.5


def test_classes_and_features():
    assert "".join(map(char_class, "三猫がメ。aA5★々・")) == "MHIKPAANOHP"
    f = features("猫が好き", 1)
    assert len(f) == 42 and {"UW2:猫", "UW3:が", "UW4:好", "UW6:E"} <= set(f)
    assert {"UC3:H", "UC4:I", "BC2:HI"} <= set(features("猫が好き", 0))


def test_model_file():
    weights = default_weights()
    data = encode_model(0.0, weights, 42)
    assert len(weights) == 171 and len(data) == 24 + 12 * 171
    model = ModelFile(data)
    assert len(model) == 171 and model.data_hash == 42 and all(model.lookup(k) == v for k, v in weights.items()) and model.lookup("none") == 0.0
    assert model.segmenter(list(weights)).words("昨日は雨が降りました") == default_segmenter().words("昨日は雨が降りました")
    for bad in (data[:10], b"XXXX" + data[4:], data[:4] + b"\2\0" + data[6:], data[:-1]):
        with pytest.raises(ValueError):
            ModelFile(bad)
    assert fnv1a(b"") == 0xCBF29CE484222325 and Segmenter({}).split("猫です") == ["猫です"]


def test_training_helpers():
    assert M.gold_words("# no") is None and M.gold_words(" ") is None and M.gold_words("猫  です") == ["猫", "です"]
    assert M.japanese_runs(["猫", "a", "犬", "と", "。"]) == [["猫"], ["犬", "と"]]
    assert M.boundary_offsets(["猫", "です", "か"]) == [1, 3] and M.common_count(list("のの花"), list("の花花")) == 2
    assert M.from_counts(0, 0, 0) == (1.0, 1.0, 1.0)
    samples = M.line_samples("猫 です")
    assert [s["label"] for s in samples] == [1.0, -1.0]
    model = M.train_local([["a", "b"], ["b"], ["c"]], __import__("numpy").array([1.0, -1.0, -1.0]), 1)
    assert list(model.weights) == ["a"] and model.predict(["a"]) and not model.predict(["c"])
