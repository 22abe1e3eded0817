"""The text functions as Spark columns.

Texts of characters that NFKC leaves alone, all of scripts with spaces (checked
by a pattern), stay in the JVM; the rest goes through Arrow.  A CASE doesn't
keep Python functions from running, so :mod:`lexloom.operators.tokens` splits
rows by :func:`is_plain` instead.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from . import scalar

# types as objects: a worker that imports this module has no session to parse names with
_STRINGS = T.ArrayType(T.StringType())
_WEIGHTED = T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("weight", T.DoubleType())]))

#: Latin letters, ASCII and dashes and quotes: unchanged by NFKC, lower-cased alike everywhere.
_PLAIN = r"^[\x00-\x7FÀ-įıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰ–—‘’“”¡§«°¶·»¿€]*$"
_ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Something that splits or joins words beyond runs of letters and digits.
_IDENTIFIER = rf"_|[{_ALNUM}]-|-[{_ALNUM}]|\.[{_ALNUM}]|\p{{IsLowercase}}\p{{IsUppercase}}"
_DENSE = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in C.DENSE_RANGES) + "]"
_JAPANESE = r"[々぀-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]"


def text_of(col: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(col.cast("string"), F.lit(""))


def is_plain(text: Column) -> Column:
    return text.rlike(_PLAIN)


def _parts(word: Column) -> Column:
    humps = F.regexp_replace(word, r"(\p{IsLowercase})(?=\p{IsUppercase})", "$1\u0003")
    parts = F.filter(F.split(humps, "[_.\\-\u0003]+"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.transform(parts, F.lower)).otherwise(F.array().cast("array<string>"))


def _run_words(run: Column) -> Column:
    tied = F.regexp_replace(run, r"(?<=\p{IsAlphabetic})\.(?=\p{IsAlphabetic})|(?<=\p{Nd})\.(?=\p{Nd})", "\u0002")
    found = F.filter(F.regexp_extract_all(tied, F.lit(rf"[{_ALNUM}_" + "\u0002]+"), F.lit(0)), lambda w: w.rlike(rf"[{_ALNUM}]"))
    plain = F.transform(found, lambda w: F.replace(w, F.lit("\u0002"), F.lit(".")))
    return F.concat(F.flatten(F.transform(plain, lambda w: F.concat(F.array(F.lower(w)), _parts(w)))), _parts(run))


def plain_words(text: Column) -> Column:
    """Word tokens of a plain text."""
    runs = F.regexp_extract_all(text, F.lit(rf"[{_ALNUM}_.\-]+"), F.lit(0))
    simple = F.regexp_extract_all(F.lower(text), F.lit(rf"[{_ALNUM}]+"), F.lit(0))
    return F.when(text.rlike(_IDENTIFIER), F.flatten(F.transform(runs, _run_words))).otherwise(simple)


def gram_lists(texts: list[str]) -> pa.Array:
    """The marked character trigrams of each text, built as Arrow buffers: a few passes over all characters, no string by string."""
    size = np.array([len(t) for t in texts], np.int64)
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    last = np.cumsum(size)
    begins = np.ones(len(code), bool)
    for k in (1, 2):
        begins[(last - k)[size >= k]] = False
    at = np.flatnonzero(begins)
    long = place[np.minimum(at + 3, len(code))] - place[at] + 1 if len(at) else at
    to = np.concatenate([[0], np.cumsum(long)])
    out = np.empty(int(to[-1]), np.uint8)
    if len(at):
        out[to[:-1]] = ord(C.GRAM_MARK)
        for k in range(1, int(long.max())):
            some = slice(None) if k < 4 else long > k
            out[to[:-1][some] + k] = data[place[at][some] + k - 1]
    cut = np.concatenate([[0], np.cumsum(np.maximum(size - 2, 0))])
    strings = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(to), pa.py_buffer(out)])
    if len(out) < 1 << 31:
        strings = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(out)])
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), strings)


_SPACES = re.compile("[\\t\\n\\x0b\\f\\r ]+")


@F.arrow_udf(_STRINGS)
def plain_grams(text: pa.Array) -> pa.Array:
    """Marked character trigrams of plain texts."""
    return gram_lists([_SPACES.sub(" ", t.lower()).strip(" ") for t in text.to_pylist()])


@F.pandas_udf(_STRINGS)
def python_words(text: pd.Series) -> pd.Series:
    return text.map(scalar.words)


@F.arrow_udf(_STRINGS)
def python_grams(text: pa.Array) -> pa.Array:
    return gram_lists([scalar.squash(scalar.normalize(t)) for t in text.to_pylist()])


@F.pandas_udf(T.StringType())
def python_normalize(text: pd.Series) -> pd.Series:
    return text.map(scalar.normalize)


@F.pandas_udf(_WEIGHTED)
def weighted_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"token": w.token, "weight": w.weight} for w in scalar.weighted_tokens(t)])


def is_gram(token: Column) -> Column:
    return F.startswith(token, F.lit(C.GRAM_MARK))


def is_stopword(token: Column) -> Column:
    short = (F.length(token) == 2) & ~token.rlike(f"^{_JAPANESE}{{2}}$") & token.rlike(f"[{C.FUNCTION_CHARS}]")
    return token.isin(*sorted(C.STOPWORDS)) | short


def drop_stopwords(words: Column) -> Column:
    return F.filter(words, lambda w: ~is_stopword(w))


def word_ngrams(words: Column, n: int) -> Column:
    """Windows of 2 to ``n`` words, joined by spaces."""
    none = F.array().cast("array<string>")
    out = [none]
    for k in range(2, n + 1):
        parts = [F.slice(words, i + 1, F.greatest(F.size(words) - k + 1, F.lit(0))) for i in range(k)]
        joined = parts[0]
        for p in parts[1:]:
            joined = F.zip_with(joined, p, lambda a, b: F.concat_ws(" ", a, b))
        out.append(F.when(F.size(words) >= k, joined).otherwise(none))
    return F.concat(*out)


def estimate_tokens(text: Column) -> Column:
    dense = F.regexp_count(text, F.lit(_DENSE)).cast("long")
    return F.floor((F.length(text) - dense) / 4).cast("long") + F.floor(dense * 2 / 3).cast("long")


def _fnv(values: pd.Series) -> pd.Series:
    """FNV-1a of many byte strings side by side: a step takes one byte of each that is still going."""
    data = [v or b"" for v in values]
    order = sorted(range(len(data)), key=lambda i: -len(data[i]))
    sizes = np.array([len(data[i]) for i in order])
    h = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    prime, block = np.uint64(0x100000001B3), 4096
    for at in range(0, int(sizes.max(initial=0)), block):
        k = int((sizes > at).sum())
        if k < 8:
            for j in range(k):
                x = int(h[j])
                for b in data[order[j]][at:]:
                    x = (x ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
                h[j] = x
            break
        grid = np.zeros((k, block), np.uint8)
        for j in range(k):
            part = data[order[j]][at : at + block]
            grid[j, : len(part)] = np.frombuffer(part, np.uint8)
        for t, col in enumerate(np.ascontiguousarray(grid.T).astype(np.uint64)):
            m = int(np.searchsorted(-sizes, -(at + t), side="left"))
            if not m:
                break
            h[:m] = (h[:m] ^ col[:m]) * prime
    out = [""] * len(data)
    for j, i in enumerate(order):
        out[i] = f"{int(h[j]):016x}"
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def fnv1a_hex(data: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, of bytes as 16 hexadecimal digits."""
    return _fnv(data)


def content_hash(tokens: Column) -> Column:
    """The hash of a text's tokens."""
    return fnv1a_hex(F.encode(F.array_join(tokens, " "), "UTF-8"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens as sets; of two empty ones 1."""
    return jaccard_of_sets(F.array_distinct(a), F.array_distinct(b))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """The same of arrays without repeats."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def _longest(token: Column, en: frozenset[str], ja: frozenset[str]) -> Column:
    by: dict[int, list[str]] = {}
    for w in sorted(ja):
        by.setdefault(len(w.encode()), []).append(w)
    case = F.lit(0)
    for size, words in sorted(by.items()):
        hit = token.rlike("|".join(words)) | F.contains(F.lit("\n".join(words)), token)
        case = F.when(hit, F.lit(size)).otherwise(case)
    english = F.when(token.isin(*sorted(en)), F.octet_length(token)).otherwise(F.lit(0))
    latin = token.rlike("^[\\x00-\\x7FÀ-ɏ]+$")
    return F.greatest(english, F.when(latin, F.lit(0)).otherwise(case))


def sentiment(words: Column) -> Column:
    """struct(polarity, confidence, positive_count, negative_count) of word tokens."""
    signs = F.transform(words, lambda w: F.signum((_longest(w, C.POSITIVE_EN, C.POSITIVE_JA) - _longest(w, C.NEGATIVE_EN, C.NEGATIVE_JA)).cast("double")))
    plus, minus = F.size(F.filter(signs, lambda s: s > 0)), F.size(F.filter(signs, lambda s: s < 0))
    n, both = F.size(words), plus + minus
    name = F.when(plus > minus, "positive").when(minus > plus, "negative").otherwise("neutral")
    sure = F.least(F.lit(1.0), 0.5 + 0.5 * F.abs(plus - minus) / both * F.least(F.lit(1.0), both / n))
    conf = F.when(n == 0, 0.0).when(both == 0, 0.5).otherwise(sure)
    return F.struct(name.alias("polarity"), conf.alias("confidence"), plus.cast("long").alias("positive_count"), minus.cast("long").alias("negative_count"))


def register(spark: SparkSession) -> None:
    """The scalar functions for SQL: ``lex_normalize``, ``lex_tokens``, ``lex_jaccard`` and so on."""
    strings, kinds = {"lex_normalize": scalar.normalize, "lex_content_hash": scalar.content_hash}, {"lex_words": scalar.words, "lex_char_grams": scalar.char_grams, "lex_tokens": scalar.tokens}
    for name, f in strings.items():
        spark.udf.register(name, F.pandas_udf(_mapped(f), "string"))
    for name, f in kinds.items():
        spark.udf.register(name, F.pandas_udf(_mapped(f), "array<string>"))
    spark.udf.register("lex_estimate_tokens", F.pandas_udf(_mapped(scalar.estimate_tokens), "long"))
    spark.udf.register("lex_is_stopword", F.pandas_udf(_mapped(scalar.is_stopword), "boolean"))
    spark.udf.register("lex_is_gram", F.pandas_udf(_mapped(lambda t: t.startswith(C.GRAM_MARK)), "boolean"))
    spark.udf.register("lex_fnv1a", F.pandas_udf(_fnv_text, "string"))
    spark.udf.register("lex_jaccard", F.pandas_udf(_pair_jaccard, "double"))
    spark.udf.register("lex_sentiment", F.pandas_udf(_sentiment_rows, "polarity string, confidence double, positive_count long, negative_count long"))
    spark.udf.register("lex_weighted_tokens", weighted_tokens)


def _mapped(f):
    def run(col: pd.Series) -> pd.Series:
        return col.map(f)

    return run


def _fnv_text(col: pd.Series) -> pd.Series:
    return _fnv(col.map(lambda t: (t or "").encode()))


def _pair_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([scalar.jaccard(x, y) for x, y in zip(a, b)])


def _sentiment_rows(col: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scalar.sentiment(t) for t in col], columns=["polarity", "confidence", "positive_count", "negative_count"])
