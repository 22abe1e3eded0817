"""The library's registered queries and the SQL that DuckDB holds against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as C
from .functions import scalar
from .functions import text as T
from .functions.segment import default_segmenter
from .operators import keywords as K
from .operators import similarity as S
from .operators import training as M
from .operators.corpus import Corpus, top
from .operators.tokens import each, gram_totals, normalized, tokenized, with_tokens

#: A query's text, for the ranked retrieval queries.
ASK = "Licensed under the Apache License, Version 2.0 and the thereof"


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return _t(spark, sf_dir, "documents", "doc_id", *more, "text")


def _r(col, name: str):
    return F.round(col, 6).alias(name)


# -- SQL pieces

_LIT = lambda s: "'" + s.replace("'", "''") + "'"
_AL = r"\p{L}\p{N}"
_M = "chr(1)"


def _sql_parts(w: str) -> str:
    humps = rf"regexp_replace({w}, '(\p{{Ll}})(\p{{Lu}})', '\1' || chr(3) || '\2', 'g')"
    p = f"list_filter(string_split_regex({humps}, '[_.\\-\\x03]+'), lambda p: p <> '')"
    return f"(CASE WHEN len({p}) > 1 THEN list_transform({p}, lambda p: lower(p)) ELSE []::VARCHAR[] END)"


def _sql_words(text: str) -> str:
    """Word tokens of a text of Latin letters."""
    tied = "r"
    for cls in (r"\p{L}", r"\p{L}", r"\p{Nd}", r"\p{Nd}"):
        tied = rf"regexp_replace({tied}, '({cls})\.({cls})', '\1' || chr(2) || '\2', 'g')"
    found = rf"list_filter(regexp_extract_all({tied}, '[{_AL}_\x02]+'), lambda w: regexp_matches(w, '[{_AL}]'))"
    plain = f"list_transform({found}, lambda w: replace(w, chr(2), '.'))"
    each = f"flatten(list_transform({plain}, lambda w: list_concat([lower(w)], {_sql_parts('w')})))"
    return rf"flatten(list_transform(regexp_extract_all({text}, '[{_AL}_.\-]+'), lambda r: list_concat({each}, {_sql_parts('r')})))"


def _sql_grams(text: str) -> str:
    c = rf"string_split(trim(regexp_replace(lower({text}), '[\t\n\x0B\f\r ]+', ' ', 'g')), '')"
    return f"(SELECT CASE WHEN len(c) > 2 THEN list_transform(list_zip(c[1:len(c) - 2], c[2:len(c) - 1], c[3:]), lambda z: {_M} || z[1] || z[2] || z[3]) ELSE []::VARCHAR[] END FROM (SELECT {c} AS c))"


_STOP = "(" + ", ".join(_LIT(w) for w in sorted(C.STOPWORDS)) + ")"
_JA = "[々぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]"


def _sql_stop(w: str) -> str:
    return f"({w} IN {_STOP} OR (length({w}) = 2 AND NOT regexp_matches({w}, '^{_JA}{{2}}$') AND regexp_matches({w}, '[{C.FUNCTION_CHARS}]')))"


_W = f"w AS (SELECT doc_id, {_sql_words('coalesce(text, {q})'.format(q=_LIT('')))} AS words FROM documents)"
_WG = f"w AS (SELECT doc_id, {_sql_words('text')} AS words, {_sql_grams('text')} AS grams FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), t AS (SELECT doc_id, list_concat(words, grams) AS tokens FROM w)"
_CONTENT = f"c AS (SELECT doc_id, list_filter(words, lambda x: NOT {_sql_stop('x')}) AS words FROM w)"


def _sql_fnv(text: str) -> str:
    data = f"list_transform(range(0, (length(hex(encode({text}))) / 2)::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::INTEGER::HUGEINT)"
    step = "((xor(h, b)::HUGEINT * 1099511628211) % 18446744073709551616)"
    return f"lower(lpad(hex(list_reduce(list_concat([14695981039346656037::HUGEINT], {data}), lambda h, b: {step})::UBIGINT), 16, '0'))"


# -- queries and their SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, lower(coalesce(text, '')) AS normalized FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(_docs(spark, sf_dir)).select("doc_id", "normalized")


@query(f"WITH {_W} SELECT doc_id, len(words)::BIGINT AS n_words, array_to_string(words, ' ') AS words FROM w")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(_docs(spark, sf_dir), parts=("words",)).select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words"))


@query(f"WITH {_WG} SELECT doc_id, len(grams)::BIGINT AS n_grams, md5(array_to_string(grams, '|')) AS grams_md5 FROM w")
def char_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(_docs(spark, sf_dir), parts=("grams",)).select("doc_id", F.size("grams").cast("long").alias("n_grams"), F.md5(F.array_join("grams", "|")).alias("grams_md5"))


@query(f"WITH {_WG} SELECT count(*) AS n, count(DISTINCT g) AS n_distinct FROM (SELECT unnest(grams) AS g FROM w)")
def trigram_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_totals(_docs(spark, sf_dir)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))


def _ngram_sql(n: int) -> str:
    lists = [f"CASE WHEN len(words) >= {k} THEN list_transform(range(1, len(words) - {k - 2}), lambda i: array_to_string(words[i:i + {k - 1}], ' ')) ELSE []::VARCHAR[] END" for k in range(2, n + 1)]
    joined = lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})"
    return f"WITH {_W} SELECT doc_id, len(n)::BIGINT AS n_ngrams, md5(array_to_string(n, '|')) AS ngrams_md5 FROM (SELECT doc_id, {joined} AS n FROM w)"


def _ngrams(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    g = T.word_ngrams(F.col("words"), n)
    return tokenized(_docs(spark, sf_dir), parts=("words",)).select("doc_id", g.alias("g")).select("doc_id", F.size("g").cast("long").alias("n_ngrams"), F.md5(F.array_join("g", "|")).alias("ngrams_md5"))


@query(_ngram_sql(2))
def word_ngrams_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngrams(spark, sf_dir, 2)


@query(_ngram_sql(3))
def word_ngrams_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngrams(spark, sf_dir, 3)


@query(f"WITH {_WG} SELECT doc_id, len(tokens)::BIGINT AS n_tokens, len(list_distinct(tokens))::BIGINT AS n_distinct FROM t")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(_docs(spark, sf_dir)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.array_distinct("tokens")).cast("long").alias("n_distinct"))


_SAMPLES = ["hello world!", "メモリ機能です", "atomic_writeを必ず使う", "", "안녕하세요", "は가", "でし", "メモリ", "the", "나の", "少なく", "\u0001abc", "abc"]
_VALUES = "VALUES " + ", ".join(f"({i}, {_LIT(s)})" for i, s in enumerate(_SAMPLES))
_DENSE_SQL = "[々぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ\U00020000-\U0002a6df\U0002a700-\U0002ebef]"


def _samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_SAMPLES)), "id int, text string")


@query(f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT -1 - id, text FROM ({_VALUES}) v(id, text)),
    n AS (SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '{_DENSE_SQL}')) AS d FROM a)
    SELECT doc_id, ((n - d) // 4 + d * 2 // 3)::BIGINT AS estimate FROM n""")
def estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).unionByName(_samples(spark).select((-1 - F.col("id")).cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", T.estimate_tokens(T.text_of(F.col("text"))).alias("estimate"))


@query(f"""
    WITH {_W}, a AS (SELECT DISTINCT unnest(words) AS token FROM w UNION SELECT text FROM ({_VALUES}) v(id, text))
    SELECT token, {_sql_stop('token')} AS is_stopword, starts_with(token, chr(1)) AS is_gram FROM a""")
def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = each(tokenized(_docs(spark, sf_dir), parts=("words",)), F.col("words"), "token")
    rows = words.unionByName(_samples(spark).select(F.col("text").alias("token"))).distinct()
    return rows.select("token", T.is_stopword(F.col("token")).alias("is_stopword"), T.is_gram(F.col("token")).alias("is_gram"))


@query()
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.fnv1a_hex(F.encode(T.text_of(F.col("text")), "UTF-8")).alias("fnv"))


@query(f"SELECT item_id, {_sql_fnv('text')} AS fnv FROM benchmark")
def fnv1a_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select("item_id", T.fnv1a_hex(F.encode("text", "UTF-8")).alias("fnv"))


@query(f"""
    WITH w AS (SELECT item_id, {_sql_words('text')} AS words, {_sql_grams('text')} AS grams FROM benchmark),
    j AS (SELECT item_id, array_to_string(list_concat(words, grams), ' ') AS text FROM w)
    SELECT item_id, {_sql_fnv('text')} AS content_hash FROM j""")
def content_hash_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.content_hashes(_t(spark, sf_dir, "benchmark")).select("item_id", "content_hash")


@query()
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.content_hashes(_docs(spark, sf_dir)).select("doc_id", "content_hash")


@query(f"""
    WITH {_WG} SELECT min(doc_id) AS doc_id, count(*) AS copies FROM t GROUP BY array_to_string(tokens, ' ')""")
def dedup_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedup_by_hash(_docs(spark, sf_dir)).select("doc_id", "copies")


@query(f"""
    WITH {_WG}, s AS (SELECT doc_id, list_distinct(tokens) AS s FROM t),
    q AS (SELECT item_id, list_distinct(list_concat({_sql_words('text')}, {_sql_grams('text')})) AS s FROM benchmark),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS token FROM s), y AS (SELECT item_id, len(s) AS m, unnest(s) AS token FROM q)
    SELECT item_id AS query_id, doc_id, round(count(*)::DOUBLE / (n + m - count(*)), 6) AS score FROM x JOIN y USING (token) GROUP BY item_id, doc_id, n, m""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.jaccard_against(_docs(spark, sf_dir), _t(spark, sf_dir, "benchmark"), query_id="item_id").select("query_id", "doc_id", _r(F.col("score"), "score"))


@query("SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 1.0), (2, 0.0), (3, 0.294118), (4, 1.0)) v(pair_id, score)")
def jaccard_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "hello world", "hello world"), (1, "", ""), (2, "hello", None), (3, "hello world", "hello there"), (4, "Hello   World", "hello world")]
    return S.jaccard_pairs(spark.createDataFrame(rows, "pair_id int, a string, b string")).select("pair_id", _r(F.col("score"), "score"))


@query(f"""
    WITH {_WG}, s AS (SELECT min(doc_id) AS id, count(*) AS copies, list_sort(list_distinct(tokens)) AS s FROM t GROUP BY list_sort(list_distinct(tokens)) HAVING len(s) > 0),
    k AS (SELECT id, copies, len(s) AS n, unnest(s) AS token FROM s),
    p AS (SELECT a.id AS a, b.id AS b, a.n, b.n AS m, a.copies AS copies_a, b.copies AS copies_b, count(*) AS c FROM k a JOIN k b ON a.token = b.token AND a.id < b.id AND b.n >= 0.72 * a.n - 1e-9 AND a.n >= 0.72 * b.n - 1e-9 GROUP BY ALL)
    SELECT a, b, copies_a, copies_b, round(c::DOUBLE / (n + m - c), 6) AS score FROM p WHERE c::DOUBLE / (n + m - c) >= 0.72""")
def near_duplicates_072(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.near_duplicates(_docs(spark, sf_dir)).select("a", "b", "copies_a", "copies_b", _r(F.col("score"), "score"))


def _bm25_sql(terms: str, limit: str) -> str:
    return f"""
    WITH {_WG}, q AS (SELECT term, max(weight) AS weight FROM ({terms}) GROUP BY term),
    d AS (SELECT doc_id, len(tokens)::DOUBLE AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    x AS (SELECT p.doc_id, sum(q.weight * ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.dl / s.avgdl))) AS score
          FROM p JOIN f USING (term) JOIN q USING (term) JOIN d USING (doc_id), s GROUP BY p.doc_id)
    SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN x USING (doc_id) {limit}"""


def _sql_list(items) -> str:
    return "VALUES " + ", ".join(f"({_LIT(t)}, {w}::DOUBLE)" for t, w in items)


def _terms(items) -> str:
    return f"SELECT * FROM ({_sql_list(items)}) v(term, weight)"


_ASKED = [(t, 1.0) for t in scalar.tokens(ASK)]


@query(_bm25_sql(_terms(_ASKED), ""))
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.build(_docs(spark, sf_dir)).bm25(ASK).select("doc_id", _r(F.col("score"), "score"))


@query(_bm25_sql(_terms(_ASKED), "ORDER BY 2 DESC, 1 LIMIT 10"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = Corpus.build(_docs(spark, sf_dir)).bm25(ASK).select("doc_id", _r(F.col("score"), "score"))
    return top(scores, 10)


@query(_bm25_sql(_terms([("license", 1.0), ("the", 1.0), ("nothing_like_it", 1.0)]), ""))
def bm25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.build(_docs(spark, sf_dir)).bm25_tokens(["license", "the", "license", "nothing_like_it"]).select("doc_id", _r(F.col("score"), "score"))


@query(_bm25_sql(_terms([("license", 2.0), ("the", 0.5)]), ""))
def weighted_query_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("license", 1.0), ("license", 2.0), ("the", 0.5), ("of", -1.0), ("and", float("nan")), ("to", float("inf"))]
    return Corpus.build(_docs(spark, sf_dir)).bm25_weighted_tokens(asked).select("doc_id", _r(F.col("score"), "score"))


@query(f"""
    WITH {_W}, v AS (SELECT doc_id, list_filter(list_transform(words, lambda x: {{'token': x, 'weight': CASE WHEN length(x) > 3 THEN 2.0::DOUBLE WHEN length(x) = 3 THEN 1.0 ELSE 0.0 END}}), lambda z: z.weight > 0) AS t FROM w),
    d AS (SELECT doc_id, len(t)::DOUBLE AS dl FROM v), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    p AS (SELECT doc_id, x.token AS term, sum(x.weight) AS tf FROM (SELECT doc_id, unnest(t) AS x FROM v) WHERE x.token IN ('license', 'the') GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    x AS (SELECT p.doc_id, sum(ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.dl / s.avgdl))) AS score FROM p JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY p.doc_id)
    SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN x USING (doc_id)""")
def weighted_corpus_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenized(_docs(spark, sf_dir), parts=("words",))
    weight = lambda x: F.when(F.length(x) > 3, F.lit(2.0)).when(F.length(x) == 3, F.lit(1.0)).otherwise(F.lit(0.0))
    tokens = words.select("doc_id", F.transform("words", lambda x: F.struct(x.alias("token"), weight(x).alias("weight"))).alias("tokens"))
    return Corpus.build_weighted_tokens(tokens).bm25_tokens(["license", "the"]).select("doc_id", _r(F.col("score"), "score"))


@query(f"""
    WITH {_WG}, b AS (SELECT item_id, list_distinct(list_concat({_sql_words('text')}, {_sql_grams('text')})) AS q FROM benchmark),
    q AS (SELECT item_id, unnest(q) AS term FROM b), d AS (SELECT doc_id, len(tokens)::DOUBLE AS dl FROM t), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d),
    p AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    y AS (SELECT p.doc_id, p.term, ln((s.n - f.df + 0.5) / (f.df + 0.5) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * d.dl / s.avgdl)) AS part FROM p JOIN f USING (term) JOIN d USING (doc_id), s),
    x AS (SELECT q.item_id AS query_id, y.doc_id, round(sum(y.part), 6) AS score FROM y JOIN q USING (term) GROUP BY ALL)
    SELECT query_id, doc_id, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3""")
def bm25_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus.build(_docs(spark, sf_dir)).bm25_batch_top(_t(spark, sf_dir, "benchmark"), 3, "item_id", digits=6)


@query()
def bm25_weighted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["alpha content", "delta content", "メモリが不足する", "ファイルを書く atomic_write は重要", "", None]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return Corpus.build_weighted(docs).bm25_weighted("alphaは delta メモリ").select("doc_id", _r(F.col("score"), "score"))


@query()
def weighted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, "atomic_write は重要"), (1, "メモリの設定は重要。これは"), (2, "sshで接続する")], "doc_id long, text string")
    return rows.select("doc_id", F.posexplode(T.weighted_tokens("text")).alias("pos", "t")).select("doc_id", "pos", "t.token", "t.weight")


_TFIDF = f"""
    WITH {_W}, {_CONTENT}, e AS (SELECT doc_id, unnest(words) AS keyword FROM c), n AS (SELECT count(*) AS n FROM documents)
    SELECT keyword, round(count(*)::DOUBLE / sum(count(*)) OVER () * ln((any_value(n.n) + 1.0) / count(DISTINCT doc_id)), 6) AS score, count(*) AS count FROM e, n GROUP BY keyword"""


@query(f"{_TFIDF} ORDER BY count(*)::DOUBLE / sum(count(*)) OVER () * ln((any_value(n.n) + 1.0) / count(DISTINCT doc_id)) DESC, keyword LIMIT 50")
def tfidf_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tfidf_keywords(_docs(spark, sf_dir), 50).select("keyword", _r(F.col("score"), "score"), "count")


@query(f"""
    WITH w AS (SELECT doc_id, lang, {_sql_words("coalesce(text, '')")} AS words FROM documents),
    e AS (SELECT doc_id, lang, unnest(list_filter(words, lambda x: NOT {_sql_stop('x')})) AS keyword FROM w), n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    k AS (SELECT lang, keyword, count(*) AS count, count(DISTINCT doc_id) AS df FROM e GROUP BY ALL),
    x AS (SELECT k.lang, keyword, k.count::DOUBLE / sum(k.count) OVER (PARTITION BY k.lang) * ln((n.n + 1.0) / df) AS score, k.count FROM k JOIN n USING (lang))
    SELECT lang, keyword, round(score, 6) AS score, count FROM x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, keyword) <= 10""")
def tfidf_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.tfidf_keywords(_docs(spark, sf_dir, "lang"), 10, by="lang").select("lang", "keyword", _r(F.col("score"), "score"), "count")


@query(f"""
    WITH {_W}, i AS (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 4),
    v AS (SELECT words[i:i + 3] AS v FROM i), x AS (SELECT unnest(v) AS keyword FROM v WHERE list_has_any(v, ['license', 'version'])),
    k AS (SELECT keyword, count(*) AS count FROM x WHERE keyword NOT IN ('license', 'version') AND NOT {_sql_stop('keyword')} GROUP BY keyword),
    f AS (SELECT keyword, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(words) AS keyword FROM w) GROUP BY keyword)
    SELECT keyword, round(count * ln(((SELECT count(*) FROM documents) + 1.0) / df), 6) AS score, count FROM k JOIN f USING (keyword)
    ORDER BY count * ln(((SELECT count(*) FROM documents) + 1.0) / df) DESC, keyword LIMIT 30""")
def cooccurrence_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cooccurrence_keywords(_docs(spark, sf_dir), "license version", 4, 30).select("keyword", _r(F.col("score"), "score"), "count")


@query(f"""
    WITH {_W}, {_CONTENT},
    i AS (SELECT doc_id, words, len(words) AS n, unnest(range(1, len(words) + 2 - least(4, len(words)))) AS i FROM c WHERE len(words) >= 2),
    v AS (SELECT doc_id, i, words[i:i + least(4, n) - 1] AS v FROM i),
    p AS (SELECT doc_id, i, unnest(v) AS t, unnest(range(len(v))) AS at FROM v),
    e AS (SELECT x.doc_id, x.t AS a, y.t AS b FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.i = y.i AND x.at <> y.at AND x.t <> y.t)
    SELECT doc_id, a, b, count(*)::DOUBLE AS w FROM e GROUP BY ALL""")
def cooc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cooccurrence_edges(_docs(spark, sf_dir), 4)


@query()
def textrank_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.textrank_keywords(_docs(spark, sf_dir), 4, 5).select("doc_id", "keyword", _r(F.col("score"), "score"), "count")


@query()
def textrank_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.textrank_large(_docs(spark, sf_dir), 4, 20).select("keyword", _r(F.col("score"), "score"), "count")


def _diff_sql(table: str, side_a: str, side_b: str, top_n: int) -> str:
    return f"""
    WITH s AS (SELECT CASE WHEN {side_a} THEN 'a' WHEN {side_b} THEN 'b' END AS side, {_sql_words("coalesce(text, '')")} AS words FROM {table}),
    e AS (SELECT side, unnest(list_filter(words, lambda x: NOT {_sql_stop('x')})) AS keyword FROM s WHERE side IS NOT NULL),
    k AS (SELECT keyword, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM e GROUP BY keyword),
    m AS (SELECT sum(a) AS ta, sum(b) AS tb, greatest(count(*) FILTER (a > 0), 1) AS sa, greatest(count(*) FILTER (b > 0), 1) AS sb FROM k),
    r AS (SELECT keyword, (CASE WHEN a > 0 THEN a::DOUBLE / ta ELSE 0 END + 1.0::DOUBLE / (sa + 1)) AS fa, (CASE WHEN b > 0 THEN b::DOUBLE / tb ELSE 0 END + 1.0::DOUBLE / (sb + 1)) AS fb FROM k, m),
    x AS (SELECT 'a' AS side, keyword, fa / fb AS ratio FROM r UNION ALL SELECT 'b', keyword, fb / fa FROM r)
    SELECT side, keyword, round(ratio, 6) AS ratio FROM x WHERE x.ratio > 1.5 QUALIFY row_number() OVER (PARTITION BY side ORDER BY x.ratio DESC, keyword) <= {top_n}"""


@query(_diff_sql("documents", "lang = 'en'", "lang = 'de'", 20))
def corpus_diff_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "lang")
    return K.corpus_diff(docs.where("lang = 'en'"), docs.where("lang = 'de'"), 20).select("side", "keyword", _r(F.col("ratio"), "ratio"))


@query(_diff_sql("(SELECT text, quality FROM documents JOIN labels USING (doc_id))", "quality = 1", "quality = 0", 20))
def corpus_diff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).join(_t(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id")
    return K.corpus_diff(docs.where("quality = 1"), docs.where("quality = 0"), 20).select("side", "keyword", _r(F.col("ratio"), "ratio"))


def _longest_sql(en: frozenset[str], ja: frozenset[str]) -> str:
    english = f"CASE WHEN x IN ({', '.join(_LIT(w) for w in sorted(en))}) THEN strlen(x) ELSE 0 END"
    dense = ", ".join(f"CASE WHEN contains(x, {_LIT(w)}) OR contains({_LIT(w)}, x) THEN {len(w.encode())} ELSE 0 END" for w in sorted(ja))
    return f"greatest({english}, {dense})"


def _sentiment_sql(table: str, key: str) -> str:
    score = f"sign({_longest_sql(C.POSITIVE_EN, C.POSITIVE_JA)} - {_longest_sql(C.NEGATIVE_EN, C.NEGATIVE_JA)})"
    return f"""
    WITH w AS (SELECT {key}, {_sql_words("coalesce(text, '')")} AS words FROM {table}),
    s AS (SELECT {key}, len(words) AS n, list_transform(words, lambda x: {score}) AS s FROM w),
    c AS (SELECT {key}, n, len(list_filter(s, lambda v: v > 0)) AS p, len(list_filter(s, lambda v: v < 0)) AS m FROM s)
    SELECT {key}, CASE WHEN p > m THEN 'positive' WHEN m > p THEN 'negative' ELSE 'neutral' END AS polarity,
           round(CASE WHEN n = 0 THEN 0.0 WHEN p + m = 0 THEN 0.5 ELSE least(1.0, 0.5 + 0.5 * abs(p - m)::DOUBLE / (p + m) * least(1.0, (p + m)::DOUBLE / n)) END::DOUBLE, 6) AS confidence,
           p::BIGINT AS positive_count, m::BIGINT AS negative_count FROM c"""


@query(_sentiment_sql("documents", "doc_id"))
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentiments(_docs(spark, sf_dir)).select("doc_id", "polarity", _r(F.col("confidence"), "confidence"), "positive_count", "negative_count")


@query(f"SELECT role, polarity, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({_sentiment_sql('conversations', 'role')}) GROUP BY ALL")
def sentiment_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.sentiments(_t(spark, sf_dir, "conversations", "role", "text"))
    return rows.groupBy("role", "polarity").agg(F.count("*").alias("n"), F.round(F.avg(F.round("confidence", 6)), 6).alias("confidence"))


#: Lines of words parted by spaces, for the training queries.
LINES = ["# a comment", "", "これ は 新しい 記事 です 。", "昨日 は 雨 が 降りました", "メモリ を 設定 する 方法", "学生 たち が 本 を 読む", "猫 と 犬 が 好き です", "データ を 保存 して から 終了 する", "この 機能 は とても 便利 です"]


def _lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string")


@query()
def ja_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, s.replace(" ", "")) for i, s in enumerate(LINES)], "line_no long, text string")
    return tokenized(rows, parts=("words",)).select("line_no", F.array_join("words", " ").alias("words"))


@query()
def ja_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.training_samples(_lines(spark)).select(F.col("sample_id.n").alias("line_no"), F.col("sample_id.i").alias("place"), F.array_join("features", " ").alias("features"), "label")


@query()
def adaboost_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = M.train(M.training_samples(_lines(spark)), 10)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(model.weights.items())], "feature string, weight double")


@query()
def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = M.training_samples(_lines(spark))
    return M.evaluate(M.train(samples, 10), samples)


@query()
def segmenter_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.evaluate_lines(_lines(spark), default_segmenter())
