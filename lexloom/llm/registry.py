"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_classifier
from .byte_bpe import bpe
from .exact_topk import exact_topk
from .license_scan import scan_licenses
from .ngram_join import GRAM, THRESHOLD, near_copies
from .quality_rules import GRAM_LIMITS, LINE_LIMIT, SYMBOL_LIMIT, quality_rules
from .source_mix import mix_sources
from .suffix_dedup import LENGTH, PASSAGE, suffix_dedup
from .suffix_tree_lm import lm_scores
from .url_filter import judge_urls

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share", "gram_share_5", "gram_share_10"]
    return quality_rules(_table(spark, sf_dir, "documents")).select(*keep)


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), phrase=1)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), passage=PASSAGE, few=0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = compression_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return compression_classifier.classify(docs, model)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_topk": op2_exact_topk,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_license_scan": op5_license_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_source_mix": op9_source_mix,
    "op10_ngram_join": op10_ngram_join,
}

_WORD = r"[^\x20\x09-\x0D]+"
_LIMITS = " OR ".join(f"coalesce(c{n}, 0) > {limit}::DOUBLE * chars" for n, limit in GRAM_LIMITS.items())
_RULE_VALUES = ", ".join("('{}', '{}', '{}')".format(v, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
        WITH rules(verdict, rhost, rpath) AS (VALUES {_RULE_VALUES}),
        p AS (
            SELECT page_id, CASE WHEN found > 0 THEN substr(url, found + 3) ELSE '' END AS rest
            FROM (SELECT page_id, url, coalesce(instr(url, '://'), 0) AS found FROM pages)
        ),
        h AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
            FROM p
        ),
        fit AS (
            SELECT h.page_id, r.rhost || r.rpath AS rule, r.verdict,
                   row_number() OVER (PARTITION BY h.page_id ORDER BY len(string_split(r.rhost, '.')) DESC, length(r.rpath) DESC) AS place
            FROM h JOIN rules r ON ('.' || h.host) LIKE ('%.' || r.rhost) AND starts_with(h.path, r.rpath)
        )
        SELECT h.page_id, h.host, h.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM h LEFT JOIN fit f ON f.page_id = h.page_id AND f.place = 1""",
    "op2_exact_topk": """
        WITH ok AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, q.v, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM (SELECT DISTINCT vec_id, v FROM ok WHERE vec_id % 100 = 0) q JOIN ok c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op3_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
        e AS (SELECT r, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS z FROM w),
        g AS (SELECT r, pos, {", ".join(f"lead(hash(z), {i}) OVER (PARTITION BY r ORDER BY pos) AS h{i}" for i in range(max(GRAM_LIMITS)))} FROM e),
        k AS ({" UNION ALL ".join(f"SELECT r, {n} AS n, pos AS i, hash({', '.join(f'h{i}' for i in range(n))}) AS k FROM g WHERE h{n - 1} IS NOT NULL" for n in GRAM_LIMITS)}),
        h AS (SELECT r, n, i, row_number() OVER (PARTITION BY r, n, k ORDER BY i) AS place, count(*) OVER (PARTITION BY r, n, k) AS times FROM k),
        p AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS pos FROM h WHERE place > 1),
        c AS (SELECT r, n, sum(length(z)) AS c FROM p JOIN e USING (r, pos) GROUP BY r, n),
        x AS (SELECT r, {", ".join(f"max(c) FILTER (n = {n}) AS c{n}" for n in GRAM_LIMITS)} FROM c GROUP BY r),
        b AS (SELECT r, count(DISTINCT pos) AS n_repeat FROM (SELECT r, unnest(range(i, i + 5)) AS pos FROM h WHERE n = 5 AND times > 1) GROUP BY r),
        l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS place FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
        y AS (SELECT r, count(*) AS n_dup, sum(list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda z: length(z)))) AS c FROM l WHERE place > 1 GROUP BY r),
        m AS (
            SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0)::BIGINT AS chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                   coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(y.c, 0)::BIGINT AS line_chars, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, x.*
            FROM w LEFT JOIN x USING (r) LEFT JOIN b USING (r) LEFT JOIN y USING (r)
        ),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, chars AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR line_chars > {LINE_LIMIT}::DOUBLE * chars OR n_symbols > {SYMBOL_LIMIT}::DOUBLE * n_words OR {_LIMITS}) AS kept,
               line_chars::DOUBLE / greatest(chars, 1) AS line_share, coalesce(c5, 0)::DOUBLE / greatest(chars, 1) AS gram_share_5, coalesce(c10, 0)::DOUBLE / greatest(chars, 1) AS gram_share_10
        FROM f""",
    "op7_suffix_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        w AS (SELECT r, i, hash(substr(h, 2 * i + 1, {2 * LENGTH})) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE length(h) >= {2 * LENGTH})),
        t AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        s AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM t),
        g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
        x AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM g GROUP BY r, g),
        y AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM x),
        z AS (SELECT r, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head, max(b) AS tail, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM y JOIN d USING (r) GROUP BY r),
        p AS (SELECT r, i, hash(ws[i:i + {PASSAGE - 1}]) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - {PASSAGE - 2})) AS i FROM d WHERE len(ws) >= {PASSAGE})),
        q AS (SELECT r, i FROM p SEMI JOIN (SELECT k FROM p GROUP BY k HAVING count(*) > 1) USING (k)),
        n AS (SELECT r, sum(least({PASSAGE}, coalesce(next - i, {PASSAGE})))::BIGINT AS n_passage_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM q) GROUP BY r)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head || substr(h, 2 * tail + 1), h))) AS kept_sha256, coalesce(n_passage_words, 0) AS n_passage_words
        FROM d LEFT JOIN z USING (r) LEFT JOIN n USING (r)""",
    "op9_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS h
            FROM documents
        ),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
        o AS (
            SELECT *, sum(source_size) OVER () AS total, source_size / weight AS ratio,
                   coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
                   sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
            FROM w
        ),
        lv AS (
            SELECT (1.5::DOUBLE * total - 2.0::DOUBLE * fixed) AS rest, free::DOUBLE AS free FROM o
            WHERE 2.0::DOUBLE * source_size > weight * ((1.5::DOUBLE * total - 2.0::DOUBLE * fixed) / free::DOUBLE)
            ORDER BY ratio, source LIMIT 1
        ),
        t AS (
            SELECT source, source_size,
                   CASE WHEN rest IS NULL OR 2.0::DOUBLE * source_size <= weight * (rest / free) THEN 2.0::DOUBLE * source_size ELSE weight * rest / free END AS target
            FROM w LEFT JOIN lv ON true
        ),
        g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
        c AS (
            SELECT d.doc_id, d.size, g.source_size, g.target, g.times, g.target - g.times * g.source_size AS goal,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
                   sum(d.size) OVER (PARTITION BY d.source, d.h) AS words
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        )
        SELECT doc_id, size, source_size, target,
               (size * (times + CASE WHEN upto <= goal OR 2 * upto - words <= 2 * goal THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM c""",
    "op10_ngram_join": rf"""
        WITH RECURSIVE t AS (
            SELECT coalesce(text, '') AS t, min(doc_id) AS copy_id, count(*)::BIGINT AS n_copies,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws
            FROM documents GROUP BY ALL
        ),
        c AS (
            SELECT *, row_number() OVER () AS k,
                   CASE WHEN len(ws) >= {GRAM} THEN list_distinct(list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i:i + {GRAM - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g
            FROM t
        ),
        e AS (SELECT k, len(g) AS n, unnest(g) AS g FROM c),
        p AS (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
        r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
        m AS (SELECT r.a AS k, min(c.copy_id) AS class_id FROM r JOIN c ON c.k = r.b GROUP BY r.a),
        l AS (SELECT a AS k, count(*)::BIGINT AS n_links FROM p GROUP BY a)
        SELECT d.doc_id, m.class_id, c.copy_id, c.n_copies, coalesce(l.n_links, 0) AS n_links
        FROM documents d JOIN c ON c.t = coalesce(d.text, '') JOIN m USING (k) LEFT JOIN l USING (k)""",
}
