"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import contextlib
import gc
import hashlib
import itertools
import math
import os
import random
import re
import threading
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lexloom.llm import compression_classifier as cc
from lexloom.llm import difference_cover, license_scan, ngram_join, quality_rules, registry, source_mix, store, suffix_dedup, suffix_tree_lm
from lexloom.llm.byte_bpe import bpe, char_classes, encode, load
from lexloom.llm.bytetext import chunks
from lexloom.llm.components import components
import lexloom.llm.exact_topk as topk
from lexloom.llm.exact_topk import exact_topk
from lexloom.llm.license_scan import PHRASES, Automaton, scan_licenses
from lexloom.llm.url_filter import Trie, judge_urls

RNG = random.Random(5)
WORDS = ["the", "of", "and", "alpha", "beta", "gamma", "Éa", "中文", "x1", "it's", "###", "MIT", "license"]
# columns that clash with names the operators use inside
SCHEMA = "doc_id long, text string, source string, row long, key string, md5 string, size int, target string, score double, label int"


def _text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def _rows():
    base = [_text(RNG.randrange(0, 60)) for _ in range(60)]
    near = [b.replace("alpha", "delta", 1) for b in base[:15]]
    line = "this line stands here twice or more\n"
    texts = base + near + base[:8] + [None, "", "   \n ", "word", "two words", _text(4000), line * 6, "a " * 300, "no\x00de", "all rights reserved. CC BY, and CC-BY", "é" * 50]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id " + base[5], "s0"), (None, None, None)]
    return [(*r, 7, "k", "m", 1, "t", 0.5, 1) for r in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(t):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


# -- URL filter

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "org/pre"), ("allow", "same.io/"), ("block", "same.io/")]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in RULES:
        h, _, p = rule.partition("/")
        if ("." + host).endswith("." + h) and path.startswith("/" + p):
            rank = (h.count(".") + 1, len(p), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://example.com", "http://example.com/", "https://a.EXAMPLE.com/en/1?x=/y#z", "http://www.example.com/en/a://b", "http://x.www.example.com/en/", "http://b.net/es/1", "http://b.net/es",
            "http://notexample.com/en/", "http://q.org/prefix", "http://q.org/pr", "http://same.io/", "http://com/", "http://a.com?b", "http://a..com/", "x" * 5000 + "://a.com/", "http://q.org/" + "p" * 1_000_000, "http://example.com/en/" + "a/" * 300_000]
    urls += ["http://b.net/es/1"] * 3
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES, keep=["page_id"]).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert judge_urls(df.limit(0), RULES, keep=["page_id"]).collect() == []
    with pytest.raises(ValueError):
        judge_urls(df, RULES, keep=["verdict"])
    with pytest.raises(ValueError):
        Trie([("maybe", "com/")])
    assert Trie([]).match("a.com", "/") is None


# -- top k


def test_exact_topk(spark, monkeypatch):
    """Also in several groups of queries, over more partitions than are merged at once."""
    rows = [(i, [RNG.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], 0) for i in range(120)]
    rows += [(120, None, 0), (121, [1.0, None, 0.0, 0.0], 0), (122, [float("nan")] * 4, 0), (123, [float("inf")] * 4, 0), (None, [1.0] * 4, 0), (200, [1.0, 2.0], 0), (300, [], 0)]
    rows += [rows[7], rows[10], (-1, [1.0] * 4, 0), (-20, [1.0] * 4, 0), (7, [1.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    ok = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in {r for r in ok if r[0] % 10 == 0}:
        s = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q and len(v) == len(x))
        want += [(q, n, i, -y) for n, (y, i) in enumerate(s[:10], 1)]
    got = [tuple(r) for r in exact_topk(df, df.where("vec_id % 10 = 0")).collect()]
    assert sorted(got) == sorted(want)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "GROUP_BYTES", 200)
    monkeypatch.setattr(topk, "TILE", 16)
    again = [tuple(r) for r in exact_topk(df.repartition(40), df.where("vec_id % 10 = 0")).collect()]
    assert sorted(again) == sorted(want)
    assert exact_topk(df.limit(0), df.limit(0)).collect() == []
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e5, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk(big, big.where("vec_id = 1"), scale=1.0).collect()] == [(1, 1, 0, 10**17 + 3)]


# -- quality rules


def brute_rules(text):
    w = [x.decode() for x in words_of(text)]
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set().union(*[range(i, i + 5) for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1], set())
    later, seen = set(), set()
    for i in range(len(w) - 9):
        g = tuple(w[i : i + 10])
        if g in seen:
            later |= set(range(i, i + 10))
        seen.add(g)
    chars = sum(map(len, w))
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w), round(sum(len(w[i]) for i in later) / max(chars, 1), 9)


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs).collect()
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, round(r.gram_share_10, 9)) for r in got), key=repr)
    assert have == sorted(((r[0], *brute_rules(r[1])) for r in ROWS), key=repr)
    assert all(not r.kept for r in got if r.base_failed)
    clean = " ".join(f"word{i} and{i % 40}" for i in range(400))
    assert quality_rules.quality_rules(docs.sparkSession.createDataFrame([(1, clean)], "doc_id long, text string")).first().kept
    assert quality_rules.quality_rules(none).collect() == []


# -- language model


def brute_lm(rows):
    """Base score and score of each row, by dictionaries of tuples."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", lowered(t))) for i, t in rows]
    train = [w for i, w in docs if not held(i)]
    c, texts = collections.Counter(x for w in train for x in w), len(train)
    total, distinct = c.total() + texts, len(c) + (texts > 0)
    log = lambda n: math.log10(n + 0.5) - math.log10(total + 0.5 * (distinct + 1))

    def ends(word):
        h = next(chunks(pa.array([word.decode()]))).words(suffix_tree_lm.SPACED).hashes()
        return int(suffix_tree_lm.mix(h ^ suffix_tree_lm._SEED)[0]) % suffix_tree_lm.PHRASE == 0

    last = {x: ends(x) for _, w in docs for x in w}

    def phrases(w):
        out, now = [], []
        for x in w:
            now.append(x)
            if last[x]:
                out.append(tuple(now))
                now = []
        return [*out, (*now, "end")]

    def grams(ph):
        """(context, phrase) of each order at each place; None where the text is too short."""
        line = ["begin", *ph]
        return [[(tuple(line[i - d : i]), line[i]) if i >= d else None for d in range(3)] for i in range(1, len(line))]

    n = collections.Counter(g for w in train for at in grams(phrases(w)) for g in at if g)
    before = lambda ctx: texts if ctx == ("begin",) else n[ctx[:-1], ctx[-1]] if ctx else sum(x for (k, _), x in n.items() if not k)
    size = {ctx: before(ctx) for ctx, _ in n}
    known = {g: x for g, x in n.items() if x >= suffix_tree_lm.LEAST}
    stats = collections.defaultdict(lambda: [0, 0, 0.0])
    for (ctx, p), x in known.items():
        one = stats[ctx]
        one[0] += x
        one[1] += 1
        if ctx:
            one[2] += x * (math.log2(x / size[ctx]) - math.log2(n[ctx[1:], p] / size[ctx[1:]]))
    stay = {ctx for ctx, (m, k, bits) in stats.items() if not ctx or (bits >= suffix_tree_lm.DIVERGENCE * m and bits >= suffix_tree_lm.EVIDENCE * k)}
    out = []
    for i, w in docs:
        score = 0.0
        for at, p in zip(grams(phrases(w)), phrases(w)):
            for g in reversed(at):
                if g is None or g[0] not in stay:
                    continue
                m, k, _ = stats[g[0]]
                if g in known:
                    score += math.log10(known[g] / (size[g[0]] + k))
                    break
                score += math.log10((size[g[0]] - m + k) / (size[g[0]] + k))
            else:
                score += sum(log(texts if x == "end" else c[x]) for x in p)
        base = sum(log(c[x]) for x in w) + log(texts)
        out.append((i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + (texts > 0), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr), stay


@pytest.mark.parametrize("hot, part, least", [(1e-6, 16 << 20, None), (0.02, 300, -1.0)])
def test_suffix_tree_lm(docs, none, spark, monkeypatch, hot, part, least):
    """With all words broadcast and one part a task, and with most words joined, many small parts and every context kept."""
    monkeypatch.setattr(suffix_tree_lm, "PART_BYTES", part)
    monkeypatch.setattr(suffix_tree_lm, "HELD", part)
    if least is not None:
        monkeypatch.setattr(suffix_tree_lm, "DIVERGENCE", least)
        monkeypatch.setattr(suffix_tree_lm, "EVIDENCE", least)
    rounded = lambda rows: sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in rows), key=repr)
    want, stay = brute_lm([r[:2] for r in ROWS])
    assert {len(ctx) for ctx in stay} == ({0, 1} if least is None else {0, 1, 2})
    assert rounded(suffix_tree_lm.lm_scores(docs, hot=hot, divergence=suffix_tree_lm.DIVERGENCE).collect()) == want
    assert suffix_tree_lm.lm_scores(none).collect() == []
    only = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    got = suffix_tree_lm.lm_scores(only).collect()
    assert {(r.n_known, r.train_tokens) for r in got} == {(0, 0)} and rounded(got) == brute_lm([(r.doc_id, "a b") for r in got])[0]


def test_suffix_tree_over_words(docs, monkeypatch, spark):
    """The query's symbols are words: contexts begin at every word, and scores are those of dictionaries."""
    monkeypatch.setattr(suffix_tree_lm, "PHRASE", 1)
    want, stay = brute_lm([r[:2] for r in ROWS])
    assert {len(ctx) for ctx in stay} == {0, 1, 2}
    monkeypatch.setattr(registry, "_table", lambda *_: docs)
    got = registry.op4_suffix_tree_lm(spark, "").collect()
    assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=repr) == want


def test_suffix_tree_knows_more_of_more_text(spark):
    """What is learnt grows: contexts of a text seen twice are kept, and held-out copies score better than by the base."""
    rng = random.Random(11)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(60)]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)]
    got = suffix_tree_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
    assert sum(r.score > 0.5 * r.base_score for r in held) / len(held) > 0.6


def test_suffix_tree_in_buckets(docs, monkeypatch):
    """Keys summed in many ranges and asked for by many parts, over words and over phrases, give the scores of dictionaries."""
    for name in ("BUCKET", "PART_BYTES", "HELD"):
        monkeypatch.setattr(suffix_tree_lm, name, 300)
    for phrase in (1, 3):
        monkeypatch.setattr(suffix_tree_lm, "PHRASE", phrase)
        want, _ = brute_lm([r[:2] for r in ROWS])
        got = suffix_tree_lm.lm_scores(docs, phrase=phrase).collect()
        assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=repr) == want
        empty = [(r[0], t) for r, t in zip(ROWS, (None, "", " \n "))]  # no word in any part
        got = suffix_tree_lm.lm_scores(docs.sparkSession.createDataFrame(empty, "doc_id long, text string"), phrase=phrase).collect()
        assert sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in got), key=repr) == brute_lm(empty)[0]
    for x in ([], [0], [0, 0, 255, 256], [2**64 - 1, 1, 7], list(range(0, 5000, 3))):
        x = np.array(x, np.uint64)
        assert suffix_tree_lm.unpacked(suffix_tree_lm.packed(x)).tolist() == x.tolist()
        assert suffix_tree_lm.unpacked_keys(suffix_tree_lm.packed_keys(np.sort(x))).tolist() == sorted(x.tolist())


def test_suffix_tree_needs_little_disk(spark, monkeypatch, tmp_path):
    """Over words, all files at any one time (tables between steps, and what is shuffled) are at most 20 bytes for each word of the texts."""
    rng = random.Random(12)
    lines = [[f"w{int(rng.paretovariate(0.3)) % 30000}" for _ in range(10)] for _ in range(40000)]
    texts = [" ".join(w for _ in range(10) for w in rng.choice(lines)) for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setitem(store._own, spark.sparkContext.applicationId, f"file://{tmp_path}")
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    folders = [tmp_path, *(d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]

    def used():
        total = 0
        for d in folders:
            for at, _, names in os.walk(d):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.stat(f"{at}/{name}").st_size
        return total

    before, most, done = used(), [0], threading.Event()
    watch = threading.Thread(target=lambda: [most.append(used() - before) for _ in iter(lambda: done.wait(0.02), True)])
    watch.start()
    try:
        got = suffix_tree_lm.lm_scores(df, phrase=1).collect()
    finally:
        done.set()
        watch.join()
    assert len(got) == 5000 and sum(r.n_tokens for r in got) == 505000
    assert max(most) < 20 * 505000


# -- licenses


def test_license_scan(docs, none, monkeypatch):
    got = scan_licenses(docs).collect()
    want = []
    for r in ROWS:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(r[1]))
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
        want.append((r[0], len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert scan_licenses(none).collect() == []
    texts = ["x Released under the MIT License. y", "Released under the new MIT License", "the MIT", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense and sell copies of the Software, and to permit persons to do so"]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in scan_licenses(df).orderBy("doc_id").collect()] == ["mit", "", "", "mit"]
    header = license_scan.TEMPLATES["apache-2.0"][0]
    df = docs.sparkSession.createDataFrame([(0, f"{header} code here {header} more code and text {header}")], "doc_id long, text string")
    assert [(x.label, x.first, x.last, x.cover) for x in sorted(scan_licenses(df).first().spans)] == [("apache-2.0", i, i + 7, 1.0) for i in (0, 10, 22)]
    monkeypatch.setattr(license_scan, "TEMPLATES", {})
    assert {r.labels for r in scan_licenses(df).collect()} == {""}


def test_automaton_matches():
    seqs = [[RNG.randrange(4) for _ in range(RNG.randrange(1, 12))] for _ in range(6)]
    a = Automaton(seqs)
    for _ in range(200):
        run = [RNG.randrange(5) for _ in range(RNG.randrange(1, 15))]
        longest = [max([l for l in range(e + 1) if any(run[e - l : e] == s[i : i + l] for s in seqs for i in range(len(s) - l + 1))]) for e in range(1, len(run) + 1)]
        want = {(e, l) for e, l in enumerate(longest, 1) if l >= 2 and (e == len(run) or longest[e] != l + 1)}
        got = a.matches(run, 2)
        assert {(e, l) for e, l, _ in got} == want
        for e, l, v in got:
            assert set(a.ends[v]) == {(k, i + l) for k, s in enumerate(seqs) for i in range(len(s) - l + 1) if s[i : i + l] == run[e - l : e]}


# -- byte-level BPE


def test_byte_bpe(docs, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe(docs, path, with_ids=True).collect()
    want = []
    for r in ROWS:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe(none, path).collect() == []
    alphabet = "'stremvld aAé中1² \n\t\x1c\x85\u00a0\u3000#*😀\u0301<|endoftext|>"
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randrange(0, 14))) for _ in range(4000)] + ["z" * 700, " " * 90 + "y", "#" * 999, "'s's 'll", "ab" * 60]
    r, classes = load(path), char_classes()
    for c in chunks(pa.array(texts)):
        ids, first = encode(r, c, classes)
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(c.n)] == [enc.encode_ordinary(t) for t in texts[c.first : c.first + c.n]]


# -- repeats


def brute_repeats(rows, n):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(t[i : i + n] for _, t in data for i in range(len(t) - n + 1))
    out = []
    for d, t in data:
        m = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                m[i : i + n] = b"\1" * n
        kept = bytes(x for x, y in zip(t, m) if not y)
        out.append((d, len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_passages(rows, n):
    """Per row the words inside strings of ``n`` words that stand twice, and what is left without them."""
    data = [(i, (t or "").encode(), [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]) for i, t in rows]
    grams = lambda t, w: [tuple(t[a:b] for a, b in w[i : i + n]) for i in range(len(w) - n + 1)]
    count = collections.Counter(g for _, t, w in data for g in grams(t, w))
    out = []
    for d, t, w in data:
        inside = set().union(*[range(i, i + n) for i, g in enumerate(grams(t, w)) if count[g] > 1], set())
        left, at, runs = b"", 0, 0
        for i in sorted(inside):
            runs += i - 1 not in inside
            a = w[i][0] if i - 1 not in inside else at
            left += t[at:a]
            at = w[i][1]
        left += t[at:]
        out.append((d, len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest(), len(inside)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("task, few", [(1 << 20, 1 << 20), (600, 0)])
def test_suffix_dedup(docs, none, monkeypatch, task, few):
    """In one array and in many, with what is joined broadcast and shuffled."""
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", few)
    rows = [r[:2] for r in ROWS]
    both = [tuple(r) for r in suffix_dedup.suffix_dedup(docs, length=60, passage=9).collect()]
    assert sorted((r[:5] for r in both), key=repr) == brute_repeats(rows, 60)
    words = brute_passages(rows, 9)
    assert sorted(((*r[:2], r[5]) for r in both), key=repr) == sorted(((*r[:2], r[5]) for r in words), key=repr)
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs, length=9, unit="words").collect()), key=repr) == [r[:5] for r in words]
    assert suffix_dedup.suffix_dedup(none).collect() == []
    assert suffix_dedup.suffix_dedup(none, passage=5, keep_text=True).collect() == []
    with pytest.raises(ValueError):
        suffix_dedup.suffix_dedup(docs, carry=("text",))


@pytest.mark.parametrize("unit, length", [("bytes", 60), ("words", 9)])
def test_suffix_dedup_large_keys(spark, monkeypatch, unit, length):
    """Passages in many different surroundings: keys too large for a task are divided, without a sort of all their suffixes over the cluster."""
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", 2000)
    monkeypatch.setattr(difference_cover, "ranks", None)
    rng = random.Random(5)
    some = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passages = [some(n) for n in (6, 10, 12, 25)]
    rows = [(i, f"{some(rng.randrange(12))} {passages[i % 4]} {some(rng.randrange(12))} {passages[i % 3]}") for i in range(60)]
    want = brute_repeats(rows, length) if unit == "bytes" else [r[:5] for r in brute_passages(rows, length)]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=length, unit=unit).collect()), key=repr) == want


def test_suffix_dedup_long_texts(spark):
    """Texts larger than a chunk: a passage at both ends of one, and in another."""
    long = " ".join(f"w{i}" for i in range(50_000))
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(0, f"{passage} {long} {passage}"), (1, f"x {passage}"), (2, long[: 1 << 10])]
    got = {r.doc_id: (r.n_removed, r.n_spans, r.n_passage_words) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage=49).collect()}
    assert got == {r[0]: (r[2], r[3], w[5]) for r, w in zip(brute_repeats(rows, 400), brute_passages(rows, 49))}


def test_suffix_array():
    import numpy as np

    for n in [*range(25), 400]:
        for a in (1, 2, 6):
            s = [RNG.randrange(a) for _ in range(n)]
            assert suffix_dedup.suffix_array(np.array(s, np.int64)).tolist() == sorted(range(n), key=lambda i: s[i:])


@pytest.mark.parametrize("length", [2, 11])
def test_difference_cover_over_tasks(spark, length):
    """Suffixes that differ in their first symbols are in order, and repeated windows those of a dictionary."""
    seqs = [[RNG.randrange(1, 4) for _ in range(RNG.randrange(0, 60))] for _ in range(25)]
    seqs += [seqs[0][:40] + [9] * 5, [1] * 50, [2, 1] * 30, [], [3]]
    rows = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(seqs)], "seq long, owned long, symbols array<long>").repartition(4)
    got = {r.seq: r.ranks for r in difference_cover.ranks(rows.select("seq", "symbols"), length).collect()}
    order = sorted((got[i][k], i, k) for i, s in enumerate(seqs) for k in range(len(s)))
    heads = [seqs[i][k : k + length] for _, i, k in order]
    assert heads == sorted(heads)
    count = collections.Counter(tuple(s[k : k + length]) for s in seqs for k in range(len(s) - length + 1))
    want = {i: [k for k in range(len(s) - length + 1) if count[tuple(s[k : k + length])] > 1] for i, s in enumerate(seqs)}
    assert {r.seq: r["at"] for r in difference_cover.repeated(rows, length).collect()} == {i: v for i, v in want.items() if v}


# -- classifier


def brute_score(model, text):
    """The score by the definition: compressed sizes under both dictionaries, block by block, and the logistic curve."""
    data, opts = text.encode(), {"level": cc.LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    size = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **opts) for d in (model.good, model.bad)]
    parts = [data[i : i + cc.BLOCK] for i in range(0, len(data), cc.BLOCK)]
    good, bad = ([len(c.compress(x)) for x in parts] for c in size)
    if parts:
        worst = min((b - g) / max(b, g) * min(1.0, 4 * len(x) / cc.BLOCK) for g, b, x in zip(good, bad, parts))
        row = [(sum(bad) - sum(good)) / max(sum(bad), sum(good)), worst, min(sum(good), sum(bad)) / len(data), 0.0]
    else:
        row = [0.0, 0.0, 0.0, 1.0]
    z = model.weights[-1] + sum(w * (x - m) / s for w, x, m, s in zip(model.weights, row, model.mean, model.scale))
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_quality_classifier(spark, none):
    good = ["the quiet river runs through the green valley and over the old stone bridge " * RNG.randrange(1, 5) + str(i) for i in range(150)]
    bad = [" ".join(RNG.choice(["$$$", "###", "BUY!!", "CLICK!!", "%%%"]) for _ in range(40)) + str(i) for i in range(150)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    rows += [(5000, None, None), (5001, "", None), (None, "x", 1), (0, good[0], 1)]
    df = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = cc.fit(df, labels)
    got = cc.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 5000]
    assert held and all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id < 1000) for r in held) / len(held) > 0.95
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    text = {i: t for i, t, _ in rows if i is not None}
    assert all(abs(r.score - brute_score(model, text[r.doc_id] or "")) < 1e-9 for r in got if r.doc_id is not None)
    assert cc.classify(none, model).collect() == []
    empty = cc.fit(df, labels.limit(0))
    assert {r.score for r in cc.classify(df, empty).collect()} == {0.5}
    assert cc.keep_good(df, model).count() == sum(r.predicted for r in got)


# -- mix


def brute_mix(rows):
    size = lambda t: len(words_of(t))
    per = collections.Counter()
    for _, t, s in rows:
        per[s] += size(t)
    names = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(per.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * per[s] for s in capped)
        over = {s for s in free if weight[s] * rest / sum(weight[x] for x in free) >= 2 * per[s]}
        if not over:
            break
        capped |= over
        if len(capped) == len(names):
            break
    target = {s: 2.0 * per[s] if s in capped else weight[s] * rest / sum(weight[x] for x in free) for s in names}
    return per, target


def test_source_mix(docs, none):
    rows = [r[:3] for r in ROWS]
    got = source_mix.mix_sources(docs).collect()
    per, target = brute_mix(rows)
    assert len(got) == len(rows)
    source, taken = {(r[0], len(words_of(r[1]))): r[2] for r in rows}, collections.Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == per[s] and abs(r.target - target[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in per)
    again = source_mix.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert source_mix.mix_sources(none).collect() == []
    assert source_mix.mixed_rows(docs).columns == docs.columns


# -- near copies


def brute_near(rows, n, threshold):
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)

    def grams(t):
        w = lowered(t).split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {t: grams(t) for t in texts}
    links, parent = collections.Counter(), {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        both = sets[a] | sets[b]
        if both and len(sets[a] & sets[b]) >= threshold * len(both):
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {t: min([i for i in ids if i is not None], default=None) for t, ids in texts.items()}
    tops = collections.defaultdict(list)
    for t in texts:
        if least[t] is not None:
            tops[root(t)].append(least[t])
    return sorted(((i, min(tops[root(t)], default=None), least[t], len(ids), links[t]) for t, ids in texts.items() for i in ids), key=repr)


@pytest.mark.parametrize("block, few", [(384, 300_000), (2, 0)])
def test_near_copies(docs, none, monkeypatch, block, few):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", few)
    got = ngram_join.near_copies(docs).collect()
    assert sorted(((r.doc_id, r.class_id, r.copy_id, r.n_copies, r.n_links) for r in got), key=repr) == brute_near([r[:2] for r in ROWS], 3, 0.5)
    assert ngram_join.near_copies(none).collect() == []


def test_one_of_each(docs):
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    want = {c for i, c, *_ in brute_near([r[:2] for r in ROWS], 3, 0.5) if c is not None}
    assert set(ids) - {None} == want and sum(i is not None for i in ids) == len(want)


def test_passage_shared_by_dissimilar_texts(spark):
    """A pair is found though the nodes it shares hold many texts that have only a passage in common with it."""
    words = (f"w1276x{i}" for i in itertools.count())
    some = lambda n: " ".join(itertools.islice(words, n))
    passage = some(32)
    rows = [(i, f"{passage} {some(15 if i < 2 else 160)}") for i in range(302)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (0, 1) if i < 2 else (i, 0) for i, _ in rows}


def test_forest(spark, monkeypatch):
    """Neighbours and nodes of the sorted tries are those of a dictionary of prefixes, wherever the rows are cut into tasks."""
    import numpy as np

    def signed(t, path):
        x = int(np.int64(np.uint64(sum(s << 16 * (3 - k) for k, s in enumerate(path)))))
        return x

    rows = [(i, [signed(t, [RNG.randrange(2) * 40000 for _ in range(4)]) for t in range(3)]) for i in range(200)]
    forest = ngram_join.Forest(spark.createDataFrame(rows, "cls long, labels array<long>").repartition(5), 1, 4)
    for depth in range(1, 5):
        nodes = collections.defaultdict(set)
        for i, labels in rows:
            for t, x in enumerate(labels):
                nodes[t, (x % (1 << 64)) >> 16 * (4 - depth)].add(i)
        got = collections.defaultdict(set)
        for r in forest.members(depth).collect():
            got[r.node].add(r.cls)
        assert sorted(sorted(v) for v in got.values() if len(v) > 1) == sorted(sorted(v) for v in nodes.values() if len(v) > 1)
        parent = {(k, i): (k, i) for k, v in nodes.items() for i in v}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        edges = {(r.a, r.b) for r in forest.edges(depth).collect()}
        for k, v in nodes.items():
            for a, b in itertools.combinations(sorted(v), 2):
                if (a, b) in edges:
                    parent[root((k, a))] = root((k, b))
            assert len({root((k, i)) for i in v}) == 1


@pytest.mark.parametrize("start", [0.99, 0.1])
def test_recall_near_the_threshold(spark, monkeypatch, start):
    """Pairs of a similarity of 0.5 to 0.6 are found, however long the first prefixes; they are shortened for them."""
    monkeypatch.setattr(ngram_join, "START", start)
    assert ngram_join.longest(0.5) == (3 if start == 0.99 else 4)
    rng, rows, want = random.Random(3), [], {}
    for i in range(300):
        n = rng.randrange(40, 90)
        words = [f"v{i}x{k}" for k in range(n)]
        other = [*words[: round(n * rng.uniform(0.68, 0.76))], *(f"u{i}x{k}" for k in range(round(n * 0.26)))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (words, other))
        want[2 * i] = want[2 * i + 1] = int(len(a & b) >= 0.5 * len(a | b))
    got = {r.doc_id: r.n_links for r in ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want.values()) > 200
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.995 * sum(want.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, j) for j in range(101, 130)] + [(5, 5), (7, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = []
    for i in range(120):
        t = " ".join(f"{RNG.choice(['river', 'valley', 'stone', 'bridge', 'forest'])}{RNG.randrange(4000)}" for _ in range(80))
        rows.append((i, t, "en", f"s{i % 3}"))
    rows += [(1000 + i, " ".join(RNG.choice(["$$$", "###!!", "%%%"]) for _ in range(60)) + str(i), "en", "s1") for i in range(60)]
    passage = " ".join(f"shared{i}" for i in range(52))
    rows += [(500 + i, f"{rows[i][1][:200]} {passage} {' '.join(f'more{i}x{k}' for k in range(200))}", "en", "s2") for i in (50, 60)]
    rows += [(2000 + i, rows[i][1], "en", "s0") for i in range(10)] + [(3000, None, "en", None), (3001, "", None, "s1")]
    clash = "row long, n_bytes int, score double, key string, md5 string"
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 0.5, None, "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clash)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if 1000 <= r[0] < 2000 else 1) for r in rows if r[0] < 2000], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), df.columns
    model = cc.fit(df, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rows_in = docs.collect()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == columns
        before, have = rows_in, sorted(docs.collect(), key=repr)
        ids = {r.doc_id for r in have}
        if i == 0:
            assert ids == {r.doc_id for r in before if brute_score(model, r.text or "") >= cc.THRESHOLD}
        if i == 1:
            assert ids == {c for _, c, *_ in brute_near([(r.doc_id, r.text) for r in before], 3, 0.5)}
        if i == 2:
            left = {r[0]: r[4] for r in brute_passages([(r.doc_id, r.text) for r in before], suffix_dedup.PASSAGE)}
            assert all(left[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest() and r.n_chars == len(r.text) for r in have)
            assert set(left) - ids == {r.doc_id for r in before if not words_of(r.text)}
        if i == 3:
            taken = {r.doc_id: r.taken // r.size for r in source_mix.mix_sources(spark.createDataFrame(before, docs.schema)).collect() if r.size}
            assert collections.Counter(r.doc_id for r in have) == collections.Counter({i: n for i, n in taken.items() if n})
        if i == 4:
            text = {r.doc_id: r.text for r in before}
            assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in have)
        rows_in = have
        if i == 0:
            assert not ids & set(range(1000, 1060)) and set(range(120)) <= ids
        if i in (1, 2):
            assert set(range(120)) <= ids and not ids & set(range(2000, 2010))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() > 0
    assert docs.where(F.size("ids") != F.col("n_tokens")).count() == 0
