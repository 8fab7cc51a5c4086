"""Operators against brute force, exact round trips and held-out data."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, html_text, lm, near, packing, passages, pieces, quality, queries, secrets, urls

SF = "/root/testdata/sf0.001"
rng = random.Random(11)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def test_quality_signals(texts):
    made = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n \n" + "x y\n" * rng.randint(0, 3) for _ in range(100)]
    every = [t for _, t in texts] + made
    for t, got in zip(every, quality.signals(every), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        assert got[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))


def test_quality_keeps_good_and_drops_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.QUERIES["op4_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_em_finds_accuracies():
    true = [(0.9, 0.05), (0.7, 0.2), (0.8, 0.1)]
    counts = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = [(2 if good else 0) if (x := rng.random()) < a else (0 if good else 2) if x < a + w else 1 for a, w in true]
        counts[sum(v * 3**i for i, v in enumerate(votes))] += 1
    model = quality.fit(dict(counts), rules=3)
    for (a, w), got in zip(true, model.weights, strict=True):
        assert abs(got[2] - math.log(a / w)) < 0.3 and abs(got[0] + math.log(a / w)) < 0.3


def test_secrets():
    t = 'x password = "abcdef" Token:abc, API_KEY: zzzzzzz AKIA' + "A" * 16 + " " + "0a" * 13 + " paſsword=qwertz the passphrase is kJ8#fQ2!xWm0Zt and the passphrase is good morning"
    ((got,),) = secrets.spans_of([t], {"morning": 1}, 10.0)
    assert [(k, t[a:b]) for k, a, b in got] == [("assign", 'password = "abcdef'), ("assign", "API_KEY: zzzzzzz"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 13), ("guess", "kJ8#fQ2!xWm0Zt")]


def test_guess_cost():
    ranks = {"correct": 10, "horse": 20}
    cost = lambda v: secrets.guess_cost(v, ranks)
    assert cost("correcthorse") < 4 and cost("2019-04-03") < 6 and cost("qwertyuiop") < 5 and cost("aaaaaaaaaaaa") < 4
    assert cost("x7$Kq9!mZw2p") > 12 and cost("") == 0

    def brute(v, at=0):
        """All cuts into words and brute-force spans."""
        if at == len(v):
            return 0.0
        best = math.inf
        for end in range(at + 1, len(v) + 1):
            part = v[at:end]
            c = sum(math.log10(10 if x.isdigit() else 26 if x.isalpha() else 33) for x in part)
            if part in ranks and len(part) > 2:
                c = min(c, math.log10(ranks[part] + 1))
            best = min(best, c + math.log10(2) + brute(v, end))
        return best

    for v in ("xhorsey", "correct#1", "b7c-x"):
        assert abs(cost(v) - brute(v)) < 1e-9


def test_redacted(spark):
    df = spark.createDataFrame([(1, "a password=abcdef12 b"), (2, "clean"), (3, None)], "doc_id int, text string")
    assert [r.text for r in secrets.redact(df, ranks={}).orderBy("doc_id").collect()] == ["a [SECRET] b", "clean", None]


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, coder = Tokenizer.from_file(path), packing.ByteBpe(path)
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "the", "é", "<|endoftext|>", "'s", "12", "\t", "!!", "日本", "🙂", " ", "It's", "\x1c"]
    every = [t for _, t in texts] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(500)]
    for t in every:
        ids = whole.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == struct.pack(f"<{len(ids)}I", *ids)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = packing.pack(packing.pieces(df, path, capacity=256), capacity=256, group=100).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, t in texts:
        own = sorted(by_doc[i], key=lambda r: r.piece)
        ids = struct.unpack(f"<{sum(r.length for r in own)}I", b"".join(r.ids for r in own))
        assert list(ids) == [*whole.encode(t, add_special_tokens=False).ids, 0]
        assert all(r.length == 256 for r in own[1:]) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_seq) <= packing.lower_bound(np.array([r.length for r in rows]), 256) + len(rows) / 100


def test_bounds():
    def fewest(sizes, capacity):
        best = len(sizes)

        def put(i, loads):
            nonlocal best
            if len(loads) >= best:
                return
            if i == len(sizes):
                best = len(loads)
                return
            for k in range(len(loads)):
                if loads[k] + sizes[i] <= capacity:
                    put(i + 1, loads[:k] + [loads[k] + sizes[i]] + loads[k + 1 :])
            put(i + 1, [*loads, sizes[i]])

        put(0, [])
        return best

    for _ in range(60):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 8))])
        n, bound = fewest(sorted(sizes.tolist(), reverse=True), 20), packing.lower_bound(sizes, 20)
        bins, places, loads = packing.best_fit_decreasing(sizes, 20)
        assert math.ceil(sizes.sum() / 20) <= bound <= n <= len(loads) and loads.max() <= 20


def test_urls(spark):
    rows = [(1, "http://A.Example.net/en/x?q"), (2, "https://net/"), (3, "http://x.net"), (4, "http://example.com/de/"), (5, "http://a.org/fr/#t"), (6, "http://xnet/"), (7, None), (8, "no scheme"), (9, "http://a.org/f")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("net", "/", "net/", "block")
    assert got[3] == ("x.net", "", None, "allow") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[6][2] is got[7][2] is got[8][2] is got[9][2] is None and got[7][:2] == got[8][:2] == ("", "")


def test_cascade_is_exact(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = keys[::7]
    frame = lambda k: spark.createDataFrame([(x,) for x in k], "key string")
    levels = urls.cascade(frame(listed), frame(keys))
    assert len(levels) > 1 and all(urls.listed(k, levels) == (k in set(listed)) for k in keys)


def _edited(words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def test_near_classes_are_components_of_all_links(spark):
    made = []
    for size in (6, 18, 30, 70, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            made += [" ".join(base)] + [" ".join(_edited(base, max(0, size // 60 + k - 1))) for k in range(3)]
    shared = " ".join(f"s{i}" for i in range(60))
    made += [f"{shared} " + " ".join(f"u{rng.random()}" for _ in range(60)) for _ in range(50)]  # half in common: not alike
    made += [made[0], made[5], "", " ", "one two"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near.near_classes(df).collect()}
    words = [near._split(t) for t in made]
    known, parent = {}, list(range(len(made)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(made)), 2):
        by_kmers = near.aligned(near.kmers(words[i], known), near.kmers(words[j], known)) >= 0.8
        assert not by_kmers or near.aligned(near._numbers(words[i], known), near._numbers(words[j], known)) >= 0.8
        if made[i] == made[j] or by_kmers:
            parent[root(i)] = root(j)
    for i, j in combinations(range(len(made)), 2):
        if root(i) == root(j):
            assert got[i] == got[j]
        elif got[i] == got[j]:  # linked by words: must be alike in them to something of the class
            assert any(near.aligned(near._numbers(words[i], known), near._numbers(words[k], known)) >= 0.8 for k in got if k != i and got[k] == got[i])
    assert len({got[i] for i in range(96, 146)}) == 50


def test_alignment_is_longest_common_subsequence():
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = [rng.randrange(6) for _ in range(rng.randint(0, 1))]
        b = b or [1]
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        want = row[-1] / (len(a) + len(b) - row[-1])
        got = near.aligned(np.array(a, np.uint64), np.array(b, np.uint64))
        assert abs(got - want) < 1e-12 if want >= 0.8 else got < 0.8


def test_rare_pairs_hold_all_that_share_enough(spark):
    base = [f"w{i}" for i in range(60)]
    made = [" ".join(_edited(base, k % 4)) for k in range(12)]
    got = {(r.a, r.b) for r in near.rare_pairs(spark.createDataFrame([(i, t, i) for i, t in enumerate(made)], "node bigint, text string, label bigint"), 0.8).collect()}
    sets = [set(near.labelled(near.kmers(near._split(t), {})).tolist()) for t in made]
    for i, j in combinations(range(12), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            assert (i, j) in got


def test_sentencepiece(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceBpe(path)
    parts = [" ", "  ", "\n", "a", "the", "é", "<s>", "<0x41>", "▁", "12", " ", "\t", "!!", "日本", "🙂", "aaaa", "aaa", "\x00", "ing", "er", "he", "====", "ll", "ss"]
    every = [t for _, t in texts] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for t, (n, ids_hash, text_hash) in zip(every, pieces._digests(path, every), strict=True):
        ids = sp.encode(t, add_eos=True)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids)
        assert (n, ids_hash, text_hash) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=a>Home</a></nav>
    <div class="sidebar">Side</div><div id="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p>First  para
    with <b>bold</b><br>break.<p>Second &lt;para&gt; <script>var x = "</p>";</script>end<div class="advert">Buy</div><ul><li>One<li>Two</ul>
    <form><input><button>Go</button></form></article><section class="comments"><p>A reader says so many long words here</p></section><footer>(c)</footer>"""
    assert html_text.main_text(page) == "Head & line\nFirst para with bold break.\nSecond <para> end\nOne\nTwo"
    assert [html_text.main_text(x) for x in (None, "", "<p>", "a < b <i>c</i>")] == ["", "", "", "a < b c"]


def test_html_of_the_pages(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html

        want = "\n".join(x for b in re.split(r"</?(?:p|h1)>", article) if (x := " ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split())))
        assert html_text.main_text(r.html) == want


def test_nearest_recall(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    v = np.stack([rows[i] for i in ids])
    got = {}
    for r in queries.QUERIES["op9_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - float(rows[q] @ rows[i])) < 1e-9 for _, i, s in found)
        scores = v @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_passages(spark):
    sentence = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n)) + "."
    passage = " ".join(sentence(10) for _ in range(6))
    line = sentence(40)
    docs = [(1, f"{sentence(12)} {passage} {sentence(9)}"), (2, f"{sentence(5)} {passage.upper()} {sentence(8)}"), (3, f"{sentence(4)}\n{line}"), (4, f"{line}\n{sentence(4)}"), (5, sentence(30)), (6, "Short one.\n" + sentence(5)), (7, "Short one.\n" + sentence(6))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    cut = {(r.id, dict(docs)[r.id][r.start : r.end], r.kept_id) for r in got}
    assert cut == {(2, passage.upper(), 1), (4, line, 3)}
    left = {r.doc_id: r.text for r in passages.remove_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert left[5] == docs[4][1] and left[4] == docs[3][1].split("\n")[1] and passage.upper() not in left[2] and left[7] == docs[6][1]


def test_lm(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op1_lm_scoring"](spark, sf).collect()}
    counts = Counter()
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update([*r.text.encode().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    out = [0, 0.0, 0.0]
    for r in docs:
        words, g = [*r.text.encode().split(), b"\n"], got[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n) and abs(g.base_score - base) < 1e-6 * abs(base)
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if g.held_out:
            out = [out[0] + len(words), out[1] + base, out[2] + g.score]
    assert out[2] / out[0] > out[1] / out[0] + 0.1  # log10 a token, on held-out texts


def test_lm_probabilities_sum_to_one():
    weights = np.random.default_rng(1).normal(size=(lm.ROWS, lm.WIDTH)).astype(np.float32)
    total = sum(10 ** lm.log_probabilities(weights, np.array([3, 700, s]), np.array([0]))[2] for s in range(lm.SLOTS))
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("name", queries.ORACLE)
def test_sql_equality(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and kept.count() <= before.count()
    texts = [r.text for r in kept.collect()]
    assert texts and len(set(texts)) == len(texts)
    assert not any(secrets.base_spans(t) for t in texts)
    packed = corpus_pipeline.STAGES[4][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == len(texts)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
