"""Quality classifier, tokenizer alignment and filter audit against plain versions, and in odd cases."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import align, audit, classifier
from tidemark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} of the long text." for i in range(30_000))
ODD = [None, "", " ", "\n", "a", "a", "a  b", "▁x", "x▁ y", "<|endoftext|> is text", "</s> <s>", "日本語 text here", "tab\tand\r\nline", "émoji 😀😀", "\x00zero", LONG]


# -- alignment ------------------------------------------------------------------------------------


def plain_alignment(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest), token by token with the tokenizers' own libraries."""
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        spelt = {int(n): base64.b64decode(t) for t, n in map(bytes.split, f)}
    seen, links = [], Counter()
    for doc_id, t in rows:
        t = t or ""
        ia, ib = first.encode(" " + t, add_special_tokens=False).ids, second.encode(t)
        ba = [spelt[i] for i in ia]
        bb = [bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if not t or not b"".join(ba) == b"".join(bb) == (" " + t).encode():
            seen.append((doc_id, 0, 0, [], []))
            continue
        ends_a = {e: i for i, e in enumerate(itertools.accumulate(map(len, ba)))}
        ends_b = {e: i for i, e in enumerate(itertools.accumulate(map(len, bb)))}
        mine, groups, x, y = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            i, j = ends_a[e], ends_b[e]
            mine.append((ia[i], ib[j]))
            groups.append(",".join(map(str, ia[x : i + 1])) + "|" + ",".join(map(str, ib[y : j + 1])))
            x, y = i + 1, j + 1
        links.update(mine)
        seen.append((doc_id, len(ia), len(ib), groups, mine))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, na, nb, len(g), len(m), sum(links[p] == best[p[1]] for p in m), sum(links[p] for p in m), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, m in seen]


MEASURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [align.HEAD, 40, 0])
def test_alignment_token_by_token(spark, head):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += list(enumerate(ODD, 1000)) + [(None, "a"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit("clash")).withColumn("n", F.lit("kept")).withColumn("digest", F.lit("kept"))
    got = align.align_corpus(df, A, B, head=head)
    assert {"n", "digest", "text"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*MEASURES).collect()))) == sorted(map(repr, plain_alignment(rows)))


def test_alignment_of_copies_and_of_nothing(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(300)] + [(7, None)] * 200
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = align.align_corpus(df, A, B).select(*MEASURES).collect()
    assert sorted(map(tuple, got)) == sorted(plain_alignment(rows))
    assert align.align_corpus(df.limit(0), A, B).count() == 0


# -- classifier -----------------------------------------------------------------------------------


def test_word_vectors_word_by_word(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd! Efg 12 é".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "?"]
    index, want, counts = classifier.index_vectors(), {}, Counter()
    row = lambda w: zlib.crc32(w.encode()) % classifier.ROWS
    for t in texts:
        words = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", t or "")
        for i, w in enumerate(words):
            near = [j for j in range(i - 2, i + 3) if j != i and 0 <= j < len(words)]
            want[row(w)] = want.get(row(w), 0) + sum((index[row(words[j])].astype(int) for j in near), np.zeros(classifier.DIMS, int))
            counts[row(w)] += 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r["row"]: (r["n"], classifier._unpacked(bytes(r["vector"])).tolist()) for r in classifier.word_table(df).collect()}
    assert got == {k: (counts[k], v.tolist()) for k, v in want.items()}


def scores(spark, df, labels, **more):
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return {r.doc_id: r.score for r in classifier.classify(df, labels, learn, **more).select("doc_id", "score").collect()}


def test_held_out_quality(spark):
    got = QUERIES["op11_quality_classifier"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.98 * len(good) * len(bad)
    assert sum(s < classifier.GOOD for s in good) <= 0.03 * len(good)
    assert all(0 <= s <= 1 for s in good + bad) and all(r.predicted == (r.score >= 0.3) for r in got)


def test_scores_need_nothing_but_texts_and_learnt_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    base = scores(spark, docs, labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")).withColumn("score", F.lit("clash"))
    assert scores(spark, changed.repartition(7), other) == base


def test_classifier_in_odd_cases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(4, "again"), (None, "a")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert set(scores(spark, docs, none).values()) == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, None), (None, 1), (5, 0)], "doc_id bigint, quality int")
    got = classifier.classify(docs, labels, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert len(set(scores(spark, docs, labels, most=3).values())) > 0
    assert classifier.classify(docs.limit(0), labels, F.lit(True)).count() == 0


def test_temperature_makes_probabilities():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 5))
    y = (r.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = classifier.fit(x, y, np.arange(4000) % 4 == 0)
    p = net.probabilities(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.06


# -- audit ----------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Every order walked through, document by document."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {f for f, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and first[t] < d), strict=True) if bad}
        parts.setdefault(lang or "", []).append((failed, d in good, d in toxic))
    rows, shapley = [], Counter()
    for part, mine in parts.items():
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = sum(f in x[0] for x in mine)
                shapley[part, f] += len(gone)
                rows.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


REPORT = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_document_by_document(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["BIG", "#tag", "a*b"]
    made = [" ".join(rng.choices(vocabulary[: rng.choice([40, 400])] + vocabulary[-3:] * rng.choice([0, 5]), k=rng.choice([3, 99, 100, 160]))) for _ in range(40)]
    docs = [(i, rng.choice(made + ODD), rng.choice(["en", "de", None, ""])) for i in range(300)] + [(None, made[0], "en"), (None, made[0], "en"), (1, made[1], "fr"), (1, made[1], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("part", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("failed", F.lit(1))
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash")))
    assert sorted(map(tuple, got.select(*REPORT).collect())) == plain_audit(docs, labels)
    assert audit.audit(df.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_audit_equals_sql(spark):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    want = connection.sql(f"SELECT {', '.join(REPORT)} FROM ({ORACLE['op13_filter_audit']})").fetchall()
    got = [tuple(r) for r in QUERIES["op13_filter_audit"](spark, SF).select(*REPORT).collect()]
    assert sorted(got) == sorted(want) and got


def test_shapley_values_share_out_what_all_filters_remove(spark):
    counts = spark.createDataFrame([("p", 1, False, False, 5), ("p", 3, True, False, 4), ("p", 6, False, True, 2), ("p", 0, True, False, 9)], "part string, failed int, good boolean, toxic boolean, n bigint")
    rows = audit.interactions(counts, "xyz").collect()
    assert len(rows) == 18 and {r.shapley for r in rows if r.filter_order[r.step - 1] == "x"} == {6 * 5 + 3 * 4}
    assert sum(r.shapley for r in rows if r.filter_order == "xyz") == 6 * (5 + 4 + 2)
