"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, html_text, lm, near, packing, passages, pieces, quality, secrets, urls

LONG = " ".join(f"word{i % 977} of the long text." for i in range(30_000))
GOOD = "The old house of the family was on a hill, and from it one could see that the river is wide at this place. It was quiet.\nBirds were in the trees."
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, GOOD), (5, GOOD), (6, GOOD), (None, "Some text of a row without an id, password=abcdef1234."), (7, "a"), (8, "a"), (9, None)]
CLASHES = "n_words n_tokens n_known score base_score quality secrets ids removed offset sequence_id piece start node label bucket class_id words key rank text_a html2".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def scored(docs):
    training = docs.where(~lm.held_out("doc_id"))
    vocabulary, words = lm.learn_vocabulary(training)
    return lm.score(docs, vocabulary, words, lm.train(training, vocabulary))


PER_ROW = {
    "lm": scored,
    "quality": quality.judge,
    "secrets": secrets.find_secrets,
    "redact": secrets.redact,
    "near": near.near_classes,
    "sentencepiece": lambda d: pieces.round_trip(pieces.encode(d, MODEL, out="piece_ids"), MODEL),
    "passages": passages.remove_passages,
    "html": lambda d: html_text.extract(d.withColumnRenamed("text", "html")),
    "urls": lambda d: urls.filter_urls(d.withColumnRenamed("text", "url")),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_gets_its_result(docs, name):
    out = PER_ROW[name](docs)
    ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    assert ids == sorted((i for i, _ in ROWS), key=str)
    assert len(set(out.columns)) == len(out.columns)
    assert PER_ROW[name](docs.limit(0)).count() == 0


def test_packing(docs):
    cut = packing.pieces(docs, BPE)
    rows = packing.pack(cut).collect()
    assert sorted((r.doc_id for r in rows if r.piece == 0), key=str) == sorted((i for i, _ in ROWS), key=str)
    assert sum(r.length for r in rows if r.doc_id in (1, 2, 9)) == 3  # the end id alone
    assert packing.pack(packing.pieces(docs.limit(0), BPE)).count() == 0


def test_keep_one(docs):
    kept = sorted((r.doc_id for r in near.keep_one(docs).select("doc_id").collect()), key=str)
    assert kept == sorted([1, 3, 4, 5, None, 7], key=str)  # null and empty texts are one class


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, [0.5, 0.5]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 0.5), (0, 2, 7, 0.5), (0, 3, 20, -1.0), (20, 1, 6, -0.5), (20, 2, 7, -0.5), (20, 3, 0, -1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, k):
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, docs, "")
    out.collect()
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), "").count() == 0
