"""Substring dedup against windows of words, and in cases made for it."""

import random
import re

import pytest

from tidemark.llm import passages

rng = random.Random(5)
WORD = re.compile(r"\S+")


def _prose(n, ends=True):
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    return " ".join(w + "." if ends and k % 10 == 9 else w for k, w in enumerate(words))


def _found(spark, docs, **options):
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string"), **options).collect()
    return sorted((r.id, r.start, r.end, r.words, r.kept_id, r.kept_start) for r in rows)


def _stays(docs, found):
    """Words in windows of 25 that a document of smaller id has, and how many of them were not found."""
    seen, every, left = set(), 0, 0
    for i, text in sorted(docs):
        places = list(WORD.finditer(text or ""))
        words = [m[0].lower() for m in places]
        hashes = [hash(tuple(words[k : k + 25])) for k in range(len(words) - 24)]
        marked = {j for k, h in enumerate(hashes) if h in seen for j in range(k, k + 25)}
        seen.update(hashes)
        cut = {j for j, m in enumerate(places) if any(r[1] <= m.start() < r[2] for r in found.get(i, ()))}
        every, left = every + len(marked), left + len(marked - cut)
    return every, left


def test_words_of_earlier_windows_go(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    texts, found = dict(docs), {}
    for r in passages.repeated_passages(df).collect():
        cut = texts[r.id][r.start : r.end].lower().split()
        assert len(cut) == r.words >= 25 and (r.kept_id, r.kept_start) < (r.id, r.start)
        assert texts[r.kept_id][r.kept_start :].lower().split(maxsplit=1)[0] == cut[0]
        found.setdefault(r.id, []).append((r.id, r.start, r.end))
    every, left = _stays(docs, found)
    assert every > 40_000 and left <= 0.03 * every


@pytest.mark.parametrize("ends", [True, False])
def test_passages_that_start_and_end_inside_sentences(spark, ends):
    passage = _prose(300, ends)
    docs = [(k, f"{_prose(13, False)} {passage} {_prose(7, False)}") for k in range(4)]
    got = _found(spark, docs)
    assert [(i, docs[i][1][s:e], n, k, docs[0][1][p:].startswith(passage)) for i, s, e, n, k, p in got] == [(i, passage, 300, 0, True) for i in (1, 2, 3)]


def test_a_passage_across_lines_is_one_stretch(spark):
    lines = "\n".join(_prose(8) for _ in range(6))
    docs = [(1, f"{_prose(3)} {lines}"), (2, f"{_prose(4)} {lines} {_prose(2)}")]
    [(i, s, e, n, k, p)] = _found(spark, docs)
    assert (i, n, k) == (2, 48, 1) and docs[1][1][s:e] == lines and docs[0][1][p:] == lines


def test_parts_are_told_by_words_not_by_case_or_white_space():
    words = [f"Wort{rng.randrange(10**6)}" for _ in range(60)]
    a, b = " ".join(words), "\u00a0 ".join(w.upper() for w in words[:20]) + "\t" + " \t".join(words[20:])
    one, two = passages.units_of(a), passages.units_of(b)
    assert [c.tolist() for c in (one[0], *one[3:])] == [c.tolist() for c in (two[0], *two[3:])]
    assert passages.lower("\u0130A\u00df") == "\u0130a\u00df" and all(len(c) == 0 for t in ("", " \n ") for c in passages.units_of(t))


def test_short_lines_go_if_asked(spark):
    docs = [(1, "Yes.\nAll rights are kept.\n" + _prose(5)), (2, _prose(5) + "\nall  rights ARE kept.\nYes."), (3, "Yes. " + _prose(4))]
    assert _found(spark, docs) == []
    assert [(i, docs[i - 1][1][s:e]) for i, s, e, *_ in _found(spark, docs, least_line=1)] == [(2, "all  rights ARE kept.\nYes.")]
    assert [(i, docs[i - 1][1][s:e]) for i, s, e, *_ in _found(spark, docs, least_line=3)] == [(2, "all  rights ARE kept.")]


def test_repeats_within_a_text_equal_rows_and_nulls(spark):
    passage = _prose(40)
    docs = [(None, passage), (1, f"{passage}\n{_prose(4)}\n{passage}\n{passage}"), (1, f"{passage} a"), (2, None), (2, ""), (3, "x " * 60)]
    docs += [docs[1]]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    own = {(r.id, r.words) for r in rows}
    assert {(1, 40), (1, 80)} <= own and all(r.kept_id is None for r in rows if r.id == 1) and None not in {i for i, _ in own}
    left = passages.remove_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(left) == len(docs) and [r.text for r in left if r.doc_id is None] == [passage]
