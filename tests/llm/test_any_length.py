"""Texts and pages of any length are judged by the same rules, in time that follows their length."""

import time

import pytest

from tidemark.llm import html_text, quality

DISTINCT = [r[0] for r in quality.RULES].index("distinct")


@pytest.mark.parametrize("different, vote", [(301, 2), (20, 0)])
def test_distinct_words_vote_alike_at_any_length(different, vote):
    for n in (400, 1999, 2000, 20_000):
        ((*_, votes),) = quality.signals([" ".join(f"w{i % different}" for i in range(n))])
        assert votes // 3**DISTINCT % 3 == vote, n


K = 100_000


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div>" * K + "x" + "</p>" * K, "x"),
        ("<b>" * K + "<hr>" * K + "x", "x"),
        ("<ul><li>" + "<b>" * K + "<li>x</li>" * K, "\n".join("x" * K)),
        ("<td>" + "<b>" * K + "<hr>x" * K, "x" * K),
    ],
)
def test_deep_and_broken_pages_take_linear_time(page, text):
    start = time.perf_counter()
    assert html_text.main_text(page) == text
    assert time.perf_counter() - start < 60  # in the square of K it would be hours
