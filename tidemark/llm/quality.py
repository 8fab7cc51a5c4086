"""Quality rules by weak supervision.

Each rule votes on a text: good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of all vote
patterns of the corpus estimates how often either kind of text gets each vote, without labels, and the posterior
probability that a text is good replaces an all-must-pass filter.

Two passes over the texts: one counts patterns (at most 3^rules rows, whatever the corpus), one judges. Nothing but
pattern counts leaves the executors.

Measures are shares, so that a text of any length is judged by the same rules; distinct words are counted in stretches
of DISTINCT_IN words, over all of the text, and added up. Null texts have no words; empty and null texts fail the base rule. Repeated rows are judged alike, one by one. An
empty table gives an empty result. Columns of the input that carry the name of a result column give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent words of the four languages of the corpus.
STOP_WORDS = frozenset(
    b"the of and to in a is that it for on was be with as by this are from at "
    b"de la que el en los un se con para las le les des et est une du qui dans pour "
    b"der die und den von zu das ist nicht ein eine mit auf".split()
)
#: (name, lowest good, highest good, below: bad, above: bad) of a measure; between good and bad a rule abstains.
RULES = (
    ("length", 40, math.inf, 20, math.inf),
    ("word_length", 3.0, 9.0, 2.0, 14.0),
    ("symbols", 0.0, 0.02, -math.inf, 0.15),
    ("dup_lines", 0.0, 0.1, -math.inf, 0.3),
    ("repeats", 0.0, 0.1, -math.inf, 0.3),
    ("letters", 0.85, 1.0, 0.7, math.inf),
    ("capitals", 0.0, 0.15, -math.inf, 0.4),
    ("stop_words", 0.08, 0.6, 0.01, 0.9),
    ("distinct", 0.3, 1.0, 0.15, math.inf),
    ("endings", 0.5, 1.0, 0.05, math.inf),
)
SIGNALS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, votes int"
WINDOW = 8
#: Words of a stretch in which distinct ones are counted, so that the measure means the same in texts of any length.
DISTINCT_IN = 200
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())
_NOT_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)


def repeat_words(docs: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each document the words in windows of so many words that occur twice or more in it.

    Windows are compared by 64-bit polynomial hashes of random word numbers; the chance that any two of a slice
    of a million windows collide is under 1e-7.
    """
    known: dict[bytes, int] = {}
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    out = np.zeros(len(docs), np.int64)
    n = int(lengths.sum())
    if n < window:
        return out.tolist()
    ids = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64, n)
    noise = np.random.default_rng(7).integers(0, 2**64, len(known), np.uint64)
    h, step, power = noise[ids], 1, _ODD
    with np.errstate(over="ignore"):
        while step < window:
            h = h[:-step] + power * h[step:]
            power, step = power * power, 2 * step
        doc = np.repeat(np.arange(len(docs)), lengths)
        first = doc[: len(h)]
        inside = first == doc[window - 1 :]
        h = (h + first.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))[inside]
    at = np.flatnonzero(inside)
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        twice = np.unique(twice)
        place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        hit = at[twice[place] == h]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        np.add.at(out, doc, np.cumsum(edge[:-1]) > 0)
    return out.tolist()


def signals(texts: list[str | None]) -> list[tuple]:
    """SIGNALS of each text. votes: a base-3 number, digit i being 1 + the vote of rule i."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words = [r.split() for r in raw]
    out = []
    for t, r, ws, rep in zip(texts, raw, words, repeat_words(words), strict=True):
        t, n = t or "", len(ws)
        chars = len(t) - sum(t.count(c) for c in WHITE)
        symbols = sum(t.count(c) for c in SYMBOLS)
        lines = [x for x in t.split("\n") if x.strip(WHITE)]
        dups = len(lines) - len(set(lines))
        if n:
            solid = sum(map(len, ws))
            letters = len(r.translate(None, _NOT_LETTERS))
            ends = sum(x.rstrip(WHITE)[-1] in ".!?\"'”»)" and x.rstrip(WHITE)[-2:] != "!!" for x in lines)
            measures = (n, chars / n, symbols / n, dups / len(lines), rep / n, letters / solid, len(r.translate(None, _NOT_CAPITALS)) / max(letters, 1),
                        sum(map(STOP_WORDS.__contains__, ws)) / n, sum(len(set(ws[i : i + DISTINCT_IN])) for i in range(0, n, DISTINCT_IN)) / n, ends / len(lines))
        else:
            measures = (0,) * len(RULES)
        votes = 0
        for m, (_, low, high, below, above) in zip(reversed(measures), reversed(RULES), strict=True):
            votes = votes * 3 + (2 if low <= m <= high else 0 if m < below or m > above else 1)
        out.append((n, chars, symbols, dups, rep, votes))
    return out


@dataclass(frozen=True)
class Model:
    """log_odds: of good against bad, before any vote. weights[rule][1 + vote]: what a vote adds to them."""

    log_odds: float
    weights: tuple[tuple[float, float, float], ...]

    def posterior(self, votes: Column) -> Column:
        """Probability that a text with these votes is good."""
        total, rest = F.lit(self.log_odds), votes
        for w in self.weights:
            digit = rest % 3
            total = total + F.when(digit == 0, w[0]).when(digit == 1, w[1]).otherwise(w[2])
            rest = F.floor(rest / 3)
        return 1 / (1 + F.exp(-total))


def fit(counts: dict[int, int], rules: int = len(RULES), rounds: int = 100) -> Model:
    """EM for votes that are independent given the kind of text; it starts from the majority of the votes.

    counts: texts of each vote pattern. Every vote keeps a pseudo-count of one. Of the two kinds that EM finds, good
    stays the one whose texts got the better votes at the start; a vote for good never counts against it.
    """
    if not counts:
        return Model(0.0, tuple((-1.0, 0.0, 1.0) for _ in range(rules)))
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes = np.array([[p // 3**i % 3 for i in range(rules)] for p in patterns])
    one_hot = votes[:, :, None] == np.arange(3)
    good = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(1)))
    for _ in range(rounds):
        odds, logs = [], []
        for p in (good, 1 - good):
            mass = n * p
            table = np.einsum("p,prv->rv", mass, one_hot) + 1
            logs.append(np.log(table / table.sum(1, keepdims=True)))
            odds.append(math.log(mass.sum() + 1))
        weights = logs[0] - logs[1]
        weights[:, 0] = np.minimum(weights[:, 0], 0)
        weights[:, 2] = np.maximum(weights[:, 2], 0)
        prior = odds[0] - odds[1]
        now = 1 / (1 + np.exp(-np.clip(prior + np.take_along_axis(weights[None], votes[:, :, None], 2)[:, :, 0].sum(1), -50, 50)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return Model(float(prior), tuple(tuple(map(float, w)) for w in weights))


def _base_failed(words: str, repeats: str) -> Column:
    return (F.col(words) < 20) | (100 * F.col(repeats) > 30 * F.col(words))


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all texts of docs but those that fail the base rule: they need no model, and would be its bad kind."""
    seen = per_text(docs, SIGNALS, signals, text, keep=[])
    found = seen.where(~_base_failed("n_words", "n_repeat_words")).groupBy("votes").count().collect()  # at most 3^rules rows
    return fit({r["votes"]: r["count"] for r in found})


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, model: Model | None = None) -> DataFrame:
    """docs with a column quality: the signals, the posterior (good), base_failed and kept.

    A text is kept if it doesn't fail the base rule (20 words or more, at most 30 % of them in repeated windows) and
    its posterior reaches the threshold.
    """
    model = model or train(docs, text)
    rest = [c for c in docs.columns if c.lower() != "quality"]
    # the signals under names of their own, as docs may have columns of theirs
    own = {f"_q_{c.split()[0]}": c.split() for c in SIGNALS.split(", ")}
    seen = per_text(docs, ", ".join(f"{k} {c[1]}" for k, c in own.items()), signals, text, keep=rest)
    failed, good = _base_failed("_q_n_words", "_q_n_repeat_words"), model.posterior(F.col("_q_votes"))
    quality = F.struct(*[F.col(k).alias(c[0]) for k, c in own.items()], failed.alias("base_failed"), good.alias("good"), (~failed & (good >= threshold)).alias("kept"))
    return seen.select(*[F.col(f"`{c}`") for c in rest], quality.alias("quality"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs.select("doc_id", "text")).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good")])
