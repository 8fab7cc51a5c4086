"""Secret scans: fixed patterns, and the guess cost of values that stand in a credential's place.

A value after a credential word is cut into dictionary words, dates, repeats, keyboard walks and brute-force spans such
that the product of their guesses is least (dynamic programming over its characters); one that still costs many
guesses is reported as kind guess, unless a span of another kind has all of it; where such a span ends inside the
value, both are reported. Names may go on (SECRET_KEY, token_id) or begin earlier (userpwd), and
a scheme may stand before the value (Bearer eyJ...); joined by white space only, after a scheme or a dashed name, and where
the credential word may be the end of another word (compass), values that read as prose are left. Dictionary words are the corpus's most frequent ones, ranked over all texts.

Spans are in code points, end exclusive. Null and empty texts have none. Whole texts are searched, however long.
Repeated rows are scanned one by one. Columns of the input that carry the name of a result column give way to it.
"""

from __future__ import annotations

import math
import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text
from tidemark.llm.words import count_words, most_frequent

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a value counts as a credential's: more words, names and ways to join them than ASSIGN has. A match is the word
#: alone, what joins it to the value is looked ahead at, so that no context hides another.
CONTEXT = re.compile(
    r"""(?P<word>pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_\x20-]?key|(?:access|private)[_\x20-]?key|credentials?|auth(?:orization)?|bearer|basic|login)(?="""
    r"""(?:(?P<known>(?:[_-]?(?:key|id|value)){0,3})(?P<name>(?:_[A-Za-z0-9]{1,32}){0,4})(?P<dashed>(?:[_-][A-Za-z0-9]{1,32}){0,4})"""
    r"""["']?(?:\s*(?::=|=>|->|[:=])|\s+(?:is|was)\b:?)\s*["']?(?P<scheme>(?:bearer|basic|token|digest)\s+["']?)?"""
    r"""|(?:(?<=bearer)|(?<=basic)|(?<=token))(?P<plain>\s+["']?))(?P<end>))""",
    re.I | re.A,
)
VALUE = re.compile(r"""[^\s"'<>,;]{6,}""", re.A)
LEAST_VALUE, LONGEST_PROSE = 6, 200
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "basic", "login")
#: Words that are parts of other words, too.
PARTS = ("pass", "auth", "bearer", "basic", "login")
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 10.0
#: Words in the dictionary: the most frequent of the corpus.
WORDS = 20_000
LONGEST_WORD = 24
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
# The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
_NEXT_KEYS = {a + b for r in ROWS for x in (r, r[::-1]) for a, b in zip(x, x[1:], strict=False)}
_HEX_BYTES = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_SEGMENT = math.log10(2)


def guess_cost(value: str, ranks: dict[str, int]) -> float:
    """log10 of the least product of guesses over all cuts of value into known kinds of spans.

    A word costs its rank (twice that with a capital), a date 365 times 120 years, a repeat its character times its
    length, a walk 40 starts times two ways times its length, any other character its alphabet. Each span doubles the
    total. Repeats have three characters or more, walks four.

    Nothing but a word or a date is worth ending inside a repeat or a walk: one more character adds at most log10(4/3)
    to its cost, and ten or more times that to a brute-force span; two of a kind cost less as one; and a repeat and a
    walk share at most a character. So a repeat or walk starts within LONGEST_WORD characters of where it could first.
    """
    n, low = len(value), "".join(x if len(x := c.lower()) == 1 else c for c in value)
    best = [0.0] + [math.inf] * n
    brute = [math.inf] * (n + 1)  # the last span is a brute-force one
    run = walk = 1
    dates: dict[int, list[int]] = {}
    for i in range(n):
        if low[i].isdigit() and (m := DATE.match(value, i)):
            dates.setdefault(m.end(), []).append(i)
    for i in range(1, n + 1):
        c = value[i - 1]
        letters = math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)
        brute[i] = min(brute[i - 1], best[i - 1] + _SEGMENT) + letters
        cost = brute[i]
        run = run + 1 if i > 1 and low[i - 1] == low[i - 2] else 1
        walk = walk + 1 if i > 1 and low[i - 2 : i] in _NEXT_KEYS else 1
        if run >= 3:
            cost = min(cost, min(best[i - k] + math.log10(k) for k in range(max(3, run - LONGEST_WORD), run + 1)) + letters + _SEGMENT)
        if walk >= 4:
            cost = min(cost, min(best[i - k] + math.log10(40 * 2 * k) for k in range(max(4, walk - LONGEST_WORD), walk + 1)) + _SEGMENT)
        for j in range(max(0, i - LONGEST_WORD), i - 2):
            if (rank := ranks.get(low[j:i])) is not None:
                cost = min(cost, best[j] + math.log10(rank + 1) + (_SEGMENT if value[j:i] != low[j:i] else 0) + _SEGMENT)
        for j in dates.get(i, ()):
            cost = min(cost, best[j] + math.log10(365 * 120) + _SEGMENT)
        best[i] = cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind's number) of the fixed patterns. Cheap tests come first; they pass whatever can match."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def reads_as_prose(value: str) -> bool:
    """Whether value is words of ordinary length and case, with what stands around and between words."""
    if not all(c.isalpha() or c in "-'.:/()[]!?*’…–—“”„" for c in value):
        return False
    words = re.findall(r"[^\W\d_]+", value)
    return all(len(w) <= LONGEST_WORD and (w == w.upper() or w[1:] == w[1:].lower()) for w in words)


def context_values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential's place, in order. Where the place is less sure, none that reads as prose."""
    out, last = [], -1
    for m in CONTEXT.finditer(text):
        a = m.end("end")
        if a < last:  # inside the value before, which ends where this one does
            b = last
        elif (v := VALUE.match(text, a)) is not None:
            b = last = v.end()
        else:
            continue
        if b - a < LEAST_VALUE:
            continue
        inside = m.start() > 0 and text[m.start() - 1].isascii() and text[m.start() - 1].isalpha() and m["word"].lower() in PARTS
        unsure = inside or m["plain"] or m["scheme"] or m["dashed"] or m["word"].lower() == "basic"
        if not (unsure and b - a <= LONGEST_PROSE and reads_as_prose(text[a:b])):
            out.append((a, b))
    return sorted(set(out))


def spans_of(texts: list[str | None], ranks: dict[str, int], least: float) -> list[tuple]:
    out = []
    for t in texts:
        t = t or ""
        found = base_spans(t)
        low = t.lower()
        if any(h in low for h in HINTS):
            for a, b in context_values(t):
                if not any(x <= a and b <= y for x, y, _ in found) and guess_cost(t[a:b], ranks) >= least:
                    found.append((a, b, 3))
        out.append(([(KINDS[k], a, b) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))],))
    return out


_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _letter_words(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if 3 <= len(w) <= LONGEST_WORD]


def dictionary(docs: DataFrame, text: str = "text", most: int = WORDS) -> dict[str, int]:
    """Ranks from 1 of the most frequent words of all texts; a word is 3 to LONGEST_WORD bytes of letters, in lower case."""
    words = count_words(docs.select(F.col(text).cast("string")), _letter_words)
    return {w.decode("utf-8", "replace"): i for i, (w, _) in enumerate(most_frequent(words, most), 1)}


def find_secrets(docs: DataFrame, text: str = "text", least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None, out: str = "secrets") -> DataFrame:
    """docs with a column of spans (kind, start, end), by start and then in the order of KINDS; empty if none.

    ranks: the dictionary, of bounded size; learnt from docs if None.
    """
    ranks = dictionary(docs, text) if ranks is None else ranks
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # at most WORDS entries of LONGEST_WORD bytes
    return per_text(docs, f"`{out}` {SPANS}", partial(_spans, held, least_cost), text)


def _spans(held, least: float, texts: list[str | None]) -> list[tuple]:
    return spans_of(texts, held.value, least)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least_cost: float = LEAST_COST, ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with every secret's characters replaced by mark; spans that overlap or touch share one mark. Null stays null."""
    ranks = dictionary(docs, text) if ranks is None else ranks
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    return per_text(docs, f"`{text}` string", partial(_redacted, held, least_cost, mark), text).select(*[F.col(f"`{c}`") for c in docs.columns])


def _redacted(held, least: float, mark: str, texts: list[str | None]) -> list[tuple]:
    out = []
    for t, (spans,) in zip(texts, spans_of(texts, held.value, least), strict=True):
        parts, at = [], -1
        for _, a, b in spans:
            if a > at:
                parts += [t[max(at, 0) : a], mark]
            at = max(at, b)
        out.append((t if at < 0 else "".join(parts) + t[at:],))
    return out


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).drop("text")
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "guess")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))
