"""How filters of documents interact: what each removes in every order, and its Shapley value by the potential.

A document's failing filters are a set, so each part of the corpus comes down to counts of at most 2^k sets. In the
removal game a coalition of filters is worth the documents that fail at least one of them. The Hart-Mas-Colell potential
of a coalition is its worth plus the potentials of the coalitions with one filter less, divided by its size; a filter's
Shapley value is the potential of all filters minus that without it. What a filter removes at a step of an order is the
worth with it minus the worth of the filters before it.

Null texts count as empty. A document fails filter E if the same text has a smaller doc_id anywhere in the table; a null
doc_id is neither smaller nor larger than another, and rows that share the least doc_id of a text pass. Long texts are read whole. Repeated
rows count one by one. A document without a label counts as neither good nor toxic; of several labels of a doc_id the
larger counts. An empty table has no parts and gives no rows. Columns besides doc_id, text and lang are not looked at, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text

FILTERS = "ABCDE"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
#: The filter that compares texts with each other; the others look at one text.
COPIES = 1 << FILTERS.index("E")


def _failures(texts: list[str | None]) -> list[tuple]:
    """For each text the filters A to D that it fails, as bits, and its digest."""
    out = []
    for t in texts:
        t = t or ""
        b = t.encode()
        words = b.split()  # of bytes: at space and 0x09 to 0x0d
        n = len(words)
        failed = n < 100
        failed |= (100 * len(set(words)) < 80 * n) << 1
        failed |= (100 * (len(b) - len(b.translate(None, _CAPITALS))) > 10 * len(t)) << 2
        failed |= (_MARKS.search(b) is not None) << 3
        out.append((int(failed), hashlib.sha256(b).digest()))
    return out


def failed_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (part, failed, good, toxic, n) of docs(doc_id, text, lang); failed: the filters A to E as bits 0 to 4.

    Texts are read once and leave the task as digests. Rows are counted before each shuffle, so copies of one text or
    rows of one doc_id reach a reducer as one row a task.
    """
    rows = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    seen = per_text(rows, "failed int, digest binary", _failures, keep=["doc_id", "part"])
    counted = seen.groupBy("doc_id", "part", "failed", "digest").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")])
    # rows without an id have no label: a key of their own each keeps them from meeting in one task
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.hex("digest"), "part"))
    labelled = counted.withColumn("_key", key).join(marks.withColumn("_key", F.col("_id").cast("string")), "_key", "left")
    known = labelled.select("doc_id", "part", "failed", "digest", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")])
    # of rows alike but for their id only the number at the least id matters, as all others are copies
    alike = known.groupBy("digest", "part", "failed", "quality", "toxic", F.col("doc_id").isNull().alias("unnamed")).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", F.col("n").alias("times"))).alias("first")
    )
    # at most a few rows a part and text
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    originals = F.when(F.col("unnamed"), F.col("n")).when(F.col("first.doc_id") == least, F.col("first.times")).otherwise(F.lit(0))
    split = alike.withColumn("originals", originals)
    both = F.inline(
        F.array(
            F.struct(F.col("failed"), F.col("originals").alias("n")),
            F.struct(F.col("failed").bitwiseOR(F.lit(COPIES)).alias("failed"), (F.col("n") - F.col("originals")).alias("n")),
        )
    )
    rows = split.select("part", "quality", "toxic", both).where("n > 0")
    return rows.groupBy("part", "failed", F.col("quality").alias("good"), "toxic").agg(F.sum("n").alias("n"))


def _worths(entries: Column, weight: str, coalitions: int) -> Column:
    """For each coalition the documents, by a weight, that fail one of its filters."""

    def worth(s: Column) -> Column:
        return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["failed"].bitwiseAND(s) != 0, e[weight]).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(coalitions - 1)), worth)


def _with_potentials(games: DataFrame, k: int) -> DataFrame:
    """Adds p0, p1, ...: k! times each coalition's potential, a whole number as the denominators divide lcm(1..k).

    Coalitions of one size are a projection of their own over those of the size below.
    """
    out = games.withColumn("p0", F.lit(0).cast("bigint"))
    for size in range(1, k + 1):
        level = {}
        for s in range(1 << k):
            if s.bit_count() == size:
                below = " + ".join(f"p{s ^ (1 << i)}" for i in range(k) if s >> i & 1)
                level[f"p{s}"] = F.expr(f"({factorial(k)} * worth[{s}] + {below}) div {size}")
        out = out.withColumns(level)
    return out


def interactions(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """The report of counts (part, failed, good, toxic, n): a row for every part, order of the filters and step.

    letters: a name for each bit of failed. shapley: k! times the Shapley value. Nothing but 2^k counts a part is kept
    together.
    """
    k = len(letters)
    bits = {f: 1 << i for i, f in enumerate(letters)}
    sums = counts.groupBy("part", "failed").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    )
    sets = sums.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"), F.sum("n").alias("total"))
    games = sets.select(
        "part", "total", "sets", *[_worths(F.col("sets"), w, 1 << k).alias(a) for w, a in (("n", "worth"), ("good", "good_worth"), ("toxic", "toxic_worth"))]
    )
    full = (1 << k) - 1
    valued = _with_potentials(games, k).select(
        "part", "total", "worth", "good_worth", "toxic_worth",
        F.transform(F.array(*[F.lit(b) for b in bits.values()]), lambda b: F.aggregate("sets", F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["failed"] == b, e["n"]).otherwise(0))).alias("alone"),
        F.array(*[F.col("worth")[b] for b in bits.values()]).alias("each"),
        F.array(*[F.col(f"p{full}") - F.col(f"p{full ^ b}") for b in bits.values()]).alias("shapleys"),
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = valued.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = {f: F.instr("filter_order", f) for f in letters}

    def members(last: Column) -> Column:
        return sum((F.when(place[f] <= last, bits[f]).otherwise(0) for f in letters), F.lit(0))

    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    placed = steps.select("*", members(F.col("step") - 1).alias("before"), members(F.col("step")).alias("after"), (F.instr(F.lit(letters), letter) - 1).alias("f"))

    def gain(worths: str) -> Column:
        return F.get(worths, F.col("after")) - F.get(worths, F.col("before"))

    return placed.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("worth", F.col("after"))).alias("kept"),
        gain("worth").alias("removed"),
        (F.get("each", F.col("f")) - gain("worth")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"),
        gain("good_worth").alias("good_lost"),
        gain("toxic_worth").alias("toxic_lost"),
        F.get("shapleys", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report on the five filters of this module, by language."""
    return interactions(failed_filters(docs, labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: The same by its definition: every order is gone through step by step over the documents' sets of failed filters.
OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM texts),
judged AS (
  SELECT doc_id, part,
         (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END)
       + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
       + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
       + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS failed
  FROM worded),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
sets AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, failed),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f (letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM filters a JOIN filters b ON a.bit <> b.bit JOIN filters c ON c.bit NOT IN (a.bit, b.bit)
       JOIN filters d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN filters e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (
  SELECT o.filter_order, CAST(instr(o.filter_order, f.letter) AS INTEGER) AS step, f.bit,
         (SELECT coalesce(sum(g.bit), 0) FROM filters g WHERE instr(o.filter_order, g.letter) < instr(o.filter_order, f.letter))::INTEGER AS before
  FROM orders o, filters f),
walked AS (
  SELECT s.part, o.filter_order, o.step, o.bit,
         coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (failed & before <> 0 AND failed & bit <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (failed = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit <> 0), 0) AS toxic_lost
  FROM sets s, steps o GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM walked
"""
