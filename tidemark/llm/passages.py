"""Substring dedup by hashing lines and parts of lines.

Texts are cut into units: lines, and in them parts that end after a sentence's last word or after a word that its own hash
picks, so that cuts depend on the words near them only and a passage is cut alike wherever it stands. Units are
normalised (lower case, one space between words) and hashed; the digests are grouped over the whole corpus, and the
occurrence that ranks first by document id, text and offset is kept. Runs of neighbouring units that all occurred before
are extended word by word into the units beside them, as far as these agree with the words beside the kept
occurrence. Extended runs of least_words words or more are removed, so that short phrases that many texts happen
to share stay; so are whole lines of least_line words or more that were a whole line before. What was removed is
reported by offsets in the original text.

Every removed word has an equal one at a place that ranks before its own, and of the places that are equal the first stays.

Documents are told apart by id and text; equal rows are one document here, and are treated alike. Null texts count as
empty and have no units; null ids rank first. Every row takes part, however common a unit is: a digest's first place is a
minimum that is computed before the shuffle already, and the join back on it can be split. Texts of any length are read
whole, one at a time; an empty table gives no rows. Columns of docs other than id and text play no part in what is
found, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.llm.shared import per_text, slices, small_batches, written

LEAST_WORDS = 25
#: Words of the shortest line that goes for being repeated as a whole. Shorter ones stay unless asked for: a third of all
#: documents hold one, a notice or a common phrase, that nobody copied them for.
LEAST_LINE = LEAST_WORDS
#: One of so many different words ends a part of a line.
CUT = 32
#: Units at either end of a run among which the one of most words says where the run is kept.
ANCHORS = 3
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])
_ENDS = np.array([ord(c) for c in ".!?"], np.uint32)
_NAMES = ("word", "start", "end", "words", "beside", "digest")


def lower(text: str) -> str:
    """text in lower case, character by character: those with no one character for it stay, so that offsets hold."""
    t = text.lower()
    return t if len(t) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Parts:
    """A text's words and the parts of lines that they are cut into, as arrays.

    starts, ends: of words, in the text. first, stop: of parts, in words. line: of words, a number. wide: of words but the
    last, whether more or other than one blank follows.
    """

    def __init__(self, text: str) -> None:
        self.text = lower(text)
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.concatenate([[True], _SPACES[np.minimum(code, 0x3001)], [True]])
        edges = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = starts, ends = edges[::2], edges[1::2]
        self.line = np.searchsorted(np.flatnonzero(code == 10), starts)
        if not len(starts):
            self.first = self.stop = starts
            return
        self.wide = (starts[1:] - ends[:-1] > 1) | (code[ends[:-1]] != 32)
        # a word's hash is of its last three characters and its length
        last = code[ends - 1]
        h = (ends - starts).astype(np.uint32)
        for k in (1, 2, 3):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + code[np.maximum(ends - k, starts)]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        cut = np.isin(last, _ENDS) | ((h >> np.uint32(8)) % np.uint32(CUT) == 0)
        cut[:-1] |= self.line[1:] != self.line[:-1]
        cut[-1] = True
        self.stop = np.flatnonzero(cut) + 1
        self.first = np.concatenate([[0], self.stop[:-1]])

    def digests(self, first: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
        """Signed 64-bit hashes of stretches of words, one space between them."""
        starts, ends = self.starts[first].tolist(), self.ends[stop - 1].tolist()
        gap = np.concatenate([[0], np.cumsum(self.wide)]) if len(first) else first
        wide = (gap[stop - 1] != gap[first]).tolist()
        h, t = xxhash.xxh3_64_intdigest, self.text
        every = (h((" ".join(t[a:b].split()) if w else t[a:b]).encode("utf-8", "surrogatepass"), seed) for a, b, w in zip(starts, ends, wide, strict=True))
        return np.fromiter(every, np.uint64, len(starts)).view(np.int64)


def units_of(text: str, short: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> list[np.ndarray]:
    """Columns word, start, end, words, beside, digest of a text's units: parts, then lines of at least least_line and under short words.

    word: the number of the first word; beside: words of the parts before and after, -1 for a line. Longer lines need no
    unit, as runs of their parts take their place.
    """
    p = Parts(text)
    size = p.stop - p.first
    around = np.concatenate([[0], size, [0]])
    out = [p.first, p.starts[p.first], p.ends[p.stop - 1], size, around[:-2] + around[2:], p.digests(p.first, p.stop, 0)]
    if least_line < short and len(p.starts):
        stop = np.concatenate([np.flatnonzero(p.line[1:] != p.line[:-1]) + 1, [len(p.starts)]])
        first = np.concatenate([[0], stop[:-1]])
        some = (stop - first >= least_line) & (stop - first < short)
        first, stop = first[some], stop[some]
        line = [first, p.starts[first], p.ends[stop - 1], stop - first, np.full(len(first), -1), p.digests(first, stop, 1)]
        out = [np.concatenate(c) for c in zip(out, line, strict=True)]
    return out


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", short: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """Rows (id, key) and units_of of all texts; key: the text's hash."""
    src = small_batches(_documents(docs, doc_id, text))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("key", T.LongType()), *[T.StructField(n, T.LongType() if n == "digest" else T.IntegerType()) for n in _NAMES]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            got = [units_of(t or "", short, least_line) for t in b.column(2).to_pylist()]
            which = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
            arrays = [pa.array(np.concatenate([g[k] for g in got]).astype(np.int64 if n == "digest" else np.int32)) for k, n in enumerate(_NAMES)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), *arrays], names=schema.names)

    return src.mapInArrow(cut, schema)


def _words_beside(docs: DataFrame, ends: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (k_id, k_key, k_at, id, key, word, before, words, starts): the words from a place to the end of its part, one space between them, and where they start.

    ends: (id, key, word, before, at, k_id, k_key, k_at). Each gives a row for its own place (id, key, at), and each
    different place (k_id, k_key, k_at) gives one whose id, key, word and before are null. at: a word's number; or, of the word from
    which the part is wanted backwards, -1 less that number.
    """
    src = _documents(docs, doc_id, text)
    place = f"struct<at:int,word:int,before:boolean,k_id:{src.schema['id'].dataType.simpleString()},k_key:bigint,k_at:int>"
    none = {"own": F.lit(None).cast(place), "kept": F.lit(None).cast("int")}
    own = ends.select("id", "key", F.lit(None).cast("string").alias("text"), F.struct("at", "word", "before", "k_id", "k_key", "k_at").cast(place).alias("own"), none["kept"].alias("kept"))
    kept = ends.select("k_id", "k_key", F.lit(None).cast("string"), none["own"], "k_at")
    # a text meets what is asked of it in one shuffle, and equal rows are one
    rows = src.select("id", "key", "text", *[c.alias(n) for n, c in none.items()]).union(own).union(kept)
    asked = rows.groupBy("id", "key").agg(F.first("text", ignorenulls=True).alias("text"), F.collect_list("own").alias("own"), F.collect_set("kept").alias("kept"))
    asked = small_batches(asked.where((F.size("own") > 0) | (F.size("kept") > 0)))
    names = ["k_id", "k_key", "k_at", "id", "key", "word", "before", "words", "starts"]
    id_type = src.schema["id"].dataType
    kinds = [id_type, T.LongType(), T.IntegerType(), id_type, T.LongType(), T.IntegerType(), T.BooleanType(), T.StringType(), T.ArrayType(T.IntegerType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(k) for k in kinds]
        for b in slices(batches, 2):
            cols = [[] for _ in names]
            for i, key, t, own, kept in zip(*[c.to_pylist() for c in b.columns], strict=True):
                p = Parts(t)

                def put(at: int, p=p) -> bool:
                    w = at if at >= 0 else -1 - at
                    if w >= len(p.starts):
                        return False
                    part = int(np.searchsorted(p.stop, w, "right"))
                    a, z = (w, int(p.stop[part])) if at >= 0 else (int(p.first[part]), w + 1)
                    step = 1 if at >= 0 else -1
                    cols[7].append(" ".join(p.text[p.starts[a] : p.ends[z - 1]].split()[::step]))
                    cols[8].append(p.starts[a:z][::step])
                    return True

                found = [(x["k_id"], x["k_key"], x["k_at"], i, key, x["word"], x["before"]) for x in own if put(x["at"])]
                found += [(i, key, at, None, None, None, None) for at in kept if put(at)]
                for c, values in zip(cols, zip(*found, strict=True), strict=False):
                    c.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return asked.mapInArrow(read, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))


def _extended(runs: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """runs (id, key, word, start, end, words, left, right, kept) after extension, as spans with kept_id and kept_start.

    left, right: (word, id, key, kept_word) of the unit near that end that says where to look for more; kept: of the first unit.
    """
    runs = written(runs, "runs")
    ends = []
    for side, at in (("left", F.col("word") - 1), ("right", F.col("word") + F.col("words"))):
        s = F.col(side)
        there = s["kept_word"] + at - s["word"]
        sign = (lambda x: -1 - x) if side == "left" else (lambda x: x)
        ends.append(runs.where((at >= 0) & (there >= 0)).select("id", "key", "word", F.lit(side == "left").alias("before"), sign(at).alias("at"), s["id"].alias("k_id"), s["key"].alias("k_key"), sign(there).alias("k_at")))
    beside = written(_words_beside(docs, ends[0].union(ends[1]), doc_id, text), "words-beside")
    # a run's own words meet those beside the place where it is kept
    kept = beside.where("key IS NULL").select(F.col("k_id").alias("k_id_"), F.col("k_key").alias("k_key_"), F.col("k_at").alias("k_at_"), F.col("words").alias("kept_"), F.col("starts").alias("kept_starts_"))
    ends = beside.where("key IS NOT NULL").withColumnsRenamed({"words": "own_", "starts": "own_starts_"})
    ends = ends.join(kept, F.col("k_id").eqNullSafe(F.col("k_id_")) & (F.col("k_key") == F.col("k_key_")) & (F.col("k_at") == F.col("k_at_")))
    ends = ends.withColumns({"own_": F.split("own_", " "), "kept_": F.split("kept_", " ")})
    differ = F.array_position(F.zip_with("own_", "kept_", lambda x, y: x.eqNullSafe(y)), False)
    more = ends.withColumn("n", F.when(differ == 0, F.size("own_")).otherwise(differ - 1).cast("int")).where("n > 0")
    start = F.get("own_starts_", F.col("n") - 1)
    end = start + F.length(F.get("own_", F.col("n") - 1))
    found = F.struct("n", F.when(F.col("before"), start).otherwise(end).alias("to"), F.col("k_id").alias("kept_id"), F.get("kept_starts_", F.col("n") - 1).alias("kept_start"))
    more = more.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("word").alias("_word"), "before", found.alias("found"))
    more = more.groupBy("_id", "_key", "_word").agg(F.max_by("found", F.when(F.col("before"), 1)).alias("l"), F.max_by("found", F.when(~F.col("before"), 1)).alias("r"))
    both = runs.join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("word") == F.col("_word")), "left")
    n_l, n_r = F.coalesce("l.n", F.lit(0)), F.coalesce("r.n", F.lit(0))
    return both.select(
        "id",
        "key",
        (F.col("word") - n_l).alias("word"),
        F.coalesce("l.to", "start").alias("start"),
        F.coalesce("r.to", "end").alias("end"),
        (F.col("words") + n_l + n_r).alias("words"),
        F.when(F.col("l").isNotNull(), F.struct("l.kept_id", "l.kept_start")).otherwise(F.struct(F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start"))).alias("kept"),
    )


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE) -> DataFrame:
    """Rows (id, key, start, end, words, kept_id, kept_start) of each stretch of text that occurred before.

    kept_id and kept_start are where the stretch's first words are kept.
    """
    found = units(docs, doc_id, text, least_words, least_line)
    # a digest is told apart by its unit's words as well; lines have digests of their own
    first = found.groupBy("digest", "words").agg(F.min(F.struct("id", "key", "start", "word")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "first-places")  # else its aggregation shares a stage with the join, and a common unit can't be split
    again = found.join(first, ["digest", "words"]).where(~F.struct("id", "key", "start").eqNullSafe(F.struct("kept.id", "kept.key", "kept.start")))
    # equal rows give equal units
    again = again.select("id", "key", *_NAMES[:-1], "kept").repartition("id", "key").distinct()
    lines = None
    if least_line < least_words:
        again = written(again, "again")
        lines = again.where("beside < 0").select("id", "key", "word", "start", "end", "words", F.struct(F.col("kept.id").alias("kept_id"), F.col("kept.start").alias("kept_start")).alias("kept"))

    # neighbours: the one's first word is the next after the other's last
    order = W.partitionBy("id", "key").orderBy("word")
    parts = again.where("beside >= 0").withColumn("run", F.col("word") + F.col("words") - F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("id", "key", "run").orderBy("word")
    parts = parts.withColumns({"nth": F.row_number().over(whole), "of": F.count("*").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})
    said = F.struct("word", "kept.id", "kept.key", F.col("kept.word").alias("kept_word"))

    def anchor(near: Column) -> Column:
        return F.max_by(said, F.when(near < ANCHORS, F.struct("words", -near)))

    runs = parts.groupBy("id", "key", "run").agg(
        F.min("word").alias("word"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("words").cast("int").alias("words"),
        (F.min_by("beside", "word") + F.max_by("beside", "word")).alias("beside"),
        anchor(F.col("nth") - 1).alias("left"),
        anchor(F.col("of") - F.col("nth")).alias("right"),
        F.min_by(F.struct("kept.id", "kept.start"), "word").alias("kept"),
    )
    # others can't grow to least_words
    runs = _extended(runs.where(F.col("words") + F.col("beside") >= least_words).drop("run", "beside"), docs, doc_id, text)
    spans = runs.where(F.col("words") >= least_words)
    spans = spans if lines is None else spans.unionByName(lines)

    # stretches that overlap or touch are one
    order = W.partitionBy("id", "key").orderBy("word", F.desc("words"))
    reached = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("word") <= reached, 0).otherwise(1)).withColumn("stretch", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = spans.groupBy("id", "key", "stretch").agg(
        F.min("start").cast("bigint").alias("start"),
        F.max("end").cast("bigint").alias("end"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"),
        F.min_by("kept", F.struct("word", -F.col("words"))).alias("kept"),
    )
    return joined.select("id", "key", "start", "end", "words", F.col("kept.kept_id").alias("kept_id"), F.col("kept.kept_start").cast("bigint").alias("kept_start"))


def remove_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_line: int = LEAST_LINE, out: str = "removed") -> DataFrame:
    """docs with repeated passages cut from the text, and a column of their offsets in the text as it was, null if none.

    What stays of a text is joined by newlines. Columns other than text are kept; one that is named as out gives way to it.
    """
    runs = repeated_passages(docs, doc_id, text, least_words, least_line).groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    left = docs.select(*[F.col(f"`{c}`") for c in rest]).withColumn("_key", F.xxhash64(F.col(text)))
    joined = left.join(runs, left[doc_id].eqNullSafe(runs["id"]) & (left["_key"] == runs["key"]), "left").select(*[left[f"`{c}`"] for c in rest], "_spans")
    # both go through one column: a JSON of the spans in front of the text
    packed = joined.withColumn("_cut", F.when(F.col("_spans").isNotNull(), F.concat(F.to_json("_spans"), F.lit("\x00"), F.col(text))))
    same = [c for c in rest if c != text]
    cut = per_text(packed.withColumnRenamed("_spans", out), "_left string", _cut, "_cut", keep=[*rest, out])
    return cut.select(*[F.col(f"`{c}`") if c in same else F.coalesce("_left", F.col(text)).alias(text) for c in rest], F.col(out))


def _cut(texts: list[str | None]) -> list[tuple]:
    import json

    out = []
    for t in texts:
        if t is None:
            out.append((None,))
            continue
        spans, _, t = t.partition("\x00")
        parts, at = [], 0
        for s in json.loads(spans):
            parts.append(t[at : s["start"]])
            at = s["end"]
        parts.append(t[at:])
        out.append(("\n".join(p for x in parts if (p := x.strip())),))
    return out


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).select(F.col("id").alias("doc_id"), "start", "end", "words", F.col("kept_id").alias("kept_doc_id"), "kept_start")
