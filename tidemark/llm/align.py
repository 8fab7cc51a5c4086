"""Which tokens of two tokenizers meet: alignment of their tokens over a corpus, each distinct text once.

Documents are shuffled by their full text, so a text is tokenized and aligned once however often it occurs; its pair
counts are weighted by its multiplicity, and its measures are joined to the ids of all documents that hold it. Both
tokenizers' tokens are laid over the same bytes (a space, then the text). Where a token of either ends at one byte, a
group of tokens ends and the two tokens are a link.

The HEAD most frequent pairs' counts, a bounded table, go to all tasks; every other pair's count comes by a join, in which
no pair is frequent. So the result does not depend on HEAD.

Null and empty texts, and texts that a tokenizer does not spell out exactly, have no tokens: all measures are zero and the
digest of groups is empty. Whole texts are encoded, however long. Repeated rows and ids each get their text's measures. An
empty table gives an empty result. Ties of an id's highest count all count as best; ties at the end of HEAD are broken by
the pair, which only decides where its count is looked up. Columns of the input that carry the name of a result column
give way to it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.packing import ByteBpe
from tidemark.llm.shared import per_text, slices, small_batches, written

#: Pairs whose counts every task holds, 17 bytes each.
HEAD = 262_144
#: Different pairs that a task counts before it hands them on.
HELD = 1_000_000
#: Of a text with this share of all documents or more, of which there are at most so many, the measures go to all tasks.
HOT = 1000
SPACE = "▁"
_PAIR = 32  # bits of the second id in a pair
_MEASURES = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


class Aligner:
    """Two tokenizers' ids, bytes and texts of ids.

    a: path of a byte-level BPE file. b: path of a SentencePiece file that puts a space in front. Special tokens' strings
    in a text are plain text.
    """

    def __init__(self, a: str, b: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.first = ByteBpe(a)
        self.first.whole.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(a) as f:
            spec = json.load(f)
        # the printable stand-ins that byte-level vocabularies use for bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        vocab = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in byte_of for c in t)}
        self.a_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        sp = self.second
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(map(sp.id_to_piece, range(sp.vocab_size())))
        ]
        self.a_length = np.array([len(t) for t in self.a_bytes])
        self.b_length = np.array([len(t) for t in self.b_bytes])
        # an id and the sign after it: within a group, and at the end of one
        self.a_text = [f"{i}{sign}" for i in range(len(self.a_bytes)) for sign in ",|"]
        self.b_text = [f"{i}{sign}" for i in range(len(self.b_bytes)) for sign in ",;"]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Both ids of each text; None where either does not spell a space and the text."""
        seconds = self.second.encode(texts, num_threads=1)
        out = []
        for t, b in zip(texts, seconds, strict=True):
            spaced = " " + t
            raw = spaced.encode()
            a = np.frombuffer(self.first.encode(spaced), "<u4").astype(np.int64)
            same = t != "" and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((a, np.array(b, np.int64)) if same else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a and in b of the tokens that end where one of the other ends: a group's last ones."""
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        at = np.searchsorted(ends_b, ends_a)
        at[at == len(b)] = 0
        met = np.flatnonzero(ends_b[at] == ends_a)
        return met, at[met]

    def spelled(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """The groups as text: `a1,a2|b1;a3|b2,b3`."""
        group_a = np.searchsorted(last_a, np.arange(len(a)))
        group_b = np.searchsorted(last_b, np.arange(len(b)))
        ending_a, ending_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ending_a[last_a] = ending_b[last_b] = 1
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = list(map(self.a_text.__getitem__, (2 * a + ending_a).tolist())) + list(map(self.b_text.__getitem__, (2 * b + ending_b).tolist()))
        return "".join(map(words.__getitem__, order.tolist()))[:-1]


@lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _aligned(a: str, b: str, texts: list[str | None]) -> list[tuple]:
    aligner, out = _aligner(a, b), []
    for t, found in zip(texts, aligner.ids([t or "" for t in texts]), strict=True):
        digest = hashlib.sha256((t or "").encode()).digest()
        if found is None:
            out.append((digest, 0, 0, 0, 0, "", b""))
            continue
        x, y = found
        last_x, last_y = aligner.align(x, y)
        groups = hashlib.sha256(aligner.spelled(x, y, last_x, last_y).encode()).hexdigest()
        pairs = np.sort(x[last_x] << _PAIR | y[last_y])
        out.append((digest, len(x), len(y), len(last_x), len(pairs), groups, pairs.astype("<i8").tobytes()))
    return out


def align(texts: DataFrame, a: str, b: str, text: str = "text") -> DataFrame:
    """texts with digest (SHA-256 of the text), n_a, n_b, n_groups, n_links, groups_sha256 and links (sorted pairs, eight bytes each)."""
    ddl = "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
    return per_text(texts, ddl, partial(_aligned, a, b), text)


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, weights = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(every, kind="stable")
    every, weights = every[order], weights[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[starts], np.add.reduceat(weights, starts) if len(starts) else weights


def count_pairs(aligned: DataFrame) -> DataFrame:
    """Rows (pair, links, best) of aligned(links, n): each pair's links over the corpus, n of them for each of its text's,
    and whether it has the most of its second id.

    Tasks add up their own pairs before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(times[0])], names=["pair", "links"])

        for part in slices(batches, 0, 8_000_000):
            links = [np.frombuffer(x, "<i8") for x in part.column(0).to_pylist()]
            keys += links
            times.append(np.repeat(np.array(part.column(1).to_pylist(), np.int64), [len(x) for x in links]))
            held += sum(map(len, links))
            if held > HELD:
                k, w = _summed(keys, times)
                keys, times, held = [k], [w], 0
                if len(k) > HELD:
                    yield out()
                    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k, w = _summed(keys, times)
        keys, times = [k], [w]
        yield out()

    rows = small_batches(aligned.where("n_links > 0").select("links", "n")).mapInArrow(count, "pair bigint, links bigint")
    counts = rows.groupBy("pair").agg(F.sum("links").alias("links"))
    second = F.col("pair").bitwiseAND(F.lit((1 << _PAIR) - 1))
    # a window holds the pairs of one second id: no more than the first vocabulary has entries
    most = F.max("links").over(Window.partitionBy("second"))
    return counts.withColumn("second", second).select("pair", "links", (F.col("links") == most).alias("best"))


def _most_frequent(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.orderBy(F.desc("links"), "pair").limit(most)


def measure(aligned: DataFrame, pairs: DataFrame, head: int = HEAD) -> DataFrame:
    """aligned without its links, with n_best and count_sum by the counts in pairs."""
    spark = aligned.sparkSession
    top = _most_frequent(pairs, head).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy(t) for c, t in (("pair", np.int64), ("links", np.int64), ("best", bool))))
    kept = [c for c in aligned.columns if c != "links"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = shared.value
        for batch in batches:
            best_n, sums, rest = [], [], []
            for raw in batch.column(0):
                mine = np.frombuffer(raw.as_py(), "<i8")
                at = np.searchsorted(known, mine)
                at[at == len(known)] = 0
                hit = known[at] == mine if len(known) else np.zeros(len(mine), bool)
                best_n.append(int(best[at[hit]].sum()) if len(known) else 0)
                sums.append(int(links[at[hit]].sum()) if len(known) else 0)
                others, times = np.unique(mine[~hit], return_counts=True)
                rest.append(list(zip(others.tolist(), times.tolist(), strict=True)))
            pair = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
            rest_array = pa.array([[{"pair": p, "times": n} for p, n in r] for r in rest], pair)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(best_n, pa.int64()), pa.array(sums, pa.int64()), rest_array], names=[*kept, "n_best", "count_sum", "rest"])

    ddl = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in kept)
    looked = written(
        small_batches(aligned.select("links", *kept)).mapInArrow(look_up, f"{ddl}, n_best bigint, count_sum bigint, rest array<struct<pair:bigint,times:bigint>>"),
        "aligned-head",
    )
    tail = looked.where(F.size("rest") > 0).select("digest", F.inline("rest")).join(pairs, "pair")
    more = tail.groupBy("digest").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("links")).alias("more_sum"))
    return looked.join(more, "digest", "left").select(
        *kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("string").cast("binary"), 256))


def align_corpus(docs: DataFrame, a: str, b: str, text: str = "text", head: int = HEAD) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256. a, b: paths, the same on all machines."""
    whole = F.col(text).cast("string")
    kept = [c for c in docs.columns if c.lower() not in _MEASURES]
    # rows are counted before the shuffle: a text of very many rows reaches its reducer as one row a task
    texts = docs.where(whole != "").groupBy(whole.alias("_text")).agg(F.count(F.lit(1)).alias("n"))
    aligned = written(align(texts, a, b, "_text").drop("_text"), "aligned")
    pairs = written(count_pairs(aligned), "pairs")
    measured = written(measure(aligned, pairs, head), "aligned-measures")
    total = measured.agg(F.sum("n")).first()[0] or 0
    columns = list(_MEASURES)
    # no more than HOT texts can each have that share of all rows
    hot = F.broadcast(measured.where(F.col("n") * HOT >= total).select(F.col("digest").alias("_digest"), F.struct(*columns).alias("_hot")))
    others = measured.where(F.col("n") * HOT < total).select(F.col("digest").alias("_key"), F.struct(*columns).alias("_other"))
    rows = docs.select(*kept, F.when(whole != "", _digest(F.col(text))).alias("_digest")).join(hot, "_digest", "left")
    # rows whose measures are there, or that have none, get keys that meet nothing and spread them
    spread = F.concat(F.lit("-"), F.hex(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in kept if c != text]))).cast("binary")
    keyed = rows.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_digest"))).withColumn("_key", F.coalesce("_key", spread))
    got = F.coalesce("_hot", "_other")
    joined = keyed.join(others, "_key", "left")
    empty = {c: F.lit("" if t == "string" else 0).cast(t) for c, t in _MEASURES.items()}
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(got[c], empty[c]).alias(c) for c in columns])


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = align_corpus(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_MEASURES)
