"""LM scoring by a hashed maximum-entropy model.

A word has a slot: the most frequent ones one of their own, the others one they share by shape and hash. Slots make up
classes, and log P(word | history) is log P(class) + log P(slot | class) + log P(word | slot). The first two are
softmaxes over sums of weight rows that features of the history pick by hash: the word before, the two before, and the
words two and three back. The last is a smoothed share of the slot's training tokens, so any word has a probability.

Training takes rounds over disjoint folds of the documents. In a round each task starts from the same weights, makes
gradient steps over its own documents, and hands on its change of each weight row with the row's tokens; changes are
averaged by those. Weights are of a fixed size; counts grow with the corpus and stay in a table. Words are looked up once
a text, in a broadcast table of the HEAD most frequent, and their numbers written for training and scoring; the counts
of rare words come by a join of (document, word) rows.

Null texts count as empty: they have their end only. Rows with a null id train. Each row is scored, repeated ones too.
An empty table gives no rows; without training rows every word is equally new.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import slices, small_batches, written
from tidemark.llm.words import count_words, most_frequent

END = b"\n"
WIDTH = 32  # classes, and slots in a class
SLOTS = WIDTH * WIDTH
OWN = 768  # slots with a single word
HEAD = 200_000
LONGEST_HEAD = 40  # bytes of a word in the broadcast table
ROUNDS = 2
#: Training tokens of a task.
TASK_TOKENS = 3_000_000
BATCH = 8192
RATE = 0.35
_PAIRS, _IN_CLASS = 16_384, 16_384
#: First rows of the features: of classes none, word before, pair before, second and third back; then of slots in classes
#: likewise but for the third back. START stands before a text.
START = SLOTS
_C = np.cumsum([0, 1, SLOTS + 1, _PAIRS, SLOTS + 1, SLOTS + 1])
_S = _C[-1] + np.cumsum([0, WIDTH, _IN_CLASS, _IN_CLASS, _IN_CLASS])
ROWS = int(_S[-1])
_BLOCK = 256
#: Rows that numpy adds up without halving them.
_PART = 128
#: Columns that stand for a text.
_NUMBERED = {"_lm_key": "bigint", "_lm_bytes": "int", "_lm_numbers": "binary", "_lm_rare": "array<struct<word:binary,n:bigint>>"}


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def split_lower(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, and no other letters: of bytes, lower() changes these only."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_slot(word: bytes) -> int:
    """Slot of a word without one of its own: the class by its shape, the place by its hash."""
    shape = (65 <= word[0] <= 90) | (not word[-1:].isalnum() and word[-1] < 128) << 1 | (not word.isascii()) << 2
    return OWN + shape * WIDTH + xxhash.xxh64_intdigest(word) % WIDTH


#: Stands for no number; less than any -1 - slot.
_NEW = -1 - SLOTS


class Vocabulary:
    """Slots and counts of the head, and the totals of all shared slots."""

    def __init__(self, head: list[tuple[bytes, int]], tokens: int, distinct: int, slot_tokens: np.ndarray, slot_words: np.ndarray):
        self.number = {w: i for i, (w, _) in enumerate(head)}
        self.slot = np.array([i if i < OWN else shared_slot(w) for i, (w, _) in enumerate(head)], np.int64)
        self.log_count = np.log10(np.array([c for _, c in head], float) + 1)
        self.tokens, self.distinct = tokens, distinct
        self.slot_tokens = slot_tokens
        # what divides a word's count in its slot; a word alone in its slot is all of it
        self.log_slot = np.where(np.arange(SLOTS) < OWN, 0.0, np.log10(slot_tokens + slot_words + 1.0))
        self.rare: dict[bytes, int] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """For each word its number in the head, or -1 - slot."""
        if len(self.rare) > 300_000:
            self.rare.clear()
        rare = self.rare
        out = np.fromiter(map(self.number.get, words, repeat(_NEW)), np.int64, len(words))
        new = np.flatnonzero(out == _NEW).tolist()
        if new:
            out[new] = [rare[w] if w in rare else rare.setdefault(w, -1 - shared_slot(w)) for w in map(words.__getitem__, new)]
        return out


def histories(slots: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Slots one, two and three back, START before the texts that begin at starts."""
    out = []
    place = np.arange(len(slots)) - np.repeat(starts, np.diff(np.append(starts, len(slots))))
    for k in (1, 2, 3):
        h = np.full(len(slots), START)
        h[k:] = slots[:-k] if k < len(slots) else h[k:]
        out.append(np.where(place >= k, h, START))
    return out


def features(slots: np.ndarray, h: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weight rows of the class and of the slot in it, for each token; the first of the class is one row for all."""
    one, two, three = h
    pair = one * 1_000_003 + two
    c = slots // WIDTH
    # sizes are powers of two; the high bits of a wrapped product are mixed best
    mixed = lambda x, salt, size: (x * 0x1E3779B97F4A7C15 + salt * 0x2545F4914F6CDD) >> 40 & (size - 1)
    classes = [_C[:1], _C[1] + one, _C[2] + mixed(pair, 1, _PAIRS), _C[3] + two, _C[4] + three]
    inner = [_S[0] + c, _S[1] + mixed(one * WIDTH + c, 2, _IN_CLASS), _S[2] + mixed(pair * WIDTH + c, 3, _IN_CLASS), _S[3] + mixed(two * WIDTH + c, 4, _IN_CLASS)]
    return classes, inner


_ONES = np.ones(WIDTH, np.float32)


def _softmax(weights: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odds of the WIDTH choices, their sums, and the natural logarithm of the target's probability."""
    x = weights.take(rows[1], axis=0)
    x += weights.take(rows[0], axis=0) if len(rows[0]) > 1 else weights[rows[0]]
    for r in rows[2:]:
        x += weights.take(r, axis=0)
    np.clip(x, -60, 60, out=x)  # within what single precision can hold
    at = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    total = x @ _ONES
    return x, total, at - np.log(total)


def log_probabilities(weights: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 P(slot | history) of each token of texts one after another."""
    out = np.empty(len(slots))
    h = histories(slots, starts)
    for a in range(0, len(slots), BATCH):
        s, part = slots[a : a + BATCH], [x[a : a + BATCH] for x in h]
        classes, inner = features(s, part)
        out[a : a + BATCH] = (_softmax(weights, classes, s // WIDTH)[2] + _softmax(weights, inner, s % WIDTH)[2]) / math.log(10)
    return out


def train_on(weights: np.ndarray, seen: np.ndarray, squares: np.ndarray, slots: np.ndarray, starts: np.ndarray) -> None:
    """One gradient step for each batch, in place, with a rate for each row that falls with its gradients so far."""
    h = histories(slots, starts)
    for a in range(0, len(slots), BATCH):
        s, part = slots[a : a + BATCH], [x[a : a + BATCH] for x in h]
        steps = []
        for rows, target, bases in zip(features(s, part), (s // WIDTH, s % WIDTH), (_C, _S), strict=True):
            p, total, _ = _softmax(weights, rows, target)
            p /= total[:, None]
            p[np.arange(len(p)), target] -= 1
            groups = []
            for r, base in zip(rows, bases, strict=False):
                if len(r) < len(p):
                    steps.append((r, p.sum(0)[None], np.array([len(p)])))
                    continue
                # rows of a feature fit 16 bits, which sort fastest
                own = (r - base).astype(np.uint16)
                order = np.argsort(own, kind="stable")
                sorted_rows = own[order]
                first = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
                n = np.diff(np.append(first, len(r)))
                if len(first) == 1:
                    steps.append((sorted_rows[first] + base, _sums(p, order, first, n), n))
                else:
                    groups.append((sorted_rows[first] + base, order, first + len(r) * len(groups), n))
            if groups:
                at, order, first, n = map(np.concatenate, zip(*groups, strict=True))
                steps.append((at, _all_sums(p, order, first, n), n))
        for at, gradient, n in steps:
            squares[at] += np.square(gradient).mean(1)
            gradient *= RATE
            gradient /= np.sqrt(squares[at] + 1e-6)[:, None]
            weights[at] = weights.take(at, axis=0) - gradient
            seen[at] += n


def _sums(p: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of p in groups of n of their order that start at first.

    Most groups are of one row or two; a sum of its own for each of these would take most of the time.
    """
    if len(first) == 1:
        return p.sum(0)[None]
    out = p.take(order[first], axis=0)
    two = np.flatnonzero(n == 2)
    out[two] += p.take(order[first[two] + 1], axis=0)
    large = n > 2
    if large.any():
        sizes = n[large]
        out[large] = np.add.reduceat(p.take(order[np.repeat(large, n)], axis=0), np.cumsum(sizes) - sizes, axis=0)
    return out


def _all_sums(p: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """_sums of the groups of several orders at once, bit for bit: steps take a row or eight of every group they concern.

    As there, a group is its first row and the others in pairs: halves of those over 128, of whole eights where they can
    be; in each part a sum for each of eight places, these in pairs, and what is left row by row.
    """
    out = p.take(order[first], axis=0)
    some = np.flatnonzero((n > 1) & (n <= _PART + 1))
    starts, sizes = [first[some] + 1], [n[some] - 1]
    many = np.flatnonzero(n > _PART + 1).tolist()
    parts: list[tuple[int, int]] = []

    def halved(start: int, size: int):
        if size <= _PART:
            parts.append((start, size))
            return len(some) + len(parts) - 1
        half = size // 2 // 8 * 8
        return halved(start, half), halved(start + half, size - half)

    trees = [halved(int(first[g]) + 1, int(n[g]) - 1) for g in many]
    if parts:
        starts.append(np.array([a for a, _ in parts]))
        sizes.append(np.array([z for _, z in parts]))
    sums = _part_sums(p, order, np.concatenate(starts), np.concatenate(sizes))
    out[some] += sums[: len(some)]

    def joined(tree) -> np.ndarray:
        return sums[tree] if isinstance(tree, int) else joined(tree[0]) + joined(tree[1])

    for g, tree in zip(many, trees, strict=True):
        out[g] += joined(tree)
    return out


def _part_sums(p: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the parts of order that start at starts, of at most _PART rows each."""
    by = np.argsort(sizes.astype(np.uint8), kind="stable")[::-1]
    starts, sizes = starts[by], sizes[by]
    eights = sizes // 8
    some = int(np.count_nonzero(eights))
    sums = np.empty((len(sizes), p.shape[1]), p.dtype)
    if some:
        at = starts[:some, None] + np.arange(8)
        x = p.take(order[at], axis=0)
        for k, c in enumerate(np.searchsorted(-eights, -np.arange(1, eights[0])).tolist(), 1):  # c: parts of more than k eights
            x[:c] += p.take(order[at[:c] + 8 * k], axis=0)
        x = x[:, ::2] + x[:, 1::2]
        x = x[:, ::2] + x[:, 1::2]
        np.add(x[:, 0], x[:, 1], out=sums[:some])
    sums[some:] = p.take(order[starts[some:]], axis=0)
    done = np.where(eights > 0, eights * 8, 1)
    left = sizes - done
    for k in range(7):
        at = np.flatnonzero(left > k)
        if not len(at):
            break
        sums[at] += p.take(order[starts[at] + done[at] + k], axis=0)
    out = np.empty_like(sums)
    out[by] = sums
    return out


def _tokens(texts: list[str | None], vocabulary: Vocabulary, words_of: Callable[[str], list[bytes]] = split) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts, each with an end, their numbers, and where each text starts."""
    words: list[bytes] = []
    starts = []
    for t in texts:
        starts.append(len(words))
        words += words_of(t or "")
        words.append(END)
    return words, vocabulary.numbers(words), np.array(starts, np.int64)


def number(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", words_of: Callable[[str], list[bytes]] = split) -> DataFrame:
    """docs with what train and score read in place of the text, so that its words are looked up once; written to the shared folder.

    That is a key of the row, the text's bytes, the numbers of its words, and its words beside the head with their counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in docs.columns if c != text and c not in _NUMBERED]
    src = small_batches(docs.select(F.col(text).cast("string").alias("_lm_text"), *[F.col(f"`{c}`") for c in kept]))
    schema = T.StructType([*[docs.schema[c] for c in kept], *T._parse_datatype_string(", ".join(f"{c} {t}" for c, t in _NUMBERED.items())).fields])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from pyspark import TaskContext

        v, row = held.value, TaskContext.get().partitionId() << 40
        for b in slices(batches, 0):
            words, numbers, starts = _tokens(b.column(0).to_pylist(), v, words_of)
            new = np.flatnonzero(numbers < 0)
            cuts = [*np.searchsorted(new, starts).tolist(), len(new)]
            rare, times, offsets = [], [], [0]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if z > a:
                    seen = Counter(map(words.__getitem__, new[a:z].tolist()))
                    rare += seen
                    times += seen.values()
                offsets.append(len(rare))
            rare = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
            ends = np.append(starts, len(words)).astype(np.int32)
            flat = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * np.int32(4)), pa.py_buffer(numbers.astype(np.int32))])
            size = pc.fill_null(pc.binary_length(b.column(0)), 0)
            cols = [pa.array(row + np.arange(len(starts))), size, flat, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rare)]
            row += len(starts)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=schema.names)

    return written(src.mapInArrow(look_up, schema), "numbers")


def _numbers(column: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words of all texts, their slots, and where each text starts."""
    texts = column.to_pylist()
    numbers = np.frombuffer(b"".join(texts), np.int32).astype(np.int64)
    slots = np.where(numbers >= 0, vocabulary.slot[np.maximum(numbers, 0)] if len(vocabulary.slot) else 0, -1 - numbers)
    sizes = np.array([len(t) // 4 for t in texts], np.int64)
    return numbers, slots, np.cumsum(sizes) - sizes


def learn_vocabulary(training: DataFrame, text: str = "text", words_of: Callable[[str], list[bytes]] = split) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of all training texts, and its table (word, n). words_of: the words of a text, as also for train and score."""
    spark = training.sparkSession
    words = count_words(training.select(F.col(text).cast("string")), words_of)
    n_texts = training.count()
    if n_texts:
        words = words.union(spark.createDataFrame([(bytearray(END), n_texts)], "word binary, n bigint"))
    total = words.agg(F.sum("n"), F.count("*")).first()
    head = most_frequent(words.where(F.octet_length("word") <= LONGEST_HEAD), HEAD)
    own = spark.sparkContext.broadcast({w for w, _ in head[:OWN]})

    def by_slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w not in own.value:
                    s = shared_slot(w)
                    sums[0, s] += n
                    sums[1, s] += 1
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["slot", "tokens", "words"])

    tokens, distinct = np.zeros(SLOTS), np.zeros(SLOTS)
    tokens[: min(OWN, len(head))] = [n for _, n in head[:OWN]]
    for r in words.mapInArrow(by_slot, "slot bigint, tokens bigint, words bigint").groupBy("slot").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():  # SLOTS rows
        tokens[r["slot"]], distinct[r["slot"]] = r["tokens"], r["words"]
    return Vocabulary(head, total[0] or 0, total[1], tokens, distinct), words


def train(training: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, words_of: Callable[[str], list[bytes]] = split) -> np.ndarray:
    """Weights of all training texts, as number gives them or plain; at the start they give every slot its share of the training tokens."""
    spark = training.sparkSession
    if "_lm_numbers" not in training.columns:
        training, doc_id = number(training.select(F.col(doc_id).alias("_lm_id"), text), vocabulary, text, words_of), "_lm_id"
    share = np.log(vocabulary.slot_tokens.reshape(WIDTH, WIDTH) + 0.5)
    weights = np.zeros((ROWS, WIDTH), np.float32)
    by_class = np.log(np.exp(share).sum(1))
    weights[_C[0]] = by_class - by_class.max()
    weights[_S[0] : _S[0] + WIDTH] = share - share.max(1, keepdims=True)
    held = spark.sparkContext.broadcast(vocabulary)
    tasks = max(1, math.ceil(vocabulary.tokens / rounds / TASK_TOKENS))
    for i in range(rounds):
        now = spark.sparkContext.broadcast(weights)  # ROWS * WIDTH numbers
        fold = training.where(F.pmod(F.xxhash64(doc_id, F.lit("round")), F.lit(rounds)) == i).select("_lm_bytes", "_lm_numbers")

        def change(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            mine, seen, squares = now.value.copy(), np.zeros(ROWS, np.float32), np.full(ROWS, 1.0, np.float32)
            for b in slices(batches, 0):
                _, slots, starts = _numbers(b.column(1), held.value)
                train_on(mine, seen, squares, slots, starts)
            mine -= now.value
            mine *= seen[:, None]
            for a in range(0, ROWS, _BLOCK):
                if seen[a : a + _BLOCK].any():
                    data = np.concatenate([mine[a : a + _BLOCK], seen[a : a + _BLOCK, None]], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([a // _BLOCK]), pa.array([data.tobytes()], pa.binary())], names=["block", "data"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(data, np.float32).astype(float)
                    sums[block] = sums[block] + x if block in sums else x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

        changes = small_batches(fold).coalesce(tasks).mapInArrow(change, "block bigint, data binary")
        # a model's rows reach the driver, however many tasks there are
        weights = weights.copy()
        for r in changes.repartition("block").mapInArrow(add, "block bigint, data binary").collect():
            data = np.frombuffer(bytes(r["data"]), np.float32).reshape(-1, WIDTH + 1)
            a = r["block"] * _BLOCK
            weights[a : a + len(data)] += data[:, :WIDTH] / np.maximum(data[:, WIDTH:], 1)
    return weights


def score(docs: DataFrame, vocabulary: Vocabulary, words: DataFrame, weights: np.ndarray, text: str = "text", words_of: Callable[[str], list[bytes]] = split) -> DataFrame:
    """docs, as number gives them or plain, without the text, with n_tokens, n_known, base_score and score; columns of these names give way."""
    spark = docs.sparkSession
    if "_lm_numbers" not in docs.columns:
        docs = number(docs, vocabulary, text, words_of)
    held, model = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(weights)
    own = {"n_tokens", "n_known", "base_score", "score"}
    kept = [c for c in docs.columns if c not in _NUMBERED and c.lower() not in own]
    src = small_batches(docs.select("_lm_bytes", "_lm_numbers", "_lm_key", *[F.col(f"`{c}`") for c in kept]))
    schema = T.StructType([docs.schema["_lm_key"], *[docs.schema[c] for c in kept], *T._parse_datatype_string("n_tokens bigint, n_known bigint, base_score double, score double").fields])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        each = math.log10(v.tokens + v.distinct + 1)
        for b in slices(batches, 0):
            numbers, slots, starts = _numbers(b.column(1), v)
            known = numbers >= 0
            count = np.where(known, v.log_count[np.maximum(numbers, 0)] if len(v.log_count) else 0.0, 0.0)
            p = log_probabilities(model.value, slots, starts) + np.where(slots < OWN, 0.0, count - v.log_slot[slots])
            base = count - each
            sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, p)]
            cols = [pa.array(np.diff(np.append(starts, len(slots)))), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *cols], names=schema.names)

    rated = written(src.mapInArrow(rate, schema), "scores")
    rare = docs.select("_lm_key", F.inline("_lm_rare"))
    found = rare.join(words.withColumnRenamed("n", "c"), "word").groupBy("_lm_key").agg(F.sum("n").alias("_lm_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_lm_more"))
    full = rated.join(found, "_lm_key", "left")
    more = F.coalesce("_lm_more", F.lit(0.0))
    return full.select(*[F.col(f"`{c}`") for c in kept], "n_tokens", (F.col("n_known") + F.coalesce("_lm_n", F.lit(0))).alias("n_known"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", held_out("doc_id").alias("held_out"))
    training = docs.where("not held_out")
    vocabulary, words = learn_vocabulary(training, words_of=split_lower)
    texts = number(docs, vocabulary, words_of=split_lower)
    scored = score(texts, vocabulary, words, train(texts.where("not held_out"), vocabulary))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
