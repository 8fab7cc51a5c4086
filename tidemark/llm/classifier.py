"""Document quality from random-indexing word vectors and a small network.

Random indexing: every word has a sparse random index vector of +1s and -1s, and a word's vector is the sum of the index
vectors of the words around it, over the whole corpus. Words share ROWS rows by a hash, so the vectors are one table of
whole numbers that tasks fill for themselves and add up; its size does not follow the corpus, its counts do. A document is
the mean and the spread of its words' vectors, and how well these fit the words around. A two-layer network is fitted to labelled documents in numpy, and a
temperature fitted on labelled documents that the network has not seen makes its outputs probabilities.

Fitting uses at most LABELLED labelled documents, those of the least hashes of their ids; word vectors come from all
documents, and every document is scored. Sums are of whole numbers, so scores do not hang on the files' layout.

Null and empty texts, and texts without words, have zero vectors and get the network's score for these. Long texts are
read whole. Repeated rows get the same score. An empty table gives none. Of several labels of an id the larger counts, and
of several texts the least; null labels and null ids teach nothing. Without labels every score is 0.5. Ties of hashes
are broken by the id. Columns of the input that carry the name of a result column give way to it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text, slices, small_batches, written

#: Rows of the word table, and numbers in a row.
ROWS, DIMS = 1 << 17, 64
#: Entries of an index vector that are not zero; words on either side that count as context.
NONZERO, WINDOW = 4, 2
#: Labelled documents that the network and its temperature are fitted to, at most.
LABELLED = 20_000
#: One in so many of them is kept for the temperature.
CALIBRATING = 8
#: Numbers that stand for a document.
FEATURES = 2 * DIMS + 3
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.003, 1e-3
GOOD = 0.3
#: Words whose contexts are added up at a time, which a processor's cache holds.
BLOCK = 4096
#: Words that a Python worker remembers.
REMEMBERED = 500_000
SEED = 11
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(seed: int = SEED) -> np.ndarray:
    """An index vector for each row, and a row of zeros for places outside a text."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((ROWS + 1, DIMS), np.int8)
    places = np.argsort(rng.random((ROWS, DIMS)), axis=1)[:, :NONZERO]
    np.put_along_axis(out[:ROWS], places, rng.choice(np.array([-1, 1], np.int8), (ROWS, NONZERO)), axis=1)
    return out


class _Rows(dict):
    """Rows of the words in each run of characters between white space."""

    def __missing__(self, run: str) -> tuple[int, ...]:
        rows = self[run] = tuple(zlib.crc32(w.encode()) % ROWS for w in _WORD.findall(run))
        return rows


class Words:
    """Rows of the words of texts: runs of letters, of digits, of signs. Case counts."""

    def __init__(self) -> None:
        self.known = _Rows()

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all words in order, and each text's number of words."""
        known, out, sizes, n = self.known, [], [], 0
        for t in texts:
            if len(known) > REMEMBERED:
                known.clear()
            if t:
                out.extend(chain.from_iterable(map(known.__getitem__, t.split())))
            sizes.append(len(out) - n)
            n = len(out)
        return np.array(out, np.int32), np.array(sizes, np.int64)


def contexts(rows: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each word the sum of the index vectors of the words around it in its text."""
    ends = np.cumsum(sizes)
    # WINDOW empty places before, between and after texts
    at = np.arange(len(rows)) + WINDOW * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.full((int(ends[-1]) if len(ends) else 0) + WINDOW * (len(sizes) + 1), ROWS)
    padded[at] = rows
    vectors = index[padded]
    n = len(padded) - 2 * WINDOW
    sums = np.zeros((n, DIMS), np.int8)
    for step in [*range(WINDOW), *range(WINDOW + 1, 2 * WINDOW + 1)]:
        sums += vectors[step : step + n]
    return sums[at - WINDOW]


def _order(rows: np.ndarray) -> np.ndarray:
    """A stable order of row numbers: by their low 16 bits, then by the rest; numpy sorts such short numbers by their digits."""
    low = np.argsort((rows & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((rows >> 16).astype(np.uint16)[low], kind="stable")]


def _packed(values: np.ndarray) -> bytes:
    """A row's numbers in the narrowest whole-number type that holds them; the length tells which."""
    top = int(np.abs(values).max(initial=0))
    return values.astype("<i1" if top < 1 << 7 else "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // DIMS}")


def word_table(texts: DataFrame) -> DataFrame:
    """Rows (row, n, vector): how often words of a row occur in the only column of texts, and the sum of their contexts."""

    def partial_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), index_vectors()
        table, counts = np.zeros((ROWS, DIMS), np.int32), np.zeros(ROWS, np.int64)
        for b in slices(batches, 0):
            rows, sizes = words.rows(b.column(0).to_pylist())
            if not len(rows):
                continue
            if int(counts.max()) > 1 << 28:  # 32 bits hold four contexts of each
                yield from _table_batches(counts, table)
                table[:], counts[:] = 0, 0
            order, around = _order(rows), contexts(rows, sizes, index)
            for at in range(0, len(order), BLOCK):
                part = order[at : at + BLOCK]
                ranked = rows[part]
                starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
                found = ranked[starts]
                table[found] += np.add.reduceat(around[part].astype(np.int32), starts, axis=0)
                counts[found] += np.diff(np.r_[starts, len(ranked)])
        yield from _table_batches(counts, table)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for b in batches:
            for row, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                counts[row] = counts.get(row, 0) + n
                mine = _unpacked(raw)
                if row in sums:
                    sums[row] += mine
                else:
                    sums[row] = mine.astype(np.int64)
        keys = sorted(sums)
        for a in range(0, len(keys), 10_000):
            part = keys[a : a + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array([counts[k] for k in part], pa.int64()), pa.array([_packed(sums[k]) for k in part], pa.binary())], names=["row", "n", "vector"]
            )

    ddl = "row int, n bigint, vector binary"
    parts = small_batches(texts).mapInArrow(partial_table, ddl)
    # a task hands on each row once, so no row is hot
    return parts.repartition("row").mapInArrow(added, ddl)


def _table_batches(counts: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(counts)
    for a in range(0, len(found), 10_000):
        part = found[a : a + 10_000]
        vectors = [_packed(v) for v in table[part]]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part], pa.int64()), pa.array(vectors, pa.binary())], names=["row", "n", "vector"])


def unit_vectors(table: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Word vectors out of the rows of a word table: mean contexts less that of all words, of length 1, as whole 127ths."""
    out = np.zeros((ROWS, DIMS))
    counts = np.zeros(ROWS)
    for row, n, raw in table:
        out[row] = _unpacked(raw)
        counts[row] = n
    seen = counts > 0
    if not seen.any():
        return np.zeros((ROWS, DIMS), np.int8)
    centre = out.sum(axis=0) / counts.sum()
    out[seen] = out[seen] / counts[seen, None] - centre
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
    out[~seen] = 0
    return np.round(out * 127).astype(np.int8)


def pooled(vectors: np.ndarray, index: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' vectors, their spread in each dimension, the mean's length, and how well words
    fit into their places: by their vectors, and by their own index vectors (words beside themselves)."""
    out = np.zeros((len(sizes), FEATURES), np.float32)
    around, ends = contexts(rows, sizes, index), np.cumsum(sizes)
    for k in np.flatnonzero(sizes):  # text by text, so that a text's vectors stay in the cache
        part = slice(ends[k] - sizes[k], ends[k])
        mine, near = rows[part], around[part].astype(np.float32)
        n = np.float32(127 * sizes[k])
        v = vectors[mine].astype(np.float32)
        mean = v.sum(axis=0) / n
        out[k, :DIMS] = mean
        out[k, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, v) / (n * np.float32(127)) - mean * mean, 0))
        out[k, 2 * DIMS] = np.sqrt((mean * mean).sum())
        out[k, 2 * DIMS + 1] = np.vdot(v, near) / n
        out[k, 2 * DIMS + 2] = np.vdot(index[mine].astype(np.float32), near) / n
    return out


@dataclass
class Network:
    """Standardised inputs, a layer of rectified units, an output unit, and the temperature that divides its logit."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, calibrating: np.ndarray) -> Network:
    """A network for rows x with labels y of 0 and 1; rows marked calibrating only set the temperature."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    train = ~calibrating if (~calibrating).any() else np.ones(len(y), bool)
    xs, ys = x[train], y[train]
    net = Network(xs.mean(axis=0), xs.std(axis=0) + 1e-3, [])
    rng = np.random.Generator(np.random.PCG64(SEED))
    inputs = x.shape[1]
    share = min(max(ys.mean(), 1 / (len(ys) + 2)), 1 - 1 / (len(ys) + 2))
    net.weights = [rng.normal(0, np.sqrt(2 / inputs), (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array([np.log(share / (1 - share))])]
    z = (xs - net.mean) / net.scale
    first, second, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ys))
        rate = RATE * (1 - epoch / EPOCHS)
        for a in range(0, len(order), BATCH):
            part = order[a : a + BATCH]
            w1, b1, w2, b2 = net.weights
            h = np.maximum(z[part] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -60, 60)))
            d = (p - ys[part]) / len(part)
            back = np.outer(d, w2) * (h > 0)
            gradients = [z[part].T @ back + DECAY * w1, back.sum(axis=0), h.T @ d + DECAY * w2, np.array([d.sum()])]
            step += 1
            for i, g in enumerate(gradients):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                net.weights[i] = net.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if calibrating.any():
        logits, truth = net.logits(x[calibrating]), y[calibrating]
        temperatures = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
        losses = [np.logaddexp(0, np.where(truth > 0.5, -1, 1) * logits / t).mean() for t in temperatures]
        net.temperature = float(temperatures[int(np.argmin(losses))])
    return net


def _learnt(docs: DataFrame, labels: DataFrame, learn, vectors: np.ndarray, label: str, most: int) -> Network | None:
    """The network fitted to labelled documents for which the condition learn on doc_id holds."""
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # most rows
    if not chosen:
        return None
    known = spark.createDataFrame([(r["doc_id"], int(r["_label"] == 1)) for r in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _label int")
    shared = spark.sparkContext.broadcast(vectors)
    # the ids are bounded by most, and a text an id is enough
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = per_text(texts, "x binary", _features(shared), keep=["doc_id", "_label"]).withColumn("_hash", F.xxhash64("doc_id")).collect()
    rows.sort(key=lambda r: (r["_hash"], r["doc_id"]))
    if not rows:
        return None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows])
    y = np.array([r["_label"] for r in rows])
    return fit(x, y, np.arange(len(rows)) % CALIBRATING == 0 if len(rows) >= CALIBRATING else np.zeros(len(rows), bool))


def _features(shared) -> Callable:
    def start():
        words, index, vectors = Words(), index_vectors(), shared.value

        def run(texts: list[str | None]) -> list[tuple]:
            return [(x.tobytes(),) for x in pooled(vectors, index, *words.rows(texts))]

        return run

    start.per_task = True
    return start


def _scores(shared) -> Callable:
    def start():
        words, index, (vectors, net) = Words(), index_vectors(), shared.value

        def run(texts: list[str | None]) -> list[tuple]:
            if net is None:
                return [(0.5,)] * len(texts)
            return [(float(p),) for p in net.probabilities(pooled(vectors, index, *words.rows(texts)))]

        return run

    start.per_task = True
    return start


def classify(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", most: int = LABELLED) -> DataFrame:
    """docs with score: the probability that label is 1.

    docs(doc_id, text, ...), labels(doc_id, label). learn: a condition on doc_id; labels of other ids are not looked at.
    most: labelled documents to fit to.
    """
    table = written(word_table(docs.select(F.col("text").cast("string").alias("text"))), "word-vectors")
    vectors = unit_vectors([(r["row"], r["n"], bytes(r["vector"])) for r in table.toLocalIterator()])  # ROWS rows at most
    net = _learnt(docs, labels, learn, vectors, label, most)
    return per_text(docs, "score double", _scores(docs.sparkSession.sparkContext.broadcast((vectors, net))))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = classify(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
