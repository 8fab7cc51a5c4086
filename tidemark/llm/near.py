"""Near-duplicates by order MinHash.

A text's k-mers are its runs of five words, each labelled with its occurrence number in the text. Each of many hash
functions samples several labelled k-mers of least hash and keeps them in the order of the text, so that texts match
where they agree in content and order, as edit distance has it. Texts that share a sample are in a bucket. Two
texts are linked if a banded alignment of their words matches at least SIMILARITY of them: matched / (all of both -
matched). That holds for all that share so much of their k-mers in order, and those meet in a bucket nearly surely; of
texts that are linked by their words only, those that meet.

Equal texts are one node from the start. The others' links are found without all pairs of a bucket: its best leader,
the text that shares most, is aligned with all, then a few more leaders with the members outside their class, and in
small buckets all that the first left over. A bucket of one class is done: a class is a connected component of the
links. Members of large buckets that are still not of their largest class, as texts are that share a long passage, are
compared exactly: texts alike must share one of their rarest k-mers, and such pairs are aligned too.

Texts without words are alike only if equal; texts of under five words are one k-mer. Null texts count as empty. Texts
are told apart by 64-bit hashes. Every row gets a class, repeated rows too, and null ids can't name one unless all are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.classes import components
from tidemark.llm.shared import slices, small_batches, written

K = 5
SIMILARITY = 0.8
#: (k-mers in a text from, sampled k-mers, samples): by the text's length, so that a pair of similarity 0.8 shares all of
#: a sample in one of ten cases or more, and misses all samples in about one of 10^4 or fewer, and texts that merely
#: share a passage meet seldom. Texts near a limit take part on both sides of it.
TIERS = ((1, 3, 20), (16, 6, 40), (64, 10, 96))
_SEEDS = np.random.default_rng(20).integers(0, 2**32, (2, 96), np.uint32)
_ODD, _ADD = _SEEDS[0] | np.uint32(1), _SEEDS[1]
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Members of a bucket that all lead, if they have to: no member is aligned with more than so many others in it for that.
EXHAUSTED = 32
#: K-mers of the most texts that all tasks hold with their counts, so that none of their rows is joined for it.
HELD_KMERS = 65_536
#: K-mers that a task adds up before it hands them on.
SUMMED_KMERS = 1_000_000
#: Hash values held at a time for one text.
_AT_ONCE = 2_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _G2
    return x ^ (x >> np.uint64(29))


def kmers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of the runs of K words, in order; one of all words if there are fewer. known: hashes of words, shared."""
    ids = _numbers(words, known)
    n = max(len(ids) - K + 1, 1 if len(ids) else 0)
    out = np.zeros(n, np.uint64)
    for j in range(min(K, len(ids))):
        out = _mix(out * _G1 + ids[j : j + n])
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence numbers."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    if not same.any():
        return _mix(hashes)
    at = np.arange(len(s))
    count = at - np.maximum.accumulate(np.where(same, 0, at))
    out = np.empty_like(hashes)
    out[order] = _mix(s + count.astype(np.uint64) * _G1)
    return out


def tiers_of(n: int) -> list[int]:
    """Tiers that a text of n k-mers takes part in: its own, and those of the lengths that 0.8 leaves in reach."""
    edges = [t[0] for t in TIERS[1:]] + [n * 2 + 2]
    return [i for i, (low, high) in enumerate(zip([1, *edges], edges, strict=False)) if low * SIMILARITY <= n < high / SIMILARITY]


def sampled(hashes: np.ndarray, count: int, samples: int) -> np.ndarray:
    """For each sample, a row of the count k-mers of least hash (all, if fewer), in the order of the text."""
    n = len(hashes)
    count = min(count, n)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    chosen = np.empty((samples, count), np.int64)
    # nearly always this many of the smallest hold the count that is sought
    share = (count + 6 * count**0.5 + 8) / n
    step = max(1, _AT_ONCE // n)
    # sorted as one number: sample, hash and place, of which the first and last have at most 22 bits, or the last 32 alone
    bits = np.uint64(n.bit_length())
    place = (np.uint64(1) << bits) - np.uint64(1)
    for a in range(0, samples, step):
        v = low[None, :] * _ODD[a : min(a + step, samples), None]
        v += _ADD[a : min(a + step, samples), None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        least = None
        if share < 0.5:
            flat = v.reshape(-1)
            at = np.flatnonzero(flat < np.uint32(share * 2**32))
            rows = at // n
            sizes = np.bincount(rows, minlength=len(v))
            if sizes.min() >= count:
                low_bits = (flat[at].astype(np.uint64) << bits) | (at - rows * n).astype(np.uint64)
                keys = np.sort((rows.astype(np.uint64) << (bits + np.uint64(32))) | low_bits)
                least = keys[(np.cumsum(sizes) - sizes)[:, None] + np.arange(count)]
        if least is None:
            keys = (v.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64)
            keys.sort(axis=1)
            least = keys[:, :count]
        chosen[a : a + step] = np.sort(least & place, axis=1)
    return hashes[chosen]


def _folded(rows: np.ndarray) -> np.ndarray:
    """One 64-bit value for each row."""
    x = np.full(len(rows), np.uint64(rows.shape[1]))
    for j in range(rows.shape[1]):
        x = _mix(x * _G1 + rows[:, j])
    return x


def samples_of(hashes: np.ndarray, count: int, samples: int) -> np.ndarray:
    """One 64-bit value for each sample of a text."""
    return _folded(sampled(hashes, count, samples))


def buckets_of_all(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Signed 64-bit buckets of each text's labelled k-mers, of which it has any; tier and sample are hashed in.

    Samples of one size are folded together: steps on the few samples of one text cost mostly their calls.
    """
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for i, (_, count, samples) in enumerate(TIERS):
        sizes: dict[int, list[int]] = {}
        for t, hashes in enumerate(texts):
            if i in tiers_of(len(hashes)):
                sizes.setdefault(min(count, len(hashes)), []).append(t)
        of_sample = np.arange(samples, dtype=np.uint64) + np.uint64(1000 * i)
        for members in sizes.values():
            x = _folded(np.concatenate([sampled(texts[t], count, samples) for t in members])).reshape(len(members), samples)
            for t, row in zip(members, _mix(x * _G1 + of_sample).view(np.int64), strict=True):
                parts[t].append(row)
    return [np.concatenate(p) for p in parts]


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    """Buckets of one text."""
    return buckets_of_all([hashes])[0]


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """matched / (all of both - matched) of two sequences in an alignment; exact if least or more, else some value below.

    An alignment that reaches it leaves at most a known number of places unmatched, and so stays in a band that wide.
    Bits of an integer stand for the places of one sequence, and each step takes in one place of the other.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    if min(n, m) < least * max(n, m):
        return 0.0
    need = least / (1 + least) * (n + m)  # matches
    both = np.intersect1d(a, b)
    if np.isin(a, both).sum() < need - 1e-9 or np.isin(b, both).sum() < need - 1e-9:
        return 0.0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[head:][::-1][: k - head] != b[head:][::-1][: k - head])
    tail = int(differ[0]) if len(differ) else k - head
    x, y = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    matched = head + tail
    if x and y:
        width = int(n + m - 2 * need) + 1
        places: dict[int, int] = {}
        for i, v in enumerate(x):
            places[v] = places.get(v, 0) | 1 << i
        full = (1 << len(x)) - 1
        window = (1 << (2 * width + 1)) - 1
        row = full
        for i, v in enumerate(y):
            hit = places.get(v, 0)
            if hit:
                hit &= window << (i - width) if i >= width else window >> (width - i)
                if u := row & hit:
                    row = ((row + u) | (row - u)) & full
        matched += len(x) - row.bit_count()
    return matched / (n + m - matched)


def _numbers(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    if len(known) > 400_000:
        known.clear()
    h = xxhash.xxh64_intdigest
    return np.fromiter((known[w] if w in known else known.setdefault(w, h(w)) for w in words), np.uint64, len(words))


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (node, size, buckets), one for each different text that has words; size: its k-mers."""
    src = small_batches(docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.col(text).cast("string").alias("text")))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in slices(batches, 1):
            found = {}
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node not in found and (words := _split(t)):
                    found[node] = labelled(kmers(words, known))
            sizes, buckets = [len(k) for k in found.values()], buckets_of_all(list(found.values()))
            flat = pa.array(np.concatenate(buckets) if buckets else np.empty(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in buckets])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=["node", "size", "buckets"])

    return src.mapInArrow(sketch, "node bigint, size bigint, buckets array<bigint>").dropDuplicates(["node"])


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts align; texts: (node, text)."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    src = small_batches(pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held, last = None, None
        for b in slices(batches, 3):
            keep = []
            for i, (a, ta, tb) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if a != last:
                    last, held = a, _numbers(_split(ta), known)
                if aligned(held, _numbers(_split(tb), known), least) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    return src.mapInArrow(align, "a bigint, b bigint")


def link_classes(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (node, label) of the different texts that are linked to another; label is the class's least node."""
    spark = docs.sparkSession
    rows = written(signatures(docs, text), "signatures").select("node", "size", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(rows.join(written(shared, "buckets"), "bucket"), "members")
    # those that share most come first: a text the others were made from shares more with each than they among themselves
    rank = members.groupBy("node").agg(F.sum("members").alias("rank"))
    members = written(members.select("bucket", "node", "size").join(rank, "node"), "ranked")
    src = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"), F.col(text).cast("string").alias("text"))
    texts = written(src.join(rank.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    labels = spark.createDataFrame([], "node bigint, label bigint")
    led = spark.createDataFrame([], "bucket bigint, node bigint")
    order = W.partitionBy("bucket").orderBy(F.desc("rank"), "node")
    for turn in (0, 1, 2):
        now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # of each bucket with several classes, all members but those of the largest have to lead once
        counts = now.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        largest = counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("classes"), F.sum("n").alias("members"))
        live = written(now.join(written(largest.where("classes > 1"), "open"), "bucket"), "live")
        # at first no class is largest, and the best ranked member leads
        due = live if turn == 0 else live.where("label <> largest").join(led, ["bucket", "node"], "left_anti")
        if turn == 2:
            open_buckets = due.select("bucket").distinct()
            left = live.join(open_buckets, "bucket", "left_semi").select("node", "label").distinct()
            pairs = rare_pairs(texts.join(left, "node"), least)
        else:
            few = F.col("place") <= 4**turn
            leaders = due.withColumn("place", F.row_number().over(order)).where((F.col("members") <= EXHAUSTED) & F.lit(turn > 0) | few)
            leaders = written(leaders.select("bucket", F.col("node").alias("leader"), F.col("label").alias("leader_label"), F.col("size").alias("leader_size")), "leaders")
            # sizes too far apart can't reach the similarity
            near = (F.col("label") != F.col("leader_label")) & (F.least("size", "leader_size") >= least * F.greatest("size", "leader_size"))
            pairs = live.join(leaders, (live["bucket"] == leaders["bucket"]) & near).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            led = led.union(leaders.select("bucket", F.col("leader").alias("node")))
        links = written(verify(pairs, texts, least), "verified")
        if not links.isEmpty():
            labels = _joined(labels, links)
    return labels


def rare_pairs(texts: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of texts (node, text, label) of different labels that may share least of their labelled k-mers.

    Two texts that do have one in common among the rarest of either, of which so many count as may be without match: of
    the smaller text fewer than of the larger one, as a larger one may have more of its own. What is left of both
    texts behind that k-mer, in order of rarity, must also suffice. So texts whose own k-mers are too many to reach the
    similarity with a text of their size or more make no row on that side, however many share a passage with them.
    The k-mers of the most texts are known to all tasks, which leave out those that can't be among a text's rarest; a
    row of any other is joined with its count.
    """

    def kmers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        known: dict[bytes, int] = {}
        for b in slices(batches, 2):
            for node, label, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if words := _split(t):
                    yield node, label, labelled(kmers(words, known)).view(np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _added_up((np.stack([k, np.ones_like(k), np.full_like(k, node), np.full_like(k, len(k))]) for node, _, k in kmers_of(batches)), SUMMED_KMERS):
            yield pa.RecordBatch.from_arrays([*map(pa.array, x)], names=["kmer", "texts", "node", "size"])

    def rarest(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """K-mers that are not held, of places not yet known, and behind them the held ones within reach: these are commoner."""
        held, texts_of = shared.value
        for node, label, k in kmers_of(batches):
            n, at = len(k), np.searchsorted(held, k)
            hit = np.append(held, 0)[at] == k
            hit &= at < len(held)
            others, own = k[~hit], k[hit]
            own = own[np.lexsort((own, texts_of[at[hit]]))[: max(0, n - math.ceil(n * least - 1e-9) + 1 - len(others))]]
            out = np.concatenate([others, own])
            fixed = [pa.array(np.full(len(out), x, np.int64)) for x in (node, label, n, hit.sum())]
            place = pa.array(np.arange(1, len(out) + 1), mask=np.arange(len(out)) < len(others))
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(out), place], names=["node", "label", "size", "held", "kmer", "place"])

    def reach(size: Column) -> Column:
        return size - up(size * least) + 1

    up = lambda x: F.ceil(x - 1e-9)
    # read twice, and in few tasks if the texts are few: a task adds up what its texts share
    texts = written(texts.select("node", "label", "text"), "left")
    # a text has a k-mer once, so that of one text only has its node and size
    counted = small_batches(texts).mapInArrow(spread, "kmer bigint, texts bigint, node bigint, size bigint").groupBy("kmer")
    counted = written(counted.agg(F.sum("texts").alias("texts"), F.min("node").alias("node"), F.min("size").alias("size")), "counted")
    common = counted.where("texts > 1").select("kmer", "texts")
    # k-mers of one text only match nothing, and are its rarest: texts of too many of them need no rows, the others' own none but their number
    own = counted.where("texts = 1").groupBy("node").agg(F.count("*").alias("own"), F.min("size").alias("size"))
    held, joined = _commonest(common, HELD_KMERS)
    rows = small_batches(texts.join(own.where(F.col("own") >= reach(F.col("size"))), "node", "left_anti"))
    held = texts.sparkSession.sparkContext.broadcast(held)  # at most HELD_KMERS entries
    rows = written(rows.mapInArrow(partial(rarest, held), "node bigint, label bigint, size bigint, held bigint, kmer bigint, place bigint"), "spread")
    order = W.partitionBy("node").orderBy("texts", "kmer")
    place = F.row_number().over(order) + F.col("size") - F.col("held") - F.count("*").over(W.partitionBy("node"))
    share = least / (1 + least)  # of both sizes, that must be shared
    first = rows.where("place IS NULL").join(joined, "kmer").withColumn("place", place).where(F.col("place") <= reach(F.col("size")))
    columns = ["node", "label", "size", "kmer", "place"]
    first = written(first.select(columns).union(rows.where("place IS NOT NULL").select(columns)), "rare")
    # a k-mer's members of its largest class meet its others only, not each other
    counts = first.groupBy("kmer", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("kmer").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.count("*").alias("classes")).where("classes > 1")
    met = first.join(largest, "kmer").withColumn("most", F.col("label") == F.col("largest")).drop("largest", "classes")
    met = written(met, "met")
    small = met.where(F.col("place") <= F.col("size") - up(F.col("size") * 2 * share) + 1)
    large = met.withColumnsRenamed({"node": "b", "label": "label_b", "size": "size_b", "kmer": "kmer_b", "place": "place_b", "most": "most_b"})
    sizes = (F.struct("size", "node") < F.struct("size_b", "b")) & (F.col("size") >= F.col("size_b") * least - 1e-9)
    left = 1 + F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    near = (F.col("kmer") == F.col("kmer_b")) & (F.col("label") != F.col("label_b")) & sizes & (left >= up((F.col("size") + F.col("size_b")) * share))
    pairs = small.where("NOT most").join(large, near).union(small.where("most").join(large.where("NOT most_b"), near))
    return pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _added_up(parts: Iterator[np.ndarray], most: int) -> Iterator[np.ndarray]:
    """Columns (kmer, texts, node, size) of parts, one for each k-mer: the sum of texts, the least node and size.

    Of about most columns at a time: then those that are still more than half as many go out, and a k-mer may come again.
    """

    def added() -> np.ndarray:
        x = np.concatenate(held, axis=1)
        x = x[:, np.argsort(x[0], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
        return np.stack([x[0, first], np.add.reduceat(x[1], first), *(np.minimum.reduceat(c, first) for c in x[2:])])

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.shape[1]
        if n >= most:
            held = [added()]
            n = held[0].shape[1]
            if n > most // 2:
                yield held[0]
                held, n = [], 0
    if n:
        yield added()


def _commonest(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """At most most rows of counts (kmer, texts), as arrays by kmer, and the rows beside them: none of these has as many texts as any of those.

    Counts are taken by classes of about equal ones, each whole or not at all.
    """
    kind = F.floor(F.log2("texts") * 16)
    total, least = 0, None
    for r in counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("kind")).collect():  # 16 * log2 of the largest count
        total += r["n"]
        if total > most:
            break
        least = r["kind"]
    rows = sorted((r["kmer"], r["texts"]) for r in counts.where(kind >= least).collect()) if least is not None else []
    held = np.array(rows, np.int64).reshape(-1, 2)
    return (held[:, 0].copy(), held[:, 1].copy()), counts if least is None else counts.where(kind < least)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after links between nodes; classes are joined by their labels."""
    ends = links
    for side in ("a", "b"):
        ends = ends.join(labels.withColumnsRenamed({"node": side, "label": f"l{side}"}), side, "left")
    new = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).withColumnsRenamed({"node": "old", "label": "new"})
    moved = labels.join(new, labels["label"] == new["old"], "left").select("node", F.coalesce("new", "label").alias("label"))
    fresh = new.select(F.col("old").alias("node"), F.col("new").alias("label")).join(labels, "node", "left_anti")
    return written(moved.union(fresh), "labels")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Rows (doc_id, class_id, class_size), one for each row of docs; class_id is the least id of the class."""
    labels = link_classes(docs, text, least)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("node"))
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = nodes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    known = nodes.select("node", "label").join(classes, "label").select("node", "class_id", "class_size")
    return ids.join(known, "node").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of docs for each class: that of the least id (nulls last), of rows with that id any one of the least text hash."""
    labels = link_classes(docs, text, least).withColumnsRenamed({"node": "_nd_other", "label": "_nd_label"})
    rows = docs.withColumn("_nd_node", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(labels, rows["_nd_node"] == labels["_nd_other"], "left").withColumn("_nd_label", F.coalesce("_nd_label", "_nd_node"))
    order = W.partitionBy("_nd_label").orderBy(F.col(doc_id).asc_nulls_last(), "_nd_node")
    return rows.withColumn("_nd_place", F.row_number().over(order)).where("_nd_place = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
