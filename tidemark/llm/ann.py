"""Approximate nearest neighbours by largest inner product, in a forest of random-projection trees.

Every vector gets one more component so that all have the same length (the largest in the table); nearest by inner
product are then nearest by angle. Trees are grown on a bounded sample by hyperplanes between two random sample points,
to leaves of so many table rows as LEAF says; all rows are sent down every tree. A query goes down all trees at once
through one priority queue: of all nodes put off in any tree, the one whose hyperplanes were missed by least is next.
Candidates in the leaves it reaches are ranked exactly, by inner products of the original vectors in double precision.

Equal vectors are one point of the index that stands for its least ids, as many as a query can return, which loses
nothing as ties go to smaller ids. Leaves are cut into chunks of bounded size before they meet their queries, so no task
holds a leaf whole however many vectors fall into it. Null and zero vectors and those with null or non-finite components
take no part, neither do rows with a null id; vectors whose length isn't the most common one are an error. Repeated rows
of one id count once. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import small_batches, written

#: Rows that trees are grown on, at most.
SAMPLE = 65_536
TREES = 24
#: Rows of the table in a leaf, about.
LEAF = 256
#: A query looks at leaves of about FACTOR * rows ** POWER rows together: enough for nine in ten of the nearest among
#: vectors without any structure, as measured at 10,000 and 50,000 rows. Vectors in clusters need far less.
FACTOR, POWER = 7.0, 0.77
#: Rows in a chunk of a leaf.
CHUNK = 2048
NEAREST = 20


def _top(scores: np.ndarray, most: int) -> np.ndarray:
    """Columns of each row's largest values, and of those equal to the last of them the first."""
    cut = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
    out = np.empty((len(scores), most), np.int64)
    for i, (row, c) in enumerate(zip(scores, cut, strict=True)):
        at = np.flatnonzero(row >= c)
        out[i] = at[np.argsort(-row[at], kind="stable")[:most]]
    return out


class Tree:
    """Hyperplanes in heap-free arrays: node i splits by normals[i] and offsets[i] into left[i], right[i]; negative: leaf."""

    def __init__(self, points: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        todo = [(np.arange(len(points)), None, False)]
        while todo:
            rows, parent, is_right = todo.pop()
            split = self._split(points[rows], rng) if len(rows) > leaf else None
            if split is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                normal, offset, side = split
                me = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.left.append(0)
                self.right.append(0)
                todo += [(rows[~side], me, False), (rows[side], me, True)]
            if parent is not None:
                (self.right if is_right else self.left)[parent] = me
        self.root = 0 if self.normals else -1
        self.normals = np.array(self.normals, np.float32).reshape(len(self.normals), points.shape[1])
        self.offsets, self.left, self.right = np.array(self.offsets, np.float32), np.array(self.left, np.int64), np.array(self.right, np.int64)

    @staticmethod
    def _split(points: np.ndarray, rng: np.random.Generator):
        """The hyperplane of two random points' difference, through the median."""
        for _ in range(5):
            a, b = points[rng.choice(len(points), 2, replace=False)]
            normal = a - b
            size = float(np.linalg.norm(normal))
            if size > 1e-12:
                normal = normal / size
                at = points @ normal
                offset = float(np.median(at))
                side = at > offset
                if 0 < side.sum() < len(points):
                    return normal, offset, side
        return None

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.full(len(points), self.root)
        while (inner := node >= 0).any():
            i = np.flatnonzero(inner)
            n = node[i]
            right = np.einsum("ij,ij->i", points[i], self.normals[n]) > self.offsets[n]
            node[i] = np.where(right, self.right[n], self.left[n])
        return -1 - node


def probes(trees: list[Tree], point: np.ndarray, leaves: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves that a query reaches first."""
    queue = [(0.0, t, tree.root) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    out = []
    at = [tree.normals @ point - tree.offsets for tree in trees]
    while queue and len(out) < leaves:
        missed, t, node = heapq.heappop(queue)
        tree = trees[t]
        while node >= 0:
            d = float(at[t][node])
            near, far = (tree.right[node], tree.left[node]) if d > 0 else (tree.left[node], tree.right[node])
            heapq.heappush(queue, (max(missed, abs(d)), t, int(far)))
            node = int(near)
        out.append((t, -1 - node))
    return out


def _points(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return (np.concatenate([vectors, rest[:, None]], 1) / longest).astype(np.float32)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (vec_id, v) that take part, v in double precision."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine.isNotNull() & fine).dropDuplicates(["vec_id"])


def search(vectors: DataFrame, queries, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, trees: int = TREES, leaf: int = LEAF, candidates: int | None = None, sample: int = SAMPLE, seed: int = 9) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the nearest rows found of each row for which the condition queries holds."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, vec_id, vector), "vectors")
    # a point's least ids, one more than can be returned, as the query's own may be among them
    least = W.partitionBy("v").orderBy("vec_id")
    points = written(rows.withColumn("place", F.row_number().over(least)).where(F.col("place") <= nearest + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.col("ids")[0].alias("point")), "points")
    n = points.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    longest = points.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    share = min(1.0, sample / n)
    seen = points.where(F.pmod(F.xxhash64("point", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(F.xxhash64("point")).limit(sample).select("v").toPandas()
    grown = _points(np.array(seen["v"].tolist(), float), longest)
    rng = np.random.default_rng(seed)
    # as many leaves as the table needs, but with four sample points in each at least
    forest = [Tree(grown, max(4, round(leaf * share)), rng) for _ in range(trees)]
    held = spark.sparkContext.broadcast((forest, float(longest)))  # at most sample / 4 hyperplanes a tree
    candidates = candidates or FACTOR * n**POWER
    per_leaf = max(1.0, n / max(t.leaves for t in forest))
    reach = max(trees, math.ceil(candidates / per_leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, longest = held.value
        for b in batches:
            if not b.num_rows:
                continue
            p = _points(np.array(b.column(1).to_pylist(), float), longest)
            leaves = np.stack([t.leaf_of(p) for t in forest], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaves.tolist(), pa.list_(pa.int64()))], names=["point", "v", "ids", "leaves"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, longest = held.value
        for b in batches:
            if not b.num_rows:
                continue
            p = _points(np.array(b.column(1).to_pylist(), float), longest)
            found = [[t << 40 | x for t, x in probes(forest, q, reach)] for q in p]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], names=["query_id", "q", "leaves"])

    index = small_batches(points.select("point", "v", "ids")).mapInArrow(place, "point bigint, v array<double>, ids array<bigint>, leaves array<bigint>")
    index = index.select("point", "v", "ids", F.posexplode("leaves").alias("tree", "leaf")).withColumn("leaf", F.shiftleft(F.col("tree").cast("bigint"), 40) + F.col("leaf")).drop("tree")
    index = written(index, "leaves")
    sizes = written(index.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "leaf-sizes")
    index = index.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("point"), "chunks").cast("int"))
    asked = small_batches(rows.where(queries).select("vec_id", "v")).mapInArrow(probe, "query_id bigint, q array<double>, leaves array<bigint>")
    asked = asked.select("query_id", "q", F.explode("leaves").alias("leaf"))
    parts = sizes.select(F.col("leaf").alias("part_of"), F.col("chunks").alias("parts"))
    asked = asked.join(parts, asked["leaf"] == parts["part_of"]).select("query_id", "q", F.col("leaf").alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def rank(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({"query_id": [], "points": [], "scores": []})
        v = np.array(members["v"].tolist(), float)
        first = members["point"].to_numpy()
        # points by their least id, so that of equal scores the first are best
        order = np.argsort(first, kind="stable")
        v, first, most = v[order], first[order], min(nearest + 1, len(first))
        points, scores = [], []
        for a in range(0, len(queries), 256):
            q = np.array(queries["q"].iloc[a : a + 256].tolist(), float)
            found = q @ v.T
            best = np.argsort(-found, axis=1, kind="stable")[:, :most] if found.shape[1] < 4 * most else _top(found, most)
            points += list(first[best])
            scores += list(np.take_along_axis(found, best, 1))
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy(), "points": points, "scores": scores})

    def merge(found: pd.DataFrame) -> pd.DataFrame:
        points, scores = np.concatenate(found["points"].to_list()), np.concatenate(found["scores"].to_list())
        points, at = np.unique(points, return_index=True)
        scores = scores[at]
        # scores of blocks may differ in their last bits; what is close to the last place goes on to the exact ranking
        kept = np.argsort(-scores, kind="stable")
        last = scores[kept[min(nearest, len(kept) - 1)]]
        kept = kept[: max(nearest + 1, int((scores >= last - 1e-9 * max(1.0, abs(last))).sum()))]
        return pd.DataFrame({"query_id": found["query_id"].iloc[0], "point": points[kept]})

    found = asked.groupBy("at", "part").cogroup(index.groupBy("leaf", "chunk")).applyInPandas(rank, "query_id bigint, points array<bigint>, scores array<double>")
    near = written(found.groupBy("query_id").applyInPandas(merge, "query_id bigint, point bigint"), "found")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = near.join(points.select("point", "ids"), "point").select("query_id", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    two = rows.select("vec_id", F.col("v").alias("w"))
    exact = top.select("query_id", "vec_id").join(two, "vec_id").join(rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    score = F.aggregate(F.zip_with("q", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    ranked = exact.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
